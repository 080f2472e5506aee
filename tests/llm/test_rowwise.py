"""Quality rules, language identification, packing, secret scans and mixing against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessaline.llm import langid, mixing, packing, quality, secrets

from .cases import odd_docs, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_text_features_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "  ", "#", "d\t", " ", "\n"]) for _ in range(rng.randrange(80)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.text_features(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_quality_rules(spark):
    rows = [(i, "word " * 30 if i % 10 else "few", "en", "bad" if i < 60 else f"h{i % 7}", 1) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{i}x{k}" for k in range(20)), "en", f"h{i % 7}", 1) for i in range(200)] + [(900, " ".join(f"v{k}" for k in range(20)), "en", "bad", 1)]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert len(out) == 261 and out[1].base_failed and not out[900].base_failed and not out[900].kept
    assert all(out[100 + i].kept for i in range(200))
    odd = quality.quality_rules(odd_docs(spark), max_rate=2.0).collect()
    assert len(odd) == len(odd_rows()) and all(r.kept == (not r.base_failed) for r in odd)
    assert quality.quality_rules(odd_docs(spark).limit(0)).count() == 0


def test_quality_without_broadcast(spark):
    docs = odd_docs(spark)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(quality.quality_rules(docs)) == key(quality.quality_rules(docs, broadcast_hosts=0))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and np.mean([r.lang_pred == r.lang for r in out]) > 0.97


def test_language_backs_off_and_edges(spark):
    model = langid.Model.fit([("x", 0, "hello", 5), ("y", 0, "bonjour", 5), *(("x", n, g, 3) for n in range(1, 5) for g in langid.ngrams("hello", n)), *(("y", n, g, 3) for n in range(1, 5) for g in langid.ngrams("bonjour", n))])
    assert [p[0] for p in langid.Scorer(model).predict(["hello", "jourbon", "zzhell"])] == ["x", "y", "x"]
    assert langid.Scorer(model).predict(["12 !", None]) == [("und", 0.0)] * 2 and langid.Scorer(langid.Model.fit([])).predict(["hello"]) == [("und", 0.0)]
    docs = odd_docs(spark)
    out = langid.identify(docs, langid.train(docs)).collect()
    assert len(out) == len(odd_rows()) and {r.lang_pred for r in out} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert langid.filter_languages(docs).columns == docs.columns


def test_language_by_plain_backoff():
    """Predictions against sums over dictionaries, word by word."""
    rng = random.Random(13)
    letters = {"a": "abcde", "b": "cdefg", "c": "éßxyz"}
    text = lambda pool, k: " ".join("".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(k))
    counts = Counter()
    for lang, pool in letters.items():
        for w in text(pool, 200).split():
            counts[lang, 0, w] += 1
            for n in range(1, 5):
                for g in langid.ngrams(w, n):
                    counts[lang, n, g] += 1
    rows = [(*k, c) for k, c in counts.items()]
    units = [{u for _, m, u, _ in rows if m == n} for n in range(5)]
    total = {(lang, n): sum(c for ll, m, _, c in rows if (ll, m) == (lang, n)) + 0.5 * len(units[n]) + 1 for lang in letters for n in range(5)}
    log = lambda lang, n, u: math.log((counts[lang, n, u] + 0.5) / total[lang, n])
    texts = [text(letters[rng.choice("abc")] + "q", rng.randrange(0, 30)) for _ in range(150)] + [None, "", "42", "q" * 3000]
    got = langid.Scorer(langid.Model.fit(rows), room=60).predict(texts)
    for t, (lang, score) in zip(texts, got, strict=True):
        words, sums = langid.words_of(t), dict.fromkeys(letters, 0.0)
        for w in words:
            known = next(([g for g in gs if g in units[n]] for n, gs in [(0, [w])] + [(n, langid.ngrams(w, n)) for n in (4, 3, 2, 1)] if any(g in units[n] for g in gs)), [])
            n = 0 if known == [w] and w in units[0] else len(known[0]) if known else 0
            for name in letters:
                sums[name] += sum(log(name, n, g) for g in known) / len(known) if known else 0.0
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        mean = {name: v / len(words) * min(len(words), 8) for name, v in sums.items()}
        share = {name: math.exp(v - max(mean.values())) for name, v in mean.items()}
        assert mean[lang] == pytest.approx(max(mean.values())) and score == pytest.approx(share[lang] / sum(share.values()))


def test_packing_round_trip(spark):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [0] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, PATH).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, own in pieces.items():
        assert [s for s, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1]) and sum(n for _, n in own) == len(ids[doc_id])
    assert set(pieces) == set(ids)
    for own in sequences.values():
        assert [s for s, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1]) and sum(n for _, n in own) <= 1024
    tokens = sum(map(len, ids.values()))
    assert len(sequences) * 1024 - tokens < 1024 * 12
    odd = packing.pack(odd_docs(spark), PATH).collect()
    assert sum(r.start == 0 for r in odd) == len(odd_rows()) and sum(r.doc_tokens == 1 for r in odd) == 3
    assert packing.pack(odd_docs(spark).limit(0), PATH).count() == 0


def test_encoder_equals_the_library():
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    rng = random.Random(2)
    pool = list("ab C9'sre\n\t.,éß中\U0001f600́½١  　\x1c\x85​\x00") + ["  ", "'ll", " the", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choice(pool[:8] + ["\n", "'s", "é", "²", "<|endoftext|>"]) for _ in range(rng.randrange(1, 6))).replace(" ", "") for _ in range(20)) for _ in range(500)]
    texts += ["a ", " a", "a  b", " ", "", "a \n b", "\u3000 a"]
    got = packing.encoder(PATH)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_levels_follow_the_sum_of_squares():
    rng = random.Random(4)
    levels, counts = packing.Levels(16), Counter()
    for k in range(300):
        size = rng.randrange(1, 16)
        options = {h: sum((c + (lv == h + size and h + size < 16) - (lv == h and h > 0)) ** 2 for lv, c in ({**{i: 0 for i in range(1, 16)}, **counts}).items()) for h in range(17 - size) if h == 0 or counts[h]}
        best = levels.best(size)
        assert options[best] == min(options.values())
        levels.place((k, 0, b"\0\0\0\0" * size), size)
        if best:
            counts[best] -= 1
        if best + size < 16:
            counts[best + size] += 1
        assert all(levels.counts[i] == counts[i] == len(levels.open[i]) for i in range(1, 16))


def test_leftovers_lose_nothing_and_pad_little():
    rng = random.Random(7)
    levels, full, sizes = packing.Levels(), [], {}
    for k in range(4000):
        sizes[k] = min(1023, int(rng.lognormvariate(5.5, 1)) + 1)
        if (done := levels.place((k, 0, bytes(4 * sizes[k])), sizes[k])) is not None:
            full.append(done)
    before = len(full)
    rest = levels.leftovers()
    got = Counter()
    for pieces in full + rest:
        fill = sum(len(ids) // 4 for _, _, ids in pieces)
        assert fill <= 1024
        for k, _, ids in pieces:
            got[k] += len(ids) // 4
    assert got == Counter(sizes)
    short = [f for f in (sum(len(ids) // 4 for _, _, ids in pieces) for pieces in rest) if f & (f - 1)]  # neither full nor at a power of two
    assert len(short) <= 1 and levels.replaced > 50 and before + levels.replaced > 0.7 * len(full + rest)


def plain_base(text):
    spans = []
    for kind, pattern, ok in (("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)):
        spans += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, m in enumerate(pattern.finditer(text)) if ok(m)]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(s[2] for s in sorted(spans, key=lambda s: (s[0], order[s[2].split(":")[0]])))


def test_secret_base_spans():
    rng = random.Random(6)
    parts = ["password", "TOKEN", "Api_Key", "apikey", " ", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "ſecret", "Key", "İ", "\n", "zz.9/+_-=="]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert secrets.joined(secrets.base_spans(text)) == plain_base(text)


def test_secret_network_and_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = secrets.train(docs)
    fresh = secrets.generated(400, seed=99)
    scores = net.scores([d[:3] for d in fresh])
    truth = np.array([d[3] for d in fresh])
    assert (scores[truth == 1] >= net.threshold).mean() > 0.85 and (scores[truth == 0] < net.threshold).mean() > 0.85
    for r in secrets.scan(docs, net).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.base_sha256 == hashlib.sha256(plain_base(r.text).encode()).hexdigest()
        assert set(filter(None, plain_base(r.text).split(","))) <= set(r.spans.split(","))
    odd = secrets.scan(odd_docs(spark), net).collect()
    assert len(odd) == len(odd_rows()) and sum(r.n_assign for r in odd) == 1
    key = "sk-Zx8Qw2Lm9Tr4Yp6Bn3Vc7Kd5Hs1Gf0JaXuEi"
    out = secrets.redact(spark.createDataFrame([(1, f"plain words before {key} after", "en", "s", 1), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert key not in out[0].text and out[0].n_chars == len(out[0].text) and out[1].text is None
    assert secrets.scan(odd_docs(spark).limit(0), net).count() == 0
    assert sum(r.n_judged for r in secrets.scan(docs, net).collect()) > 0
    found = lambda text: [text[s:e] for k, s, e in secrets.all_spans([text], net)[0][1] if k == "cnn"]
    letters = "QwZkTrbXhGvNsLpYcJdMfRaB"
    assert found(f"words then {letters} and more") == [letters]
    behind = "/".join(["folder"] * 12) + "/" + key  # the key lies beyond the network's field
    assert found(f"see {behind} end") == [behind]


def test_secret_candidates_by_plain_rules():
    rng = random.Random(9)
    parts = ["abc", "ABC", "Word", "42", "-", "_", " ", ".", "/", "é", "longerwords", "\n", "0123456789abcdef", "token=abcdefghijkl"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        taken, want = secrets.base_spans(text), []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", text):
            run = m[0]
            letters, digits = re.search("[A-Za-z]", run), re.search("[0-9]", run)
            cased = letters and not (run.islower() or run.isupper() or run.istitle())
            if (len(run) >= 16 or letters and digits or cased) and not any(a < m.end() and m.start() < e for _, a, e in taken):
                want.append(m.span())
        assert list(secrets.candidates(text, taken)) == want


def test_convolution_by_plain_loops():
    net = secrets.Network.new(np.random.default_rng(3))
    x, _ = secrets.encode([("see é key=abcDEF0123456789 now", 10, 26), ("x" * 30 + "Ab3" * 50, 30, 180)])
    p = net.params
    for row, logit in zip(x, net.logits(x), strict=True):
        z = np.array([[max(0.0, sum(p["E"][row[t + i]][d] * p["W"][i * 8 + d][f] for i in range(5) for d in range(8)) + p["b"][f]) for f in range(24)] for t in range(len(row) - 4)])
        assert logit == pytest.approx(float(np.concatenate([z.max(0), z.mean(0)]) @ p["v"] + p["c"][0]))


def test_secret_scan_is_linear():
    """Ten megabytes of keys; also one run longer than any field."""
    net = secrets.Network.new(np.random.default_rng(1))
    net.threshold = 2.0
    began = time.time()
    text = "token = abcdef123456 " * 300_000 + "0123456789abcdef " * 200_000 + "Z" * 500_000
    (base, spans, judged), = secrets.all_spans([text], net)
    assert len(base) == 500_000 and len(spans) == 500_000 and judged == 1 and time.time() - began < 120


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = secrets.Network.new(rng)
    x, y = rng.integers(0, 40, (5, 30)), np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = net.logits(x)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradients(x, y)
    for k, v in net.params.items():
        at = np.unravel_index(int(np.abs(grads[k]).argmax()), v.shape)
        keep, h = v[at], 1e-6
        v[at] = keep + h
        up = loss()
        v[at] = keep - h
        down = loss()
        v[at] = keep
        assert (up - down) / (2 * h) == pytest.approx(grads[k][at], rel=1e-3)


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 1.0, "b": 0.001}])
def test_mixing_keeps_within_a_block(spark, weights):
    docs = spark.createDataFrame([(i, f"t{i}", "abcd"[min(3, i % 5)]) for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.schedule(docs, weights, block_docs=4, period=64).collect()
    assert len(rows) == 2000 and len({r.mix_position for r in rows}) == 2000
    share = mixing.quotas({s: (weights or {}).get(s, 1.0) for s in "abcd"}, 64)
    slots = defaultdict(set)
    for r in rows:
        slots[r.source].add(r.mix_slot)
    taken = Counter(s for own in slots.values() for s in own)
    assert max(taken.values()) == 1
    for source, own in slots.items():
        done = 0
        for t in range(max(own) + 1):
            done += t in own
            assert abs(done - share[source] * (t + 1) / 64) < 1
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.source, r.mix_block].append(r.mix_position)
    sizes = Counter(s for s, _ in blocks)
    assert all(len(p) == 4 or b == sizes[s] - 1 for (s, b), p in blocks.items()) and all(max(p) - min(p) < 4 for p in blocks.values())


@pytest.mark.parametrize("weights", [dict.fromkeys("abcdefg", 1.0), {"a": 0.6, "b": 0.3999, "c": 0.0001}])
def test_mixing_follows_the_exact_weights(spark, weights):
    """No drift over many periods, and no weight raised to a slot of a short one."""
    names, total = sorted(weights), sum(weights.values())
    docs = spark.createDataFrame([(i, f"t{i}", names[i % len(names)]) for i in range(6000) if names[i % len(names)] != "c" or i < 100 or len(names) > 3], "doc_id long, text string, source string")
    slots = defaultdict(set)
    for r in mixing.schedule(docs, weights, block_docs=1 if len(names) > 3 else 40).select("source", "mix_slot").collect():
        slots[r.source].add(r.mix_slot)
    assert max(Counter(s for own in slots.values() for s in own).values()) == 1
    for source, own in slots.items():
        done = 0
        for t in range(max(own) + 1):
            done += t in own
            assert abs(done - weights[source] / total * (t + 1)) < 1


def plain_schedule(weights, blocks, slots):
    """Earliest deadline first by its definition, in fractions: the slot of every block of every source."""
    total = sum(weights.values())
    w = {s: Fraction(str(x)) / Fraction(str(total)) for s, x in weights.items()}
    placed, out = dict.fromkeys(w, 0), {}
    for t in range(slots):
        ready = [s for s in sorted(w) if math.floor(placed[s] / w[s]) <= t]
        s = min(ready, key=lambda s: (math.ceil((placed[s] + 1) / w[s]), s))
        if placed[s] < blocks[s]:
            out[s, placed[s]] = t
        placed[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2, "d": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 0.5003, "b": 0.4897, "c": 0.01}, {"a": 0.37, "b": 0.63}])
def test_mixing_equals_the_plain_schedule(spark, weights):
    names = sorted(weights)
    docs = spark.createDataFrame([(i, f"t{i}", names[i % len(names)]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.schedule(docs, weights, block_docs=3).collect()
    blocks = Counter(s for s, _ in {(r.source, r.mix_block) for r in rows})
    assert {(r.source, r.mix_block): r.mix_slot for r in rows} == (lambda p: {k: p[k] for k in p if k[1] < blocks[k[0]]})(plain_schedule(weights, blocks, max(r.mix_slot for r in rows) + 1))


def test_exact_shares_over_many_slots():
    """The deviation from the unrounded weights stays under a block over 100,000 slots."""
    weights = {"a": 1 / 4, "b": 0.3, "c": 0.4499, "d": 0.0001}
    share = mixing.exact_quotas(weights)
    period, placed = sum(share.values()), Counter()
    one = mixing.first_slots(share, period, period)
    assert len(one) == period
    for t in range(100_000):
        placed[one[t % period][0]] += 1
        assert all(abs(placed[s] - weights[s] * (t + 1)) < 1 for s in weights)


def test_mixing_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], i, i, i, i, i) for i in range(50)], "doc_id long, text string, source string, _hash int, mix_slot int, nth int, skey int, M int")
    assert sorted(mixing.in_order(docs, block_docs=4).collect()) == sorted(docs.collect())
    out = mixing.schedule(docs, block_docs=4)
    assert out.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_block", "mix_slot", "mix_position"]
    assert sorted(r._hash for r in out.collect()) == list(range(50))
    with pytest.raises(ValueError):
        mixing.schedule(spark.range(10_001).selectExpr("id AS doc_id", "'' AS text", "string(id) AS source"))


def test_mixing_odd_rows_and_order(spark):
    docs = odd_docs(spark)
    out = mixing.schedule(docs)
    assert out.count() == len(odd_rows()) and out.columns == [*docs.columns, "mix_block", "mix_slot", "mix_position"]
    assert mixing.schedule(docs.limit(0)).count() == 0
    ordered = mixing.in_order(docs, block_docs=2)
    assert sorted(map(str, ordered.collect())) == sorted(map(str, docs.collect()))
    many = spark.createDataFrame([(i, None, f"s{i % 900}") for i in range(3000)], "doc_id long, text string, source string")
    assert mixing.schedule(many, period=512).select("mix_slot").distinct().count() == 900
