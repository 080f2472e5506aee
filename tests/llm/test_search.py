"""MaxScore search, URL filters and near-duplicates against brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from tessaline.llm import maxscore, neardup, urlfilter

from .cases import odd_docs, odd_rows


def brute_top(rows, k=10):
    ok = {}
    vecs = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, c in vecs:
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(c, d, strict=False)), i) for i, d in vecs if i != q)[:k]
            ok[q] = [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(t for own in ok.values() for t in own)


@pytest.mark.parametrize("shard", [8192, 64])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(0, 1500, 2)]
    rows += [(i, rows[3][1]) for i in range(1, 400, 2)] + [(700, None), (9001, [1.0, None] + [0.0] * 10), (9003, [float("nan")] * 12), (9005, [float("inf")] * 12), (None, [1.0] * 12), (9100, [5.0, 2.0]), (9101, [])]
    rows = [r for r in rows if r[0] != 700 or r[1] is None] + [rows[0], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, maxscore.top_k(df).collect())) == brute_top(rows)
    assert maxscore.top_k(df.limit(0)).count() == 0


def test_search_bounds():
    rng = np.random.default_rng(5)
    for n, d, high in ((1, 1, 5), (30, 3, 2), (900, 16, 1000), (700, 4, 1 << 26)):
        v, q = rng.integers(-high, high, (n, d)), rng.integers(-high, high, d)
        ids = np.sort(rng.choice(n * 3, n, replace=False))
        got = maxscore.search(ids, v, int(ids[0]), q, 10)
        scores = (v.astype(object) * q.astype(object)).sum(1)
        assert got == [(int(i), int(s)) for s, i in sorted(((s, i) for s, i in zip(scores, ids, strict=True) if i != ids[0]), key=lambda x: (-x[0], x[1]))[:10]]


def active(entries, key, at):
    on = False
    for k, day, action in sorted((e for e in entries if None not in e), key=lambda e: (e[1], e[2] == "block")):
        if k.split("/")[0].lower() + k[len(k.split("/")[0]) :] == key and datetime.fromisoformat(day) <= at:
            on = action == "block"
    return on


def test_url_filter(spark):
    rng = random.Random(3)
    hosts = ["a.b.example.com", "b.example.com", "spam.org", "x.spam.org", "q", "10.0.0.7"]
    entries = [(rng.choice(["b.example.com", "spam.org", "spam.org/x", "x.spam.org/x/y", "com", "SPAM.org/Path", "0.0.7", "10.0.0.7"]), f"2024-0{rng.randrange(1, 10)}-01", rng.choice(["block", "allow"])) for _ in range(30)]
    entries += [("q", None, "block"), (None, "2024-01-01", "block")]
    pages = [(i, rng.choice(["http://", "HTTPS://u:p@"]) + rng.choice(hosts).upper() + rng.choice(["", ":80", "."]) + rng.choice(["", "/", "/x", "/x/y/z?a=b#c", "/Path/a"]), datetime(2024, 1, 1) + timedelta(days=rng.randrange(366))) for i in range(300)]
    pages += [(900, None, pages[0][2]), (901, "nonsense", pages[0][2]), (902, pages[0][1], None), pages[5]]
    df = spark.createDataFrame([(*p, "k", 1, "s") for p in pages], "page_id long, url string, fetched timestamp, key string, _url int, since string")
    e = spark.createDataFrame(entries, "key string, listed string, action string")
    out = sorted(urlfilter.temporal_filter(df, e).collect(), key=str)
    assert out == sorted(urlfilter.temporal_filter(df, e, small=0).collect(), key=str) and len(out) == len(pages)
    by = {r.page_id: r for r in out}
    for i, url, at in pages:
        if url is None or at is None or "://" not in url:
            assert not by[i].blocked and by[i].n_active == 0 and by[i].matched_key is None
            continue
        rest = url.lower().split("://")[1].split("@")[-1]
        host = rest.split("/")[0].split(":")[0].rstrip(".")
        path = [p for p in url.split("://")[1].partition("/")[2].split("?")[0].split("/") if p]
        labels = host.split(".")
        keys = {".".join(labels[k:]) for k in range(1 if host == "10.0.0.7" else max(len(labels) - 1, 1))} | {"/".join([host, *path[: k + 1]]) for k in range(len(path))}
        hits = [k for k in keys if active(entries, k, at)]
        assert by[i].host == host and by[i].n_active == len(hits) and by[i].blocked == bool(hits) and by[i].matched_key == (max(hits, key=lambda k: (len(k), k)) if hits else None)
    assert urlfilter.temporal_filter(df.limit(0), e).count() == 0 and urlfilter.temporal_filter(df, e.limit(0)).where("blocked").count() == 0


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    a, b = rng.uniform(1, 3, 300).astype(np.float32), rng.uniform(1, 3, 300).astype(np.float32)
    ha, hb = h[:300], h[50:350]
    oa, ob = np.argsort(ha), np.argsort(hb)
    true = neardup.similarity((ha[oa], a[oa]), (hb[ob], b[ob]))
    da, db = dict(zip(ha.tolist(), a.tolist(), strict=True)), dict(zip(hb.tolist(), b.tolist(), strict=True))
    assert true == pytest.approx(sum(min(da.get(k, 0), db.get(k, 0)) for k in {*da, *db}) / sum(max(da.get(k, 0), db.get(k, 0)) for k in {*da, *db}))
    hits = []
    for shift in range(30):
        x = np.uint64(shift * 7919)
        s = neardup.samples(np.concatenate([ha ^ x, hb ^ x]), np.concatenate([a, b]), np.array([0, 300]))
        hits.append((s[0] == s[1]).mean())
    assert np.mean(hits) == pytest.approx(true, abs=0.04)


def brute_classes(rows, threshold):
    """Components of all pairs at the threshold, by plain sets of words, document frequencies and weights."""
    grams = []
    for _, t in rows:
        words = (t or "").split()
        k = min(5, len(words))
        grams.append(Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter())
    df = Counter(g for own in grams for g in own)
    n = len(rows)
    steps = {g: round(8 * np.log2(k)) / 8 for g, k in df.items()}
    idf = {g: 1 + np.log((1 + n) / (1 + min(2**s, n))) / np.log(1 + n) for g, s in steps.items()}
    weights = [{g: k * idf[g] for g, k in own.items()} for own in grams]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = weights[i], weights[j]
            if a and b and sum(min(a[g], b[g]) for g in a.keys() & b.keys()) >= threshold * sum(max(a.get(g, 0), b.get(g, 0)) for g in {*a, *b}):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return parent, find


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] = "edit"
            i = len(rows)
            rows.append((i, " ".join(own)))
            group[i] = g
    rows += [(1000, rows[0][1]), (1001, rows[0][1].replace(" ", "\n")), (1002, ""), (1003, ""), (1004, None), (1005, "solo"), (1006, "solo"), (1007, "solo two")]
    out = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, find = brute_classes(rows, 0.8)
    assert out == {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def test_residual_pairs_are_settled(spark):
    """A chain in which the bucket's leader is far from its ends: every link between neighbours must survive."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        own = list(words)
        for k in range(i):
            own[(k * 13) % 400] = f"x{k}"
        rows.append((i, " ".join(own)))
    out = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, find = brute_classes(rows, 0.8)
    assert out == {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def test_large_buckets_are_settled(spark):
    """400 documents alike enough to share buckets far over 32, in which each is a near copy of one other only."""
    rng = random.Random(12)
    words, rows = [f"w{i}" for i in range(1500)], []
    for g in range(200):
        at = rng.sample(range(1500), 26)
        for k in range(2):
            own = list(words)
            for i in at[:6] + at[6 + 10 * k : 16 + 10 * k]:
                own[i] = f"x{g}" if i in at[:6] else f"y{g}-{k}"
            rows.append((g + 200 * k, " ".join(own)))
    out = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [g for g in range(200) if out[g] != out[g + 200]] == [] and len(set(out.values())) > 190


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = neardup.classes(docs)
    assert out.count() == len(odd_rows()) and neardup.classes(docs.limit(0)).count() == 0
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids.count((False, 6)) == 1 and (False, 17) not in ids  # repeated rows and the copy of 5 go


def test_near_duplicates_leave_one_table(spark):
    """What led to the classes took disk in all later stages of the pipeline."""
    from pathlib import Path

    from tessaline.storage import own_dir

    tables = lambda: {p.name for p in Path(own_dir(spark).removeprefix("file:")).glob("*")}
    docs = spark.createDataFrame([(i, f"{' '.join(map(str, range(40)))} {i // 2}") for i in range(8)], "doc_id long, text string")
    before = tables()
    kept = neardup.deduplicate(docs)
    assert [x.partition("-")[0] for x in tables() - before] == ["near"]
    assert 1 <= kept.count() <= 4
