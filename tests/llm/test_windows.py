"""Substring and suffix-array dedup against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessaline.llm import anchors, blocks, substring, suffix
from tessaline.llm.words import Windows

from .cases import odd_docs, odd_rows

SCHEMA = "doc_id long, text string"


def removed(tokens, width):
    """Per row of (doc_id, tokens): the indices covered by windows that start in a smaller document."""
    first = {}
    for doc_id, own in tokens:
        for i in range(len(own) - width + 1) if doc_id is not None else ():
            key = tuple(own[i : i + width])
            first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, own in tokens:
        gone = set()
        for i in range(len(own) - width + 1) if doc_id is not None else ():
            if first[tuple(own[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        yield gone


def brute_words(rows, width=13):
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for (d, own), gone in zip(tokens, removed(tokens, width), strict=True):
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        yield d, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def brute_bytes(rows, width=50):
    tokens = [(d, (t or "").encode()) for d, t in rows]
    for (d, own), gone in zip(tokens, removed(tokens, width), strict=True):
        kept = bytes(b for i, b in enumerate(own) if i not in gone)
        yield d, len(own), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()


def corpora(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "c", "dé", "e"] if seed % 2 else [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(-5, 400), 60):
        own = []
        for _ in range(rng.randrange(5)):
            own += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(1, 40))]
        if own and rng.random() < 0.3:
            own[rng.randrange(len(own))] = "edit"
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(own)))
    rows += rng.choices(rows, k=5) + [(rows[0][0], rows[1][1]), (rows[2][0], rows[3][1] + " x"), (None, rows[4][1]), (None, None), (500, None), (501, "")]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rows = corpora(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(str, map(tuple, substring.dedup_words(df).collect()))) == sorted(map(str, brute_words(rows)))
    assert sorted(map(str, map(tuple, suffix.dedup_bytes(df).collect()))) == sorted(map(str, brute_bytes(rows)))


def test_anchors_cover_every_window():
    rng = np.random.default_rng(3)
    pieces = [anchors.BYTE[rng.integers(0, 3, n)] for n in (0, 10, 49, 50, 51, 400, 7, 1000)]
    _, piece, lo, more = anchors.anchors(pieces, 50, 24)
    seen = sorted((p, s) for p, a, m in zip(piece.tolist(), lo.tolist(), more.tolist(), strict=True) for s in range(a, a + m + 1))
    assert seen == [(i, s) for i, p in enumerate(pieces) for s in range(len(p) - 49)]


def test_radix_groups():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 500).astype(np.uint8)
    starts = rng.permutation(480)
    for depth in (3, 8, 11, 16):
        left, group = suffix.radix_groups(text, starts, depth)
        by = {}
        for i, s in enumerate(starts):
            by.setdefault(bytes(text[s : s + depth]), set()).add(i)
        assert sorted(map(sorted, (set(left[group == g].tolist()) for g in np.unique(group)))) == sorted(sorted(g) for g in by.values() if len(g) > 1)


def test_radix_groups_of_several_depths():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    for n, high in ((0, 2), (1, 30), (300, 3), (300, 30)):
        starts, depth = rng.integers(0, 370, n), rng.integers(1, high, n)
        starts[: n // 10], depth[: n // 10] = 400 - depth[: n // 10], depth[: n // 10]  # these end with the text
        left, group = suffix.radix_groups(text, starts, depth)
        by = {}
        for i, (s, d) in enumerate(zip(starts.tolist(), depth.tolist(), strict=True)):
            by.setdefault(bytes(text[s : s + d]), set()).add(i)
        assert sorted(sorted(left[group == g].tolist()) for g in np.unique(group)) == sorted(sorted(g) for g in by.values() if len(g) > 1)


def counted(monkeypatch):
    """The numbers of suffixes that are sorted from now on."""
    sizes, sort = [], suffix.radix_groups
    monkeypatch.setattr(suffix, "radix_groups", lambda text, starts, depth: (sizes.append(len(starts)), sort(text, starts, depth))[1])
    return sizes


def in_block(rows, answer):
    """The windows found in a block when each of its strings gets the same answer."""
    block = blocks.Block(blocks.Block.pack([r[0] for r in rows], [r[1] for r in rows]))
    strings = len(set(suffix.Bytes(block, 50, 24).gram.tolist()))
    out = suffix._sorter(50, 24, 8)(0, block, pa.Table.from_batches([blocks.rows([(2, 0, 0, bytes([answer]) * strings)])]))
    return blocks.starts_of(out).tolist(), out


def test_windows_of_equal_entries_are_sorted_once(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(1500))
    rows = [(i, text) for i in rng.sample(range(100), 40)] + [(7, text), (101, b"+" + text[300:420] + b"+")]
    tokens, ends = [(i, t) for i, t in rows], np.cumsum([len(t) for _, t in rows])
    least = min(i for i, _ in rows)
    sizes = counted(monkeypatch)
    found, out = in_block(rows, 0)
    expected = [int(e) - len(t) + s for (i, t), e in zip(tokens, ends, strict=True) for s in range(len(t) - 49) if i > least and b"+" not in t[s : s + 50]]
    assert found == expected
    assert sum(sizes) < 10_000  # of 60,000 windows
    # a bucket gets the entries of three blocks
    _, out = in_block([(50, text)], 1)
    sent = [r for r in zip(*out.to_pydict().values(), strict=True) if r[0] == suffix.ENTRY]
    later = [r for r in zip(*in_block([(60, text)], 1)[1].to_pydict().values(), strict=True) if r[0] == suffix.ENTRY]
    sizes.clear()
    got = {0: [], 1: [], 2: []}
    for bucket in {r[2] for r in sent}:
        own = [(0, number, b, p) for number, of in ((0, later), (1, sent), (2, later)) for _, _, b, p in of if b == bucket]
        for _, number, _, p in zip(*suffix._settler(50)(pa.Table.from_batches([blocks.rows(own)])).to_pydict().values(), strict=True):
            got[number] += np.cumsum(np.frombuffer(p, "<u4")).tolist()
    assert {k: sorted(v) for k, v in got.items()} == {0: [*range(1451)], 1: [], 2: [*range(1451)]}
    assert sum(sizes) < 2_200  # of 4,353 windows


def test_a_block_leaves_strings_of_one_document_to_buckets(monkeypatch):
    rng = random.Random(9)
    rows = [(i, bytes(rng.choice(b"abcdefgh") for _ in range(400)) * 2) for i in range(10)]
    sizes = counted(monkeypatch)
    found, out = in_block(rows, 1)
    assert found == [] and sum(sizes) == 0 and suffix.ENTRY in out.column("kind").to_pylist()


def test_hot_strings_are_dealt_by_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "PORTION", 8)
    rng = random.Random(21)
    line = "this very line of over fifty bytes stands in every document of the table; "
    rows = [(i, f"{rng.random()}" * rng.randrange(3) + line * rng.randrange(1, 3) + f"{rng.randrange(4)}" * 40) for i in rng.sample(range(300), 120)]
    got = suffix.dedup_bytes(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_bytes(rows)))


def test_odd_rows(spark):
    docs, rows = odd_docs(spark), [(r[0], r[1]) for r in odd_rows()]
    assert sorted(map(str, map(tuple, substring.dedup_words(docs).collect()))) == sorted(map(str, brute_words(rows)))
    assert sorted(map(str, map(tuple, suffix.dedup_bytes(docs).collect()))) == sorted(map(str, brute_bytes(rows)))
    assert substring.dedup_words(docs.limit(0)).count() == 0 and suffix.dedup_bytes(docs.limit(0)).count() == 0


def test_documents_longer_than_a_chunk(spark):
    """Pieces of long documents overlap by a window less one, so nothing is lost or doubled at their seams."""
    rng = np.random.default_rng(4)
    letters = bytes(rng.integers(97, 123, 600_000, dtype=np.uint8)).decode()
    rows = [(1, letters), (2, "0" * 60 + letters[100_000:500_000] + "1" * 60), (3, letters[262_000:262_300])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.dedup_bytes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, 0), 2: (400_000, 1), 3: (300, 1)}
    words = [f"{a}" for a in rng.integers(0, 1 << 40, 560_000)]
    rows = [(5, " ".join(words)), (7, "x " + " ".join(words[200_000:540_000]) + " y")]
    got = {r.doc_id: r.n_removed for r in substring.dedup_words(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: 0, 7: 340_000}


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_defeat_polynomial_hashes(spark):
    """Thue-Morse words and their complements collide under any polynomial modulo a power of two."""
    head = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*head, thue_morse(1024)])), (2, " ".join([*head, thue_morse(1024, 1)])), (3, " ".join([*head, thue_morse(1024)]))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring.dedup_words(df).collect()} == {1: 0, 2: 0, 3: 13}
    assert sorted(map(str, map(tuple, suffix.dedup_bytes(df).collect()))) == sorted(map(str, brute_bytes(rows)))


def test_word_hashes_tell_words_apart():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.randrange(1, 90))) for _ in range(3000)] + [b"a" * n for n in range(1, 100)] + [b"a" * 1_000_000]
    w = Windows([b" \t".join(words), b"", b"\x0b".join(reversed(words))])
    own = [tuple(h) for h in w.hash.T.tolist()]
    assert len(set(zip(own[: len(words)], words, strict=True))) == len(set(words)) == len(set(own)) and own == own[::-1]
    assert w.doc.tolist() == [0] * len(words) + [2] * len(words)


@pytest.mark.parametrize("width, first", [(13, 1), (13, 13), (8, 4), (5, 2), (1, 1), (3, 4)])
def test_levels_of_other_lengths(spark, width, first):
    rows = corpora(width)
    got = substring.dedup_words(spark.createDataFrame(rows, SCHEMA).repartition(4), width, first).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_words(rows, width)))
    assert substring.lengths(13, 4) == [4, 8, 13]
