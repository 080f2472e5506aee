"""Suffix-array dedup over bytes by a depth-limited radix sort.

Suffixes are ordered only through the threshold of 50 bytes, by passes from the most significant digit of up to eight bytes down;
after the last pass, groups of equal suffixes are exactly the repeated windows, and a pass leaves out suffixes that already
differ from all others. Which suffixes are sorted together is settled first, across machines, by a digit that equal windows share by
construction: a string of 24 bytes sampled from the window by its content. Windows whose string no other document holds are
left out; the others are sorted by their bytes, within a block of documents where several of its documents hold their string, and the
first of each block then within buckets of their strings. Windows of one document about one occurrence of a string are an entry. Entries
are sorted first, through all their bytes, and the windows of equal ones only once. Where a string has very many entries, its windows
are dealt to buckets one by one. Only bytes decide what is removed; hashes only leave out what cannot repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ..storage import materialise
from .anchors import BYTE, CHUNK, anchors
from .blocks import SCHEMA, U64, Block, Sizes, answered, blocked, by_bucket, distinct, each_block, mix, reply, rows, send, slices, starts_of, state
from .common import keyed

BYTES, GRAM = 50, 24
#: Strings with more entries than this have their windows dealt one by one.
HOT = 16_384
#: What a step sends besides requests (0), state (1) and replies (2): entries to sort, hashes of windows of hot strings and their starts.
ENTRY, WINDOW, LATER = 3, 4, 5
#: Windows that a bucket sorts at once, but for those of one string.
PORTION = 1 << 18


def radix_groups(text: np.ndarray, starts: np.ndarray, depth: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (indices into ``starts``) equal to another through ``depth`` bytes, and their group numbers, in order.

    ``depth`` may differ by suffix; those of different depths are not equal. Each pass sorts the remaining suffixes by group and next
    digit, which has the bytes that the group's number leaves free in 64 bits, and drops those alone.
    """
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(text) + 9,), ">u8", padded, strides=(1,))
    depths, group = np.unique(depth, return_inverse=True)
    left, group, at, count = np.arange(len(starts)), np.broadcast_to(group, len(starts)), 0, len(depths)
    while len(left) and at < depths[-1]:
        taken = (64 - (count - 1).bit_length()) // 8
        beyond = np.maximum(8 - taken, at + 8 - depths).astype(U64)  # bytes of eight that are no part of the digit, by depth
        if len(depths) > 1:
            beyond = beyond[np.searchsorted(depths, depth[left])]
        half = np.minimum(beyond, U64(8)) * U64(4)  # bits, shifted twice: where the depth is reached, all 64 go
        digit = eight[np.minimum(starts[left] + at, len(text))].astype(U64) >> half >> half
        if count > 1:
            digit |= group.astype(U64) << U64(8 * taken)
        o = np.argsort(digit)
        digit = digit[o]
        same = digit[1:] == digit[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        left, group = left[o[several]], np.cumsum(np.concatenate([[True], ~same])[several]) - 1
        at, count = at + taken, int(group[-1]) + 1 if len(group) else 0
    return left, group


def later(text: np.ndarray, first: np.ndarray, more: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Whether a window of a smaller document equals it, for every window of entries (``_windows`` of ``first`` and ``more``).

    Of equal entries only one of the least document has its windows sorted; those of greater documents are all later than its.
    """
    like, alone = np.arange(len(first)), np.ones(len(first), bool)
    left, group = radix_groups(text, first, more + width)
    if len(left):
        o = np.lexsort((doc[left], group))
        left, group = left[o], group[o]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        like[left], alone[left] = left[head][group], head
    own = np.flatnonzero(alone)
    starts, entry = _windows(first[own], more[own])
    left, group = radix_groups(text, starts, width)
    gone = np.zeros(len(starts), bool)
    if len(left):
        doc_of = doc[own[entry[left]]]
        gone[left] = doc_of > np.minimum.reduceat(doc_of, np.flatnonzero(np.diff(group, prepend=-1)))[group]
    at = np.zeros(len(first), np.int64)
    at[own] = np.cumsum(more[own] + 1) - more[own] - 1
    same, entry = _windows(at[like], more)
    return gone[same] | (doc > doc[like])[entry]


class Bytes:
    """The bytes of a block and the anchors of its windows."""

    def __init__(self, block: Block, width: int, gram: int):
        self.data = np.frombuffer(b"".join(block.texts), np.uint8)
        n = np.array([len(t) for t in block.texts], np.int64)
        first, found, pieces, tokens = np.cumsum(n) - n, [], [], 0

        def settle() -> None:
            if pieces:
                g, at, lo, more = anchors([BYTE[self.data[a:b]] for _, a, b in pieces], width, gram)
                found.append((g, np.array([p[0] for p in pieces])[at], np.array([p[1] for p in pieces])[at] + lo, more))
                pieces.clear()

        for i in np.flatnonzero((n >= width) & ~block.null).tolist():
            for at in range(0, int(n[i]) - width + 1, CHUNK):
                pieces.append((i, int(first[i]) + at, int(first[i]) + min(int(n[i]), at + CHUNK + width - 1)))
                tokens += pieces[-1][2] - pieces[-1][1]
                if tokens > CHUNK:
                    settle()
                    tokens = 0
        settle()
        self.gram, row, self.lo, self.more = (np.concatenate(c) if found else np.zeros(0, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 4, (U64, np.int64, np.int64, np.int64), strict=True))
        self.gram = mix(self.gram)  # least hashes are small, so by their own upper bits a few buckets would get most strings
        self.doc = block.ids[row]


def _windows(lo: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of entries, and the entry of each."""
    n = more + 1
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


def _payloads(kind: int, number: int, data: np.ndarray, keys: np.ndarray, bits: int, doc: np.ndarray, lo: np.ndarray, more: np.ndarray, width: int) -> Iterator[tuple]:
    """Rows of entries with their bytes, one for each bucket of their keys; the 16 bits below the bucket's tell entries apart."""
    o = np.argsort(keys, kind="stable")
    raw, below, doc, lo, more = data.tobytes(), ((keys[o] >> U64(48 - bits)) & U64(0xFFFF)).astype("<u2"), doc[o].astype("<i8"), lo[o].astype("<u4"), more[o].astype("<u2")
    for bucket, at in slices(keys[o], bits):
        parts = [raw[a : a + m + width] for a, m in zip(lo[at].tolist(), more[at].tolist(), strict=True)]
        head = [np.array([len(parts)], "<u4"), doc[at], lo[at], more[at], below[at]]
        yield kind, number, bucket, zstandard.compress(b"".join([*(h.tobytes() for h in head), *parts]), 1)


class _Entries:
    """The entries that ``_payloads`` packed: arrays over the buffer, in order of the bits below the bucket's."""

    def __init__(self, payload: bytes, width: int):
        self.raw = zstandard.decompress(payload)
        n = int(np.frombuffer(self.raw, "<u4", 1)[0])
        self.doc, self.lo = np.frombuffer(self.raw, "<i8", n, 4), np.frombuffer(self.raw, "<u4", n, 4 + 8 * n)
        self.more, self.below = np.frombuffer(self.raw, "<u2", n, 4 + 12 * n), np.frombuffer(self.raw, "<u2", n, 4 + 14 * n)
        self.width, self.text = width, 4 + 16 * n

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Documents, starts, further windows and bytes of the entries whose bits are in a range."""
        a, b = np.searchsorted(self.below, [low, high])
        n = self.more[:b].astype(np.int64) + self.width
        begin = self.text + int(n[:a].sum())
        return self.doc[a:b], self.lo[a:b], self.more[a:b], self.raw[begin : begin + int(n[a:].sum())]


def _hashed(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the window at each start, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight, h = np.ndarray((len(data) + 9,), ">u8", padded, strides=(1,)), np.zeros(len(starts), U64)
    for at in range(0, width, 8):
        h = mix(h * U64(0x9E3779B97F4A7C15) + (eight[starts + at].astype(U64) >> U64(8 * max(0, at + 8 - width))))
    return h


def _grams(number: int, block: Block, width: int, gram: int, bits: int) -> list[tuple]:
    own = Bytes(block, width, gram)
    keys, _, _, place = distinct(own.gram, own.doc)
    return list(send(number, keys, np.minimum(np.bincount(place, minlength=len(keys)), 65535), bits))


def _sorter(width: int, gram: int, bits: int):
    """Sorts the windows of a block whose string several of its documents hold, and sends on the first of those whose string other blocks hold."""

    def run(number: int, block: Block, known: pa.Table) -> pa.Table:
        own = Bytes(block, width, gram)
        keys, low, high, place = distinct(own.gram, own.doc)
        got = reply(known)
        far = (got > 0)[place] if len(keys) else np.zeros(0, bool)
        hot = (got > 1)[place] if len(keys) else np.zeros(0, bool)
        near = (low < high)[place] if len(keys) else np.zeros(0, bool)
        entries = np.flatnonzero(far | near)
        starts, entry = _windows(own.lo[entries], own.more[entries])
        gone = np.zeros(len(starts), bool)
        gone[near[entries][entry]] = later(own.data, own.lo[near], own.more[near], own.doc[near], width)
        out = [(1, number, -1, state(np.sort(starts[gone])))]
        stays = np.zeros(len(entries), bool)
        stays[entry[~gone]] = True
        sent = entries[stays & far[entries] & ~hot[entries]]
        out += _payloads(ENTRY, number, own.data, own.gram[sent], bits, own.doc[sent], own.lo[sent], own.more[sent], width)
        if len(single := np.sort(starts[~gone & hot[entries][entry]])):
            keys = distinct(_hashed(own.data, single, width), single)[0]
            out += [(WINDOW, *r[1:]) for r in send(number, keys, np.ones(len(keys), np.uint16), bits)]
            out.append((LATER, number, -1, state(single)))
        return pa.Table.from_batches([rows(out)])

    return run


def _hot(width: int, bits: int):
    """Sends the windows of hot strings whose hash other blocks hold too, one by one."""

    def run(number: int, block: Block, known: pa.Table) -> pa.Table:
        starts, data = starts_of(known, LATER), np.frombuffer(b"".join(block.texts), np.uint8)
        h = _hashed(data, starts, width)
        place = distinct(h, starts)[3]
        keep = (reply(known) > 0)[place] if len(starts) else np.zeros(0, bool)
        starts, h = starts[keep], h[keep]
        row = np.searchsorted(np.cumsum([len(t) for t in block.texts]), starts, "right")
        return pa.Table.from_batches([rows(list(_payloads(ENTRY, number, data, h, bits, block.ids[row], starts, np.zeros(len(starts), np.int64), width)))])

    return run


def _settler(width: int):
    """Sorts the windows that reached a bucket, a portion of their strings at a time: equal windows have equal bits below the bucket's."""

    def settle(table: pa.Table) -> pa.Table:
        blocks = np.array(table.column("block").to_pylist(), np.int64)
        entries = [_Entries(p.as_py(), width) for p in table.column("payload")]
        windows = np.zeros(1 << 16, np.int64)
        for e in entries:
            windows += np.bincount(e.below, e.more.astype(np.int64) + 1, 1 << 16).astype(np.int64)
        # a portion ends with the string that fills it
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(windows) // PORTION, prepend=0)) + 1).tolist(), 1 << 16]
        found = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            doc, lo, more, texts = zip(*(e.between(low, high) for e in entries), strict=True)
            owner = np.repeat(np.arange(len(entries)), [len(d) for d in doc])
            doc, lo, more = np.concatenate(doc), np.concatenate(lo).astype(np.int64), np.concatenate(more).astype(np.int64)
            first = np.cumsum(more + width) - more - width
            starts, entry = _windows(first, more)
            gone = np.flatnonzero(later(np.frombuffer(b"".join(texts), np.uint8), first, more, doc, width))
            entry, starts = entry[gone], starts[gone]
            found.append(owner[entry].astype(U64) << U64(32) | (lo[entry] + starts - first[entry]).astype(U64))
        place = np.concatenate(found)
        found.clear()
        place.sort()
        owner = (place >> U64(32)).astype(np.uint32)
        edges = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
        out = [(1, int(blocks[owner[a]]), -1, state((place[a:b] & U64(0xFFFFFFFF)).astype(np.int64))) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]
        return pa.Table.from_batches([rows(out)])

    return settle


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _finisher(width: int):
    def run(number: int, block: Block, known: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(block.texts), np.uint8)
        edge, starts = np.zeros(len(data) + 1, np.int64), starts_of(known)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        cols, at = ([], [], [], []), 0
        for text in block.texts:
            out = gone[at : at + len(text)]
            n = int(out.sum())
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if n else 0
            kept = data[at : at + len(text)][~out].tobytes() if n else text
            for column, value in zip(cols, (len(text), n, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
            at += len(text)
        return pa.Table.from_arrays([pa.array(block.doc_ids(), pa.int64()), *map(pa.array, cols)], schema=_RESULT) if cols[0] else _RESULT.empty_table()

    return run


def dedup_bytes(docs: DataFrame, width: int = BYTES, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``width`` bytes over it also starts in a document with a smaller doc_id. Strings
    are judged on the input and never cross documents. A null text is empty; a document of null id neither loses bytes nor takes
    them from others; repeated rows of one id leave each other alone, whatever their texts; shorter texts stay whole; other
    columns are ignored and an empty table gives an empty result. A text of any length lies in one block, which one task holds in memory.
    """
    docs = keyed(docs, "doc_id", "text", doc_id="long")
    sizes = Sizes(docs)
    bits = sizes.bits - 1  # strings are spread evenly over them
    blocks = blocked(docs, sizes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                yield rows(_grams(number, Block(packed), width, gram, bits))

    known = materialise(answered(blocks.mapInArrow(first, SCHEMA), sizes, lambda total, count: np.where(count > 1, 1 + (total > HOT), 0).astype(np.uint8)), "open")
    sent = materialise(each_block(blocks, known, sizes, _sorter(width, gram, bits), SCHEMA), "sorted")
    entries = sent.where(f"kind = {ENTRY}")
    if not sent.where(f"kind = {WINDOW}").isEmpty():
        asked = sent.where(f"kind = {WINDOW}").selectExpr("0 AS kind", "block", "bucket", "payload")
        known = answered(asked, sizes, lambda total, count: (count > 1).astype(np.uint8)).unionByName(sent.where(f"kind = {LATER}"))
        entries = entries.unionByName(materialise(each_block(blocks, known, sizes, _hot(width, bits), SCHEMA), "hot"))
    found = by_bucket(entries.selectExpr("0 AS kind", "block", "bucket", "payload"), sizes, _settler(width))
    known = sent.where("kind = 1").unionByName(found)
    return each_block(blocks, known, sizes, _finisher(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
