"""Substring dedup over words by level-wise doubling.

The first level looks at all windows of ``FIRST`` words. Windows that repeat in another document are the candidates of their
level; two overlapping or adjoining candidates make a candidate of twice the length (of ``width`` at last), and only these are looked at on the
next level. It ends when no candidate survives, or with the windows of ``width`` words: a passage that repeats
longer is a union of such windows. On the last level the least document of each window is found, and the window goes from all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import materialise
from .blocks import SCHEMA, U64, Block, Sizes, answered, blocked, by_bucket, distinct, each_block, mix, reply, rows, send, slices, starts_of, state
from .common import keyed
from .words import Windows

WORDS, FIRST = 13, 4
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8")])


def lengths(width: int, first: int) -> list[int]:
    out = [min(first, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def windows128(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows with their least documents, in order, and the place of every window among them."""
    o = np.lexsort((h[1], h[0]))
    a, b = h[0][o], h[1][o]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(o)]
    start, place = np.flatnonzero(new), np.empty(len(o), np.int64)
    place[o] = np.cumsum(new) - 1
    out = np.zeros(len(start), _WINDOW)
    if len(o):
        out["h"], out["g"], out["doc"] = a[start], b[start], np.minimum.reduceat(doc[o], start)
    return out, place


def _sender(steps: list[int], level: int, bits: int):
    """What a block sends on a level: its candidates there, from the candidates before and the replies on them."""

    def run(number: int, block: Block, known: pa.Table | None) -> pa.Table:
        w = Windows(block.texts, ~block.null)
        if level:
            w.grow(steps[level - 1])
            before = starts_of(known) if level > 1 else w.all()
            _, low, high, place = distinct(w.hash[0][before], block.ids[w.doc[before]])
            got = reply(known) if len(low) else np.zeros(0, np.uint8)
            alive = np.zeros(w.hash.shape[1] + 1, bool)
            alive[before] = ((got > 0) | (low < high))[place]
            w.grow(steps[level])
            starts, shift = w.all(), steps[level] - steps[level - 1]
            starts = starts[alive[starts] & alive[starts + shift]]
        else:
            w.grow(steps[0])
            starts = w.all()
        doc, out = block.ids[w.doc[starts]], []
        if level + 1 < len(steps):
            keys, low, high, _ = distinct(w.hash[0][starts], doc)
            out += send(number, keys, (low < high).astype(np.uint16), bits)
        else:
            windows, _ = windows128(w.hash[:, starts], doc)
            out += [(0, number, bucket, windows[at].tobytes()) for bucket, at in slices(windows["h"], bits)]
        if level or len(steps) == 1:
            out.append((1, number, -1, state(starts)))
        return pa.Table.from_batches([rows(out)])

    return run


def _least(table: pa.Table) -> pa.Table:
    """For each window that a block sent, whether another block holds it in a smaller document."""
    parts = [np.frombuffer(p, _WINDOW) for p in table.column("payload").to_pylist()]
    w = np.concatenate(parts)
    o = np.lexsort((w["doc"], w["g"], w["h"]))
    h, g, doc = w["h"][o], w["g"][o], w["doc"][o]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    gone = np.empty(len(o), np.uint8)
    gone[o] = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    ends = np.cumsum([len(p) for p in parts])
    return pa.Table.from_batches([rows([(2, block, bucket, gone[e - len(p) : e].tobytes()) for block, bucket, e, p in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), ends.tolist(), parts, strict=True)])])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _finisher(width: int, first: int):
    def run(number: int, block: Block, known: pa.Table) -> pa.Table:
        words = [t.split() for t in block.texts]
        gone = np.zeros(sum(map(len, words)) + 1, np.int64)
        if len(starts := starts_of(known)):
            w = Windows(block.texts, ~block.null)
            for length in lengths(width, first):
                w.grow(length)
            doc = block.ids[w.doc[starts]]
            windows, place = windows128(w.hash[:, starts], doc)
            out = starts[(reply(known)[place] > 0) | (doc > windows["doc"][place])]
            np.add.at(gone, out, 1)
            np.add.at(gone, out + width, -1)
        gone = np.cumsum(gone[:-1]) > 0
        cols, at = ([], [], []), 0
        for own in words:
            out = gone[at : at + len(own)]
            n = int(out.sum())
            kept = [x for x, g in zip(own, out.tolist(), strict=True) if not g] if n else own
            for column, value in zip(cols, (len(own), n, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                column.append(value)
            at += len(own)
        return pa.Table.from_arrays([pa.array(block.doc_ids(), pa.int64()), *map(pa.array, cols)], schema=_RESULT) if cols[0] else _RESULT.empty_table()

    return run


def dedup_words(docs: DataFrame, width: int = WORDS, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``.

    A word goes if a window of ``width`` consecutive words over it also starts in a document with a smaller doc_id. Windows are
    judged on the input. A null text has no words; a document of null id neither loses words nor takes them from others; repeated
    rows of one id leave each other alone, whatever their texts; texts shorter than a window stay whole; other columns are
    ignored and an empty table gives an empty result. A text of any length lies in one block, which one task holds in memory.
    Equal windows of the last level are told by 128 bits of hash: two chains of bijective mixings over the
    bytes of a word and over the halves of a window.
    """
    docs = keyed(docs, "doc_id", "text", doc_id="long")
    sizes, steps = Sizes(docs), lengths(width, first)
    blocks, known = blocked(docs, sizes), None
    for level in range(len(steps)):
        step = _sender(steps, level, sizes.bits)
        if known is None:

            def alone(batches, step=step):
                for batch in batches:
                    for number, packed in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                        yield from step(number, Block(packed), None).to_batches()

            asked = blocks.mapInArrow(alone, SCHEMA)
        else:
            asked = each_block(blocks, known, sizes, step, SCHEMA)
        if level or len(steps) == 1:  # read twice: its requests and its state
            asked = materialise(asked, f"level{level}")
        if level + 1 < len(steps):
            known = answered(asked, sizes, lambda total, count: ((total > 0) | (count > 1)).astype(np.uint8))
        else:
            known = by_bucket(asked, sizes, _least)
        known = materialise(asked.where("kind = 1").unionByName(known) if level or len(steps) == 1 else known, f"known{level}")
        if known.where("kind = 2").isEmpty():  # no candidate survives
            known = known.where("kind < 0")
            break
    return each_block(blocks, known, sizes, _finisher(width, first), "doc_id long, n_words long, n_removed long, kept_sha256 string")
