"""Which keys do blocks of documents share?

Documents are packed once into blocks of some megabytes, which stay the unit of all later steps. In a step each block sends its
distinct keys, sorted, to buckets of the key space; a bucket answers each block with a bit or a byte for each of its keys, in
the order they came. A block sends a key once, however many of its documents hold it, so a hot key costs a bucket one entry for each
block, and what a block gets back is small and joins it by block number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed
from .common import bounded_batches, keyed

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: What blocks send (kind 0), keep for the next step (kind 1) and get back (kind 2).
SCHEMA = "kind int, block long, bucket int, payload binary"
_ROWS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
Row = tuple[int, int, int, bytes]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


def rows(found: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


class Sizes:
    """Bytes of a block, buckets of the key space and tasks of a step; all follow the input."""

    def __init__(self, docs: DataFrame):
        self.documents, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.block = min(32 << 20, max(2 << 20, size >> 12))
        self.bits = min(17, max(8, (size >> 23).bit_length()))  # a block sends a row to each bucket, so these are large
        self.tasks = min(100_000, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 26))


class Block:
    """The documents of a block: ids (with a mask of null ones) and the bytes of their texts."""

    def __init__(self, payload: bytes):
        import zstandard

        raw = zstandard.decompress(payload)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids, ends = np.frombuffer(raw, "<i8", n, 8), 8 + 17 * n + np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 8 * n))
        self.null = np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(bool)
        starts = [8 + 17 * n, *ends[:-1].tolist()] if n else []
        self.texts = [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]

    @staticmethod
    def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
        import zstandard

        head = [np.array([len(ids)], "<i8"), np.array([i or 0 for i in ids], "<i8"), np.array([len(t) for t in texts], "<i8"), np.array([i is None for i in ids], np.uint8)]
        return zstandard.compress(b"".join([*(h.tobytes() for h in head), *texts]), 3)

    def doc_ids(self) -> list[int | None]:
        return [None if none else i for i, none in zip(self.ids.tolist(), self.null.tolist(), strict=True)]


def blocked(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """``docs`` (doc_id, text) in blocks: a row for each, its number and its packed documents. A block holds a document at least.

    The table is bucketed by the number, so the texts are exchanged once, however many steps read them.
    """
    bounded_batches(docs.sparkSession)
    limit = sizes.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        schema = pa.schema([("block", pa.int64()), ("docs", pa.binary())])
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1]) + 64
                if size >= limit or len(ids) == 65_535:  # a count of its documents fits 16 bits
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([Block.pack(ids, texts)], pa.binary())], schema=schema)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([Block.pack(ids, texts)], pa.binary())], schema=schema)

    return bucketed(keyed(docs, "doc_id", "text", doc_id="long").mapInArrow(run, "block long, docs binary"), "block", sizes.tasks, "blocks")


def distinct(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the least and greatest document of each, and the place of every key among them."""
    o = np.argsort(keys)
    new = np.concatenate([[True], keys[o][1:] != keys[o][:-1]])[: len(o)]
    start, place = np.flatnonzero(new), np.empty(len(o), np.int64)
    place[o] = np.cumsum(new) - 1
    if not len(o):
        return keys, doc, doc, place
    return keys[o][start], np.minimum.reduceat(doc[o], start), np.maximum.reduceat(doc[o], start), place


def state(starts: np.ndarray) -> bytes:
    """Ascending places of a block, to keep for a later step."""
    return np.diff(starts, prepend=0).astype("<u4").tobytes()


def starts_of(table: pa.Table, kind: int = 1) -> np.ndarray:
    parts = [p for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == kind]
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64) for p in parts)])


def slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys, by their upper bits."""
    bucket = (keys >> U64(64 - bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield int(bucket[a]), slice(a, b)


def rests(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below those of the bucket."""
    return ((keys << U64(bits)) >> U64(32)).astype(np.uint32)


def send(block: int, keys: np.ndarray, values: np.ndarray, bits: int) -> Iterator[Row]:
    """Rows for sorted distinct keys and a 16-bit value of each. Of a key, its bucket and the next 32 bits are sent, as differences."""
    rest = rests(keys, bits)
    for bucket, at in slices(keys, bits):
        step = np.diff(rest[at], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
        yield 0, block, bucket, step.tobytes() + values[at].astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def sent(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 6
    planes = np.frombuffer(payload, np.uint8).reshape(6, n)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.uint32), np.ascontiguousarray(planes[4:].T).view("<u2").ravel()


def by_bucket(requests: DataFrame, sizes: Sizes, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``run`` over what all blocks sent to a bucket. The number of tasks is fixed: what they do costs more than what they read."""
    return requests.where("kind = 0").repartition(sizes.tasks, "bucket").groupBy("bucket").applyInArrow(run, SCHEMA)


def answered(requests: DataFrame, sizes: Sizes, answer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A row of kind 2 for each request: the bytes of ``answer(total, count)`` for its keys, in their order.

    ``total`` is the sum of the values that all blocks sent for the key and ``count`` the number of blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        payloads = table.column("payload").to_pylist()
        parts = [sent(p) for p in payloads]
        keys, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        o = np.argsort(keys)
        start = np.flatnonzero(np.concatenate([[True], keys[o][1:] != keys[o][:-1]]))
        count = np.diff([*start, len(o)])
        found = np.empty(len(o), np.uint8)
        found[o] = np.repeat(answer(np.add.reduceat(values[o], start), count), count)
        ends = np.cumsum([len(p[0]) for p in parts])
        out = [(2, block, bucket, found[e - len(p[0]) : e].tobytes()) for block, bucket, e, p in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), ends.tolist(), parts, strict=True)]
        return pa.Table.from_batches([rows(out)])

    return by_bucket(requests, sizes, run)


def reply(table: pa.Table) -> np.ndarray:
    """What a block got back, for its keys in order."""
    got = [r for r in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True) if r[0] == 2]
    return np.frombuffer(b"".join(p for _, _, p in sorted(got, key=lambda r: r[1])), np.uint8)


def each_block(blocks: DataFrame, known: DataFrame, sizes: Sizes, run: Callable[[int, Block, pa.Table], pa.Table], schema) -> DataFrame:
    """``run`` over every block with what is known of it."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.column("block")[0].as_py(), Block(left.column("docs")[0].as_py()), right)

    return blocks.groupBy("block").cogroup(known.repartition(sizes.tasks, "block").groupBy("block")).applyInArrow(both, schema)
