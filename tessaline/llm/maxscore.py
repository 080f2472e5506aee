"""Exact top-k inner products by MaxScore.

Each dimension is a term. Within a shard a component is shifted to the side of its range that is worst for the query, so
contributions are never negative and a term's bound is its weight times the range. Terms are split by bounds: while those of
the non-essential ones together cannot lift a candidate over the k-th best score, only essential postings are traversed; the others are
probed in groups of terms, for the candidates that remain competitive. Shards then merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard, queries of a block, candidates before the first threshold and terms of a probe.
SHARD, BLOCK, FIRST, PROBE = 8192, 4096, 256, 8


def matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def search(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int, prepared: tuple | None = None) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of one shard, whose ids ascend; ties go to the smaller id, and the query's own id is left out."""
    low, high, columns, kind = prepared or prepare(vectors, np.abs(query).max(initial=0))
    weight = np.abs(query)
    bound = weight * (high - low)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]  # terms that tell no candidates apart have no postings
    base = int((query * np.where(query > 0, low, high)).sum())
    signed, offset = query.astype(kind), (-query * np.where(query > 0, low, high)).astype(kind)
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from here on can add at most
    best_id, best = np.zeros(0, np.int64), np.zeros(0, kind)
    threshold = -1  # every contribution is at least 0
    at, n = 0, len(ids)
    while at < n:
        end = min(n, at + FIRST if at == 0 else n)
        left, score = np.arange(at, end), np.zeros(end - at, kind)
        done = max(int(np.searchsorted(-rest, -threshold, "left")) if threshold >= 0 else len(order), min(PROBE, len(order)))  # essential terms
        terms = order[:done]
        if len(terms):
            score = signed[terms] @ columns[terms, at:end] + offset[terms].sum()
        while True:
            keep = score + rest[done] > threshold  # ids ascend, so a tie with the k-th best loses
            left, score = left[keep], score[keep]
            if done == len(order) or not len(left):
                break
            terms = order[done : done + PROBE]
            score = score + signed[terms] @ columns[np.ix_(terms, left)] + offset[terms].sum()
            done += len(terms)
        own = ids[left] != query_id
        best_id, best = np.concatenate([best_id, ids[left][own]]), np.concatenate([best, score[own]])
        top = np.lexsort((best_id, -best))[:k]
        best_id, best = best_id[top], best[top]
        if len(best) == k:
            threshold = best[-1]
        at = end
    return [(int(i), int(s) + base) for i, s in zip(best_id, best, strict=True)]


def prepare(vectors: np.ndarray, largest: int) -> tuple:
    """Ranges, columns and number type of a shard: doubles where every sum is exact in them, else 64-bit integers."""
    low, high = vectors.min(0), vectors.max(0)
    most = int(largest) * int(np.abs(vectors).max(initial=0)) * 2 * max(vectors.shape[1], 1)
    if most >= 1 << 62:
        raise OverflowError("scores do not fit 64 bits")
    kind = np.float64 if most < 1 << 52 else np.int64
    return low, high, np.ascontiguousarray(vectors.T).astype(kind), kind


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each row whose vec_id ``every`` divides.

    Components become floor(scale * x). Vectors that are null or hold a null or a component that is not finite, and null ids,
    take no part; shorter vectors count as padded with zeros; a row never answers a query of its own id; repeated rows
    are candidates each, ranked one after another, and ask once; one id with several vectors asks with each; other columns are ignored and an empty table gives an
    empty result. Scores beyond 64 bits are an error. Queries meet shards in blocks, so what a task holds is a shard and a block of queries.
    """
    ok = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("c"))
    n = rows.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n // (every * BLOCK)))
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    place = F.xxhash64("vec_id", "c")
    left = rows.select("vec_id", "c", F.pmod(place, F.lit(shards)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("h"))
    right = queries.select("vec_id", "c", place.alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("g"), F.pmod(place, F.lit(blocks)).cast("int").alias("h"))

    schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if len(shard) and len(block):
            ids, lists = shard.column("vec_id").to_numpy(), shard.column("c").to_pylist()
            asked, wanted = list(zip(block.column("vec_id").to_pylist(), block.column("q").to_pylist(), strict=True)), block.column("c").to_pylist()
            width = max(map(len, [*lists, *wanted]))
            order = np.argsort(ids, kind="stable")
            ids, vectors, wanted = ids[order], matrix(lists, width)[order], matrix(wanted, width)
            ready = prepare(vectors, int(np.abs(wanted).max(initial=0)))
            for q, c in zip(asked, wanted, strict=True):
                out += [(*q, i, s) for i, s in search(ids, vectors, q[0], c, k, ready)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=schema)

    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(run, "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
