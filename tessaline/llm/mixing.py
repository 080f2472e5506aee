"""Mixing sources to target weights as a proportionate-fair schedule, in DataFrame operations alone.

Weights become whole numbers of slots out of a period, their common denominator. Block k of a source with m slots in a period of L is released at slot
floor((k - 1) L / m) and due by ceil(k L / m); in each slot the released block with the earliest deadline runs. Such a
schedule keeps every source within one block of its share at any slot, and it repeats after a period, so one period is
simulated and every block of every source is placed by arithmetic. Of a long period only the slots that hold documents are
simulated, on the driver.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .common import fresh

#: Documents that a bucket of a source is meant to hold; a source is ranked bucket by bucket.
BUCKET_ROWS = 50_000
#: Longest period that is simulated by a fold in a single row, and longest period at all.
FOLDED, LONGEST = 2048, 1 << 20
#: Sources come with weights that the caller writes down; more than this are refused.
SOURCES = 10_000


def exact_quotas(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The least whole numbers in the proportions of positive weights, as these are written in decimals; they sum to the period."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    return {s: m // common for s, m in whole.items()}


def first_slots(share: dict[str | None, int], period: int, slots: int) -> list[tuple[str | None, int, int]]:
    """``(source, nth, slot)`` of the first slots of a period, as ``one_period`` places them."""
    names = sorted(share, key=lambda s: (s is None, s))
    waiting, ready, placed, out = [(0, i) for i in range(len(names))], [], [0] * len(names), []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(placed[i] + 1) * period // share[names[i]]), i))
        if ready:
            i = heapq.heappop(ready)[1]
            out.append((names[i], placed[i], t))
            placed[i] += 1
            heapq.heappush(waiting, (placed[i] * period // share[names[i]], i))
    return out


def quotas(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Slots of a period by the largest remainder, at least one for each source."""
    names = sorted(weights, key=lambda s: (s is None, s))
    total = sum(weights.values())
    spare = period - len(names)
    exact = {s: weights[s] / total * period for s in names}
    out = {s: 1 + int(max(exact[s] - 1, 0)) for s in names}
    left = period - sum(out.values())
    assert spare >= 0, "a period has at least a slot for each source"
    for s in sorted(names, key=lambda s: (out[s] - exact[s], names.index(s)))[: max(left, 0)]:
        out[s] += 1
    while sum(out.values()) > period:  # the least sources were raised to one slot
        out[max(names, key=lambda s: (out[s] - exact[s] if out[s] > 1 else float("-inf"), -names.index(s)))] -= 1
    return out


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, laid out in the order of their schedule: partition by partition, row by row."""
    names = fresh(docs, "mix_block", "mix_slot", "mix_position")
    placed, size = _placed(docs, names, **options)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 26)
    order = (F.col(names[2]), F.col("doc_id"))
    return placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_period(slots: DataFrame, period: int) -> DataFrame:
    """``(source, nth, slot)`` of a period from ``(source, m)``: earliest deadline first among the released blocks.

    The state is an array of the sources' quotas and placed blocks; the fold over the slots of one period is a single row,
    as large as the period.
    """
    state = slots.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "m"))).alias("s"))
    step = f"""
      aggregate(sequence(0, {period - 1}), named_struct('placed', transform(s, x -> 0), 'order', cast(array() as array<int>)),
        (acc, t) -> transform(array(
          array_min(filter(transform(s, (x, i) -> named_struct(
              'due', if(acc.placed[i] < x.m and acc.placed[i] * {period} div x.m <= t, cast(ceil((acc.placed[i] + 1) * {period} / x.m) as bigint), null), 'i', i)),
            y -> y.due is not null)).i),
          chosen -> named_struct('placed', transform(acc.placed, (p, i) -> if(i <=> chosen, p + 1, p)), 'order', concat(acc.order, array(coalesce(chosen, -1)))))[0],
        acc -> acc.order)"""
    flat = state.where("size(s) > 0").select("s", F.posexplode(F.expr(step)).alias("slot", "i")).where("i >= 0").select(F.expr("s[i].source").alias("source"), F.col("slot").cast("long").alias("slot"))
    return flat.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1)


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = 16, period: int | None = None) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_slot`` and ``mix_position``; every row is kept.

    Documents of a source come in the order of a hash of id and text, in blocks of ``block_docs``. ``weights`` names the
    target share of each source; sources it leaves out, and all without it, weigh 1. Once a source has run out its slots stay empty,
    and the others keep their own. ``mix_position`` orders rows by slot and place in the block, gaps included. A null source is a
    source of its own; null ids and texts, however long, are hashed as such; repeated rows tie and take neighbouring places; columns of
    the three names give way and all others are carried along; an empty table stays empty. The schedule follows the exact
    weights, unless ``period`` asks for shares rounded to so many slots (at least twice the number of sources), a weight is not
    positive (such a source gets one slot of 1,024), or the weights' common denominator exceeds ``LONGEST`` slots (then they are rounded to
    that). More than ``SOURCES`` sources are an error.
    """
    names = ["mix_block", "mix_slot", "mix_position"]
    return _placed(docs.drop(*(c for c in docs.columns if c.lower() in names)), names, weights, block_docs, period)[0]


def _placed(docs: DataFrame, names: list[str], weights: dict[str | None, float] | None = None, block_docs: int = 16, period: int | None = None) -> tuple[DataFrame, int]:
    """``docs`` with the three columns in the given names, which it has not, and the bytes of its texts."""
    block, slot, position = names
    skey, hash_, bucket, before, nth, m, within, at = fresh(docs.withColumns({n: F.lit(0) for n in names}), "skey", "hash", "bucket", "before", "nth", "m", "within", "at")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # of a null source: empty
    rows = docs.withColumns({skey: key, hash_: F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))})
    found = docs.groupBy(F.col("source").cast("string").alias("s")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    if not found:
        return docs.withColumns({c: F.lit(None).cast("long") for c in names}), 0
    sizes, size = {r["s"]: r["n"] for r in found}, sum(r["b"] for r in found)
    weighs = {s: (weights or {}).get(s, 1.0) for s in sizes}
    share = exact_quotas(weighs) if period is None and min(weighs.values()) > 0 else None
    if share is not None and sum(share.values()) <= LONGEST:
        period = sum(share.values())
    else:
        period = period or (1024 if share is None else LONGEST)
        while period < 2 * len(sizes):
            period *= 2
        share = quotas(weighs, period)
    spark = docs.sparkSession
    folded = period <= FOLDED
    if not folded:  # up to the slot by which each source's last block is due
        used = min(period, max(-(-(-(-n // block_docs)) * period // share[s]) for s, n in sizes.items()))
        plan = spark.createDataFrame(first_slots(share, period, used), "source string, nth long, slot long")
    quota = spark.createDataFrame([(s, int(k)) for s, k in share.items()], "source string, m long")
    plan = (materialise(one_period(quota, period), "period") if folded else plan).join(quota.withColumnRenamed("source", "_q"), F.col("source").eqNullSafe(F.col("_q")))
    slots = plan.select(key.alias(skey), F.col("m").alias(m), F.col("nth").alias(within), F.col("slot").alias(at))

    buckets = max(64, -(-sum(sizes.values()) // BUCKET_ROWS) * 4)
    rows = rows.withColumn(bucket, F.expr(f"pmod(shiftrightunsigned(`{hash_}`, 8), {buckets}L)"))
    counts = rows.groupBy(skey, bucket).agg(F.count("*").alias("n"))
    above = Window.partitionBy(skey).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(skey, bucket, F.coalesce(F.sum("n").over(above), F.lit(0)).alias(before))
    rank = F.row_number().over(Window.partitionBy(skey, bucket).orderBy(hash_, "doc_id")) - 1
    ranked = rows.withColumn(nth, rank.cast("long")).join(counts, [skey, bucket])  # both sides already lie by these keys
    ranked = ranked.withColumn(nth, F.col(nth) + F.col(before)).withColumn(block, F.expr(f"`{nth}` div {block_docs}"))
    # the two tables of a folded period have at most ``FOLDED`` rows
    small = F.broadcast if folded else lambda table: table
    ranked = ranked.join(small(slots.select(skey, m).distinct()), skey).withColumn(within, F.col(block) % F.col(m))
    placed = ranked.join(small(slots.drop(m)), [skey, within])
    placed = placed.withColumn(slot, F.expr(f"(`{block}` div `{m}`) * {period} + `{at}`"))
    placed = placed.withColumn(position, F.col(slot) * block_docs + F.col(nth) % block_docs)
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), *names), size
