"""Clusters of members: components, greedy set cover, reassignment, merging, ranking and what families share."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .graph import connected_components


def component_clusters(pairs: DataFrame, query: str = "query", target: str = "target", all_inputs: DataFrame | None = None) -> DataFrame:
    """(cluster_rep, cluster_member) of connected pairs; the least member represents. Inputs never seen stand alone."""
    out = connected_components(pairs, query, target).select(F.col("component").alias("cluster_rep"), F.col("node").alias("cluster_member"))
    if all_inputs is not None:
        alone = all_inputs.select(F.col(all_inputs.columns[0]).alias("cluster_member")).distinct().join(out, "cluster_member", "left_anti")
        out = out.unionByName(alone.select(F.col("cluster_member").alias("cluster_rep"), "cluster_member"))
    return out


def graph_diagnostics(pairs: DataFrame, query: str = "query", target: str = "target") -> DataFrame:
    """One row: pairs, self pairs, other pairs, members, and members seen only with themselves."""
    p = pairs.select(F.col(query).alias("q"), F.col(target).alias("t"))
    seen = p.select(F.col("q").alias("m"), (F.col("q") != F.col("t")).alias("o")).unionByName(p.select(F.col("t").alias("m"), (F.col("q") != F.col("t")).alias("o"))).groupBy("m").agg(F.bool_or("o").alias("o"))
    counts = p.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("q") == F.col("t")).alias("n_self"), F.count_if(F.col("q") != F.col("t")).alias("n_other"))
    return counts.crossJoin(seen.agg(F.count("*").alias("n_members"), F.count_if(~F.col("o")).alias("n_only_self")))


def top_degrees(pairs: DataFrame, query: str = "query", target: str = "target", n: int = 10) -> DataFrame:
    """The members with most distinct neighbours: a report."""
    e = pairs.select(F.col(query).alias("a"), F.col(target).alias("b")).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("a").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "a").limit(n).select(F.col("a").alias("member"), "degree")


def best_scores(pairs: DataFrame, query: str = "query", target: str = "target", score: str = "alntmscore") -> DataFrame:
    """(a, b, score) of unordered pairs, a before b, by their best score in either direction."""
    p = pairs.where(F.col(query) != F.col(target))
    return p.groupBy(F.least(query, target).alias("a"), F.greatest(query, target).alias("b")).agg(F.max(F.col(score).cast("double")).alias("score"))


#: Pairs that are covered in one task without asking for components, and about as many as tasks get when whole components are dealt.
ALONE, SHARE = 8_000_000, 2_000_000
#: Names that one task links to components, in arrays of 16 bytes a name at most.
TASK_NAMES = 50_000_000
_CHUNK = 1 << 20


def _cover(first: array, hoods: array) -> np.ndarray:
    """The representative of each member by greedy set cover; member i has the distinct neighbours hoods[first[i]:first[i + 1]].

    Counts only fall, so whoever will be picked at the greatest count has it when the first of them is: a level is one pass in the
    order of members. Levels are taken down to half of the greatest count at a time, so only members above that are looked at.
    """
    # arrays for single members, seen as numpy for all at once
    size, rep = array("i", [0]) * (len(first) - 1), array("i", [-1]) * (len(first) - 1)
    sizes, reps = np.frombuffer(size, np.int32), np.frombuffer(rep, np.int32)
    starts = np.frombuffer(first, np.int64)
    sizes[:] = starts[1:] - starts[:-1] + 1
    while len(left := np.flatnonzero(reps < 0)):
        floor = int(sizes[left].max()) // 2
        if not floor:  # no links are left
            reps[left] = left
            break
        ahead = left[sizes[left] > floor]
        del left
        while len(ahead):
            most = int(sizes[ahead].max())
            for m in ahead[sizes[ahead] == most].tolist():
                if rep[m] >= 0 or size[m] != most:
                    continue
                claimed = [m, *(x for x in hoods[first[m] : first[m + 1]] if rep[x] < 0)]
                for c in claimed:
                    rep[c] = m
                    for x in hoods[first[c] : first[c + 1]]:
                        size[x] -= 1
            ahead = ahead[(reps[ahead] < 0) & (sizes[ahead] > floor)]
    return reps


def cover(members: list, neighbours: dict) -> dict:
    """Greedy set cover: the member with most unclaimed neighbours (itself counted) claims them, the least of equals first."""
    names = sorted(members)
    index = {m: i for i, m in enumerate(names)}
    near = [[index[x] for x in neighbours.get(m, ())] for m in names]
    rep = _cover(array("q", np.cumsum([0, *map(len, near)]).tolist()), array("i", [x for hood in near for x in hood]))
    return {m: names[r] for m, r in zip(names, rep.tolist(), strict=True)}


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The columns a and b of the batches, many rows at a time."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            n += batch.num_rows
        if n >= _CHUNK or batch is None and n:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0


def cover_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster_rep, cluster_member) by greedy set cover of distinct pairs (a, b) of whole numbers from 0 on, below 2^31.

    Pairs are kept in a temporary file of the task while they are counted and numbered anew, so that only the lists of neighbours
    (8 bytes a pair) and the members are held.
    """
    with TemporaryFile() as spool:
        seen, n = np.zeros(0, bool), 0
        for a, b in _chunks(batches):
            if (top := int(max(a.max(), b.max()))) >= len(seen):
                seen = np.concatenate([seen, np.zeros(max(top + 1, 2 * len(seen)) - len(seen), bool)])
            seen[a] = seen[b] = True
            spool.write(np.stack([a, b], 1).astype(np.int32).tobytes())
            n += len(a)
        if not n:
            return
        spool.flush()
        names = np.flatnonzero(seen).astype(np.int32)
        index = np.cumsum(seen, dtype=np.int32)  # of the next name
        del seen

        def links() -> Iterator[np.ndarray]:
            """(end, other end) in both directions, by the first."""
            spool.seek(0)
            while size := len(part := np.frombuffer(spool.read(8 * _CHUNK), np.int32)):
                ab = (index[part] - 1).reshape(size // 2, 2)
                ends, others = np.concatenate([ab[:, 0], ab[:, 1]]), np.concatenate([ab[:, 1], ab[:, 0]])
                order = np.argsort(ends, kind="stable")
                yield ends[order], others[order]

        first, hoods = array("q", [0]) * (len(names) + 1), array("i", [0]) * (2 * n)
        starts, near = np.frombuffer(first, np.int64), np.frombuffer(hoods, np.int32)
        for ends, _ in links():
            np.add.at(starts, ends + 1, np.int64(1))
        np.cumsum(starts, out=starts)
        for ends, others in links():  # first[i] moves on to first[i + 1] as the neighbours of i are placed
            runs = np.flatnonzero(np.diff(ends, prepend=-1))
            lengths = np.diff(runs, append=len(ends))
            near[starts[ends] + np.arange(len(ends)) - np.repeat(runs, lengths)] = others
            starts[ends[runs]] += lengths
        starts[1:] = starts[:-1].copy()
        starts[0] = 0
        del index
    rep = _cover(first, hoods)
    del starts, near, first, hoods
    for i in range(0, len(names), _CHUNK // 16):
        member = slice(i, i + _CHUNK // 16)
        yield pa.RecordBatch.from_pydict({"cluster_rep": names[rep[member]].astype(np.int64), "cluster_member": names[member].astype(np.int64)})


def _link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Links the trees of a and b in ``root``, which has a name at or below it, in the same component, for every name."""
    while len(a):
        ends = []
        for x in (a, b):
            r = root[x]
            while ((up := root[r]) != r).any():
                r = up
            root[x] = r
            ends.append(r)
        apart = ends[0] != ends[1]
        a, b = np.minimum(*ends)[apart], np.maximum(*ends)[apart]
        np.minimum.at(root, b, a)
        while ((up := root[root[b]]) != root[b]).any():
            root[b] = up


def bin_pairs(batches: Iterable[pa.RecordBatch], names: int, share: int, most: int) -> Iterator[pa.RecordBatch]:
    """(a, bin) for every a of the pairs (a, b), numbers below ``names``: whole components, about ``share`` pairs a bin.

    Bins are numbered from 0 and hold less than twice the share, or a single component of up to ``most`` pairs; larger components get
    -1. Only names are held, not pairs.
    """
    root, count = np.arange(names, dtype=np.int32), np.zeros(names, np.int32)
    for a, b in _chunks(batches):
        np.add.at(count, a, np.int32(1))
        _link(root, a.astype(np.int32), b.astype(np.int32))
    while ((up := root[root]) != root).any():
        root = up
    total = np.zeros(names, np.int64)
    np.add.at(total, root, count)
    tops = np.flatnonzero(total)
    size = total[tops]
    few, own = size <= min(share, most), (size > share) & (size <= most)
    bins = np.full(len(tops), -1, np.int64)
    bins[few] = (np.cumsum(size[few]) - size[few]) // max(1, share)
    bins[own] = np.arange(own.sum()) + bins.max(initial=-1) + 1
    total[tops] = bins
    a = np.flatnonzero(count)
    for i in range(0, len(a), _CHUNK // 16):
        part = a[i : i + _CHUNK // 16]
        yield pa.RecordBatch.from_pydict({"a": part, "bin": total[root[part]]})


def _pick(open_pairs: DataFrame) -> DataFrame:
    """(cluster_rep, cluster_member) of every pick that the greedy cover is sure to make from here on.

    Counts only fall, and a pick changes counts at most two steps away, so a member ahead of all others within two steps is
    picked before any of them. Such picks are over two steps apart and claim different members.
    """
    both = open_pairs.unionByName(open_pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg((-F.count("*") - 1).alias("s")).select("a", F.struct("s", F.col("a").alias("m")).alias("best"))
    near = first
    for _ in range(2):
        offers = both.join(near.select(F.col("a").alias("b"), "best"), "b").select("a", "best")
        near = materialise(offers.unionByName(near).groupBy("a").agg(F.min("best").alias("best")), "ahead")
    reps = near.where(F.col("best.m") == F.col("a")).select("a")
    claimed = both.join(reps, "a").select(F.col("a").alias("cluster_rep"), F.col("b").alias("cluster_member"))
    return claimed.unionByName(reps.select(F.col("a").alias("cluster_rep"), F.col("a").alias("cluster_member")))


def _bins(pairs: DataFrame, n: int, names: int, task_pairs: int) -> DataFrame:
    """(a, bin) for every a of ``n`` pairs, as by ``bin_pairs``; of more names than a task links, components are found by joins."""
    share = min(SHARE, task_pairs)
    if names <= TASK_NAMES:
        return materialise(pairs.coalesce(1).mapInArrow(lambda batches: bin_pairs(batches, names, share, task_pairs), "a long, bin long"), "bins")
    comp = connected_components(pairs, "a", "b").withColumnRenamed("node", "a")
    linked = materialise(pairs.groupBy("a").agg(F.count("*").alias("n")).join(comp, "a"), "linked")
    sizes = materialise(linked.groupBy("component").agg(F.sum("n").alias("n")), "sizes")
    few = -(-n // max(1, share))
    # at most n / share components have a bin of their own
    own = sizes.where((F.col("n") > share) & (F.col("n") <= task_pairs)).select("component", (F.row_number().over(Window.orderBy("component")) - 1 + few).alias("own"))
    dealt = sizes.join(own, "component", "left").select("component", F.when(F.col("n") > task_pairs, -1).otherwise(F.coalesce("own", F.pmod(F.xxhash64("component"), F.lit(few)))).cast("long").alias("bin"))
    return materialise(linked.join(dealt, "component").select("a", "bin"), "bins")


def _covered(rest: DataFrame, names: int, task_pairs: int) -> DataFrame:
    """(cluster_rep, cluster_member) by greedy set cover of distinct pairs (a, b) of numbers below ``names``.

    A few pairs are covered in one task. Of more, components of up to ``task_pairs`` pairs are dealt to tasks, the small ones
    several to a task; in larger ones all picks that no other can forestall are made by joins, until they have shrunk.
    """
    schema = "cluster_rep long, cluster_member long"
    parts, n = [], rest.count()
    while n > min(task_pairs, ALONE):
        bins = _bins(rest, n, names, task_pairs)
        least, most = bins.agg(F.min("bin"), F.max("bin")).first()
        if most >= 0:
            dealt = rest.join(bins.where("bin >= 0"), "a").repartitionById(most + 1, F.col("bin").cast("int")).select("a", "b")
            parts.append(materialise(dealt.mapInArrow(cover_pairs, schema), "covered"))
        if least >= 0:
            n = 0
            break
        rest = materialise(rest.join(bins.where("bin < 0"), "a", "left_semi").select("a", "b"), "rest")
        for _ in range(4):
            if (n := rest.count()) <= task_pairs:
                break
            parts.append(materialise(_pick(rest), "picked"))
            gone = parts[-1].select(F.col("cluster_member").alias("a"))
            rest = materialise(rest.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "rest")
        n = rest.count()
    if n:
        parts.append(materialise(rest.coalesce(1).mapInArrow(cover_pairs, schema), "covered"))
    out = rest.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def greedy_clusters(pairs: DataFrame, query: str = "query", target: str = "target", score: str = "alntmscore", all_inputs: DataFrame | None = None, reassign: bool = True, task_pairs: int = 40_000_000) -> DataFrame:
    """(cluster_rep, cluster_member) by greedy set cover, then members moved to representatives of strictly higher score.

    Names are numbered in their order first, so that pairs are pairs of numbers, of which a task holds ``task_pairs`` in arrays. A pick
    never affects another connected component, so more pairs are covered by component, in parallel, and what one task cannot hold is
    shrunk by joins; the result is that of the sequential cover either way.
    """
    pairs = pairs.select(F.col(query).alias("q"), F.col(target).alias("t"), F.col(score).cast("double").alias("score"))
    seen = pairs.select(F.col("q").alias("m")).unionByName(pairs.select(F.col("t").alias("m")))
    if all_inputs is not None:
        seen = seen.unionByName(all_inputs.select(F.col(all_inputs.columns[0]).alias("m")))
    kind = dict(seen.dtypes)["m"]
    # ranges of names in their order, and within them too: partition and row, of which a few counts make numbers without gaps
    names = materialise(seen.where("m is not null").distinct(), "distinct")  # read twice: for the ranges' bounds, and to be dealt
    names = names.repartitionByRange("m").sortWithinPartitions("m").select("m", F.monotonically_increasing_id().alias("i"))
    names = materialise(names.select("m", F.shiftright("i", 33).alias("range"), F.expr("i & 8589934591").alias("row")), "names")
    before = names.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    before = materialise(before, "before")
    total = names.count()
    names = names.join(F.broadcast(before), "range").select("m", (F.col("before") + F.col("row")).alias("i"))
    for end in "qt":
        pairs = pairs.withColumn(end, F.col(end).cast(kind)).join(names.select(F.col("m").alias(end), F.col("i").alias(f"{end}i")), end).drop(end)
    scores = materialise(best_scores(pairs, "qi", "ti", "score"), "scores")
    out = _covered(scores.select("a", "b"), total, task_pairs)
    alone = names.select("i").join(out.select(F.col("cluster_member").alias("i")), "i", "left_anti")
    out = materialise(out.unionByName(alone.select(F.col("i").alias("cluster_rep"), F.col("i").alias("cluster_member"))), "clusters")
    if reassign:
        out = reassign_members(out, scores)
    for end in ("cluster_rep", "cluster_member"):
        out = out.withColumnRenamed(end, "i").join(names.withColumnRenamed("m", end), "i").drop("i")
    return out.select("cluster_rep", "cluster_member")


def reassign_members(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """Members that are no representatives go to the representative of strictly higher score; a missing score counts as 0.

    A member whose present score is negative may so go to a representative that it has no score with: the least name.
    """
    both = scores.select("a", "b", "score").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    reps = clusters.select(F.col("cluster_rep").alias("rep")).distinct()
    moving = clusters.join(reps.select(F.col("rep").alias("cluster_member")), "cluster_member", "left_anti")
    offers = both.join(reps.select(F.col("rep").alias("b")), "b").select(F.col("a").alias("cluster_member"), F.col("b").alias("offer"), "score")
    now = moving.join(offers, "cluster_member", "left").groupBy("cluster_member", "cluster_rep").agg(
        F.coalesce(F.max(F.when(F.col("offer") == F.col("cluster_rep"), F.col("score"))), F.lit(0.0)).alias("own"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col("offer").alias("rep"))).alias("best"),
    )
    now = materialise(now, "offered")
    # members below 0 that no representative offers more: the least representative that is not below 0 with them, as one of
    # the first k + 1 names if a member has at most k such
    offer = -F.col("best.s")
    low = now.where((F.col("own") < 0) & (F.coalesce(offer, F.lit(0.0)) <= 0)).select("cluster_member")
    barred = materialise(low.join(offers.where("score < 0"), "cluster_member").groupBy("cluster_member").agg(F.collect_set("offer").alias("barred")), "barred")
    most = barred.agg(F.max(F.size("barred"))).first()[0] or 0
    names = reps.orderBy("rep").limit(most + 1).agg(F.array_sort(F.collect_list("rep")).alias("names"))
    free = barred.crossJoin(F.broadcast(names)).select("cluster_member", F.get(F.filter("names", lambda r: ~F.array_contains("barred", r)), F.lit(0)).alias("free"))
    now = now.join(free, "cluster_member", "left")
    target = F.when((offer > F.col("own")) & (offer > 0), F.col("best.rep")).when(F.col("own") < 0, F.coalesce("free", F.when(offer > F.col("own"), F.col("best.rep")), "cluster_rep")).otherwise(F.col("cluster_rep"))
    moved = now.select(target.alias("cluster_rep"), "cluster_member")
    kept = clusters.join(reps.select(F.col("rep").alias("cluster_member")), "cluster_member", "left_semi").select("cluster_rep", "cluster_member")
    return kept.unionByName(moved)


def merge_cluster_tables(one: DataFrame, two: DataFrame, order: str = "ordinal", missing: str = "X") -> DataFrame:
    """Two nested cluster tables as one: the second column of ``one`` is the first of ``two``.

    Rows of ``two`` gain the outer levels of ``one``; those it lacks stand for themselves in them, and keys without rows in ``two`` get
    ``missing`` in its other columns. A key in two outer clusters is an error; its first row gives the extra columns.
    """
    cols1, cols2 = [c for c in one.columns if c != order], [c for c in two.columns if c != order]
    outer, key, extra = cols1[0], cols1[1], cols1[2:]
    inner, rest = cols2[0], cols2[1:]
    firsts = one.groupBy(F.col(key).alias("_key")).agg(F.count_distinct(outer).alias("_n"), *(F.min_by(c, order).alias(f"_1_{c}") for c in [outer, *extra]))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several outer clusters for "), "_key")).cast("string")).otherwise(F.col(f"_1_{outer}"))
    firsts = firsts.withColumn(f"_1_{outer}", checked)
    joined = firsts.join(two.withColumn("_hit", F.lit(True)), F.col("_key") == F.col(inner), "full_outer")
    name = F.coalesce("_key", inner)
    clash = [c for c in extra if c in cols2]
    return joined.select(F.coalesce(f"_1_{outer}", name).alias(outer), name.alias(key), *(F.coalesce(f"_1_{c}", name).alias(c) for c in extra if c not in clash), *(F.coalesce(c, F.when(F.col("_hit").isNull(), F.lit(missing))).alias(c) for c in rest))


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order: sorted within ranges of it, which are numbered one after the other."""
    ranges = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_own", own).join(before.drop("_n"), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def rank_clusters(clusters: DataFrame, rep: str = "cluster_rep", order: str = "ordinal") -> DataFrame:
    """``cluster_ID`` (1 is the largest; of equals the last in the input first) and ``cluster_count`` for every member.

    Only one row a cluster is sorted, in ranges.
    """
    if "cluster_ID" in clusters.columns:
        return clusters
    sizes = clusters.groupBy(rep).agg(F.count("*").alias("cluster_count"), F.min(order).alias("_first"))
    ranked = _numbered(sizes, [F.desc("cluster_count"), F.desc("_first"), F.asc(rep)], "cluster_ID").drop("_first")
    return clusters.join(ranked, rep)


def connection_map(clusters: DataFrame, cluster: str = "cluster_rep", family: str = "family") -> DataFrame:
    """Families that share clusters: (f1, f2, count, f1_total, f2_total, jaccard), f1 before f2, empty names left out.

    Families are made distinct within a cluster before they are paired, so a pair is joined once a cluster.
    """
    own = clusters.select(F.col(cluster).alias("c"), F.col(family).alias("f")).where("f is not null and f <> ''").distinct()
    totals = own.groupBy("f").agg(F.count("*").alias("n"))
    pairs = own.alias("x").join(own.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.f") < F.col("y.f"))).groupBy(F.col("x.f").alias("f1"), F.col("y.f").alias("f2")).agg(F.count("*").alias("count"))
    out = pairs.join(totals.select(F.col("f").alias("f1"), F.col("n").alias("f1_total")), "f1").join(totals.select(F.col("f").alias("f2"), F.col("n").alias("f2_total")), "f2")
    return out.select("f1", "f2", "count", "f1_total", "f2_total", (F.col("count") / (F.col("f1_total") + F.col("f2_total") - F.col("count"))).alias("jaccard"))


def super_clusters(clusters: DataFrame, alignments: DataFrame, linkage: float = 0.5, query: str = "query", target: str = "target") -> DataFrame:
    """(cluster_ID, cluster_count, cluster_rep, super_rep, cluster_member): clusters linked by alignments of their members.

    Two clusters are linked if at least ``linkage`` of the members of either align to the other; linked clusters, also through
    others, make one, and the representative of the largest (the least name of equals) represents it.
    """
    m = clusters.select(F.col("cluster_rep").alias("rep"), F.col("cluster_member").alias("member"))
    size = m.groupBy("rep").agg(F.count("*").alias("n"))
    a = alignments.select(F.col(query).alias("q"), F.col(target).alias("t")).where("q <> t")
    a = a.unionByName(a.select(F.col("t").alias("q"), F.col("q").alias("t"))).distinct()
    ends = a.join(m.select(F.col("member").alias("q"), F.col("rep").alias("rq")), "q").join(m.select(F.col("member").alias("t"), F.col("rep").alias("rt")), "t").where("rq <> rt")
    hits = ends.groupBy("rq", "rt").agg(F.count_distinct("q").alias("k"))
    links = hits.join(size.select(F.col("rep").alias("rq"), "n"), "rq").where(F.col("k") >= linkage * F.col("n")).select("rq", "rt")
    comp = connected_components(links.unionByName(size.select(F.col("rep").alias("rq"), F.col("rep").alias("rt"))), "rq", "rt").select(F.col("node").alias("rep"), "component")
    named = comp.join(size, "rep")
    best = named.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("s"), F.col("rep").alias("rep"))).alias("b"), F.sum("n").alias("cluster_count")).select("component", F.col("b.rep").alias("super_rep"), "cluster_count")
    ids = _numbered(best, [F.desc("cluster_count"), F.asc("super_rep")], "cluster_ID")
    return m.join(comp, "rep").join(ids, "component").select("cluster_ID", "cluster_count", F.col("rep").alias("cluster_rep"), "super_rep", F.col("member").alias("cluster_member"))


def add_clusters(alignments: DataFrame, supers: DataFrame, query: str = "query", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Alignments within super-clusters with their columns, and those of the representatives alone."""
    s = supers.select(F.col("cluster_member").alias("_m"), "cluster_ID", "cluster_count", F.col("super_rep").alias("cluster_rep"))
    inside = alignments.join(s, F.col(query) == F.col("_m")).drop("_m").join(supers.select(F.col("cluster_member").alias("_t"), F.col("cluster_ID").alias("_id")), (F.col(target) == F.col("_t")) & (F.col("cluster_ID") == F.col("_id"))).drop("_t", "_id")
    return inside, inside.where(F.col(query) == F.col("cluster_rep"))
