"""Operators on alignment tables. Column names are parameters; all other columns ride along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accession_of, cigar_matches, coverage


def range_filter(df: DataFrame, field: str = "alntmscore", low: float = 0.4, high: float = 1.0, keep_nan: bool = True, strict: bool = False) -> DataFrame:
    """Rows whose value lies in [low, high]; NaN stays with ``keep_nan``. ``strict`` makes text that is no number an error."""
    if high < low:
        raise ValueError("the maximum is below the minimum")
    from ..functions.text import strict_double

    v = strict_double(F.col(field)) if strict else F.col(field).cast("double")
    inside = (v >= low) & (v <= high) & ~F.isnan(v)
    return df.where(inside | F.isnan(v) if keep_nan else inside)


def without_self_hits(df: DataFrame, query: str = "query", target: str = "target") -> DataFrame:
    return df.where(F.col(query) != F.col(target))


def top_n(df: DataFrame, n: int, by: str = "query", score: str = "alntmscore", ties: Sequence[str | Column] = ("ordinal",)) -> DataFrame:
    """The ``n`` rows of greatest score of each group, ties in the order of ``ties``; 0 keeps all.

    Spark limits each task to its own best ``n`` of a group before the shuffle, so a hot group sends few rows.
    """
    if n == 0:
        return df
    w = Window.partitionBy(by).orderBy(F.col(score).cast("double").desc(), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def sample_n(df: DataFrame, n: int, by: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows of each group, chosen by the hash of seed and row key: any cluster and partitioning choose alike."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))
    w = Window.partitionBy(by).orderBy(order, *key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def add_field(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def insert_after(df: DataFrame, anchor: str, new: dict[str, Column]) -> DataFrame:
    """New columns right after a named one."""
    at = df.columns.index(anchor) + 1
    return df.select(*df.columns[:at], *(c.alias(n) for n, c in new.items()), *df.columns[at:])


def add_cigar_coverage(df: DataFrame, cigar: str = "cigar", qlen: str = "qlen", tlen: str = "tlen") -> DataFrame:
    """``cigar_qcov`` and ``cigar_tcov`` after the CIGAR; rows whose lengths are no numbers are dropped."""
    ok = df.where(F.col(qlen).try_cast("long").isNotNull() & F.col(tlen).try_cast("long").isNotNull())
    m = cigar_matches(F.col(cigar))
    return insert_after(ok, cigar, {"cigar_qcov": coverage(m, F.col(qlen).try_cast("long")), "cigar_tcov": coverage(m, F.col(tlen).try_cast("long"))})


def merge(one: DataFrame, two: DataFrame, source_one: str = "", source_two: str = "", missing: str | None = "") -> DataFrame:
    """All rows of both; common columns come first, then those of either. ``source`` names the table if sources are given."""
    if source_one or source_two:
        one, two = one.withColumn("source", F.lit(source_one)), two.withColumn("source", F.lit(source_two))
    common = [c for c in one.columns if c in two.columns]
    order = common + [c for c in one.columns if c not in common] + [c for c in two.columns if c not in common]
    out = one.unionByName(two, allowMissingColumns=True).select(*order)
    if missing is None:
        return out
    texts = {n for n, t in out.dtypes if t == "string"}
    return out.select(*(F.coalesce(F.col(c), F.lit(missing)).alias(c) if c in texts and c not in common else F.col(c) for c in order))


def add_lookup(df: DataFrame, lookup: DataFrame, key: Column, lookup_key: str, columns: dict[str, str], strict: bool = True, small: int = 1_000_000) -> DataFrame:
    """Columns of a lookup table by key; ``columns`` maps its names to new ones. A key without a match is an error if ``strict``.

    The lookup is broadcast if it has at most ``small`` rows, and otherwise left to Spark's choice of a shuffle join.
    """
    side = lookup.select(F.col(lookup_key).alias("_key"), *(F.col(a).alias(b) for a, b in columns.items()), F.lit(True).alias("_hit"))
    if side.limit(small + 1).count() <= small:
        side = F.broadcast(side)
    out = df.withColumn("_want", key).join(side, F.col("_want") == F.col("_key"), "left")
    if strict:
        first = next(iter(columns.values()))
        t = dict(out.dtypes)[first]
        out = out.withColumn(first, F.when(F.col("_hit"), F.col(first)).otherwise(F.raise_error(F.concat(F.lit("no lookup entry for "), F.coalesce("_want", F.lit("null")))).cast(t)))
    return out.drop("_want", "_key", "_hit")


def add_uniprot(df: DataFrame, names: DataFrame, target: str = "target") -> DataFrame:
    """Accession, gene and protein names of the targets; every target must be known."""
    out = df.withColumn("uniprot_accession", accession_of(F.col(target)))
    return add_lookup(out, names, F.col("uniprot_accession"), "accession", {"geneName": "uniprot_geneName", "fullName": "uniprot_fullName"})


def position_coverage(df: DataFrame, by: Sequence[str], start: str = "qstart", end: str = "qend", length: str = "qlen", weight: Column | None = None) -> DataFrame:
    """``(*by, position, coverage)`` for 1..length: how many intervals, or what weight of them, cover each position.

    A sweep over interval ends, so the shuffle holds two rows an interval and not one for each position of it. Intervals outside
    of the length are an error.
    """
    w = weight if weight is not None else F.lit(1)
    inside = (F.col(start) >= 1) & (F.col(end) <= F.col(length))
    checked = F.when(inside, F.col(start)).otherwise(F.raise_error(F.lit("an interval lies outside of its sequence")).cast("long")).cast("long")
    steps = df.select(*by, F.explode(F.array(F.struct(checked.alias("p"), w.alias("d")), F.struct((F.col(end) + 1).cast("long").alias("p"), (-w).alias("d")))).alias("e")).groupBy(*by, F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    spine = df.groupBy(*by).agg(F.max(length).cast("long").alias("_n"))
    win = Window.partitionBy(*by).orderBy("p")
    runs = steps.withColumn("coverage", F.sum("d").over(win)).withColumn("next", F.lead("p").over(win))
    lead = steps.groupBy(*by).agg(F.min("p").alias("first"))
    head = spine.join(lead, list(by)).where("first > 1").select(*by, F.lit(1).cast("long").alias("p"), F.lit(0).alias("coverage"), F.col("first").alias("next"), "_n")
    runs = runs.join(spine, list(by)).select(*by, "p", "coverage", F.coalesce("next", F.col("_n") + 1).alias("next"), "_n").unionByName(head)
    runs = runs.withColumn("to", F.least(F.col("next") - 1, F.col("_n"))).where("p <= to")
    return runs.select(*by, F.explode(F.sequence("p", "to")).alias("position"), "coverage")


def scaled_coverage(df: DataFrame, by: Sequence[str], identity: str = "fident", **columns) -> DataFrame:
    """Coverage in which an alignment weighs the inverse of its identity."""
    return position_coverage(df, by, weight=1 / F.col(identity).cast("double"), **columns)


def extreme_alignments(df: DataFrame, target: str = "target", start: str = "tstart", end: str = "tend", shortest: bool = True, order: str = "ordinal") -> DataFrame:
    """The shortest or longest aligned interval of each target: (target, tstart, tend, tlength); the first of equals."""
    n = F.col(end).cast("long") - F.col(start).cast("long") + 1
    key = F.struct((n if shortest else -n).alias("n"), F.col(order).alias("o"))
    best = df.groupBy(F.col(target).alias("target")).agg(F.min_by(F.struct(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), n.alias("n")), key).alias("b"))
    return best.select("target", F.col("b.s").alias("tstart"), F.col("b.e").alias("tend"), F.col("b.n").alias("tlength"))


def trim_targets(best: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, seq) cut to each target's interval, and the targets without a sequence."""
    from ..functions.sequences import trim

    s = seqs.select(F.col("id").alias("target"), "seq")
    return best.join(s, "target").select(F.col("target").alias("id"), trim(F.col("seq"), F.col("tstart"), F.col("tlength")).alias("seq")), best.join(s, "target", "left_anti").select("target")


def trim_by_plddt(intervals: DataFrame, plddt: DataFrame, threshold: float, by: Sequence[str] = ("query",)) -> DataFrame:
    """Interval ends moved inwards to residues of ``plddt`` (*by, position, plddt) at the threshold; null if none reaches it.

    Equal interval rows are trimmed once and returned as often as they were given.
    """
    good = plddt.where(F.col("plddt") >= threshold).select(*(F.col(b).alias(f"_{b}") for b in by), "position")
    keys = [F.col(b) == F.col(f"_{b}") for b in by]
    rows = intervals.groupBy(*intervals.columns).agg(F.count("*").alias("_copies"))
    hit = rows.withColumn("_row", F.struct(*intervals.columns)).join(good, [*keys, F.col("position").between(F.col("qstart"), F.col("qend"))], "left")
    ends = hit.groupBy("_row", "_copies").agg(F.min("position").alias("new_qstart"), F.max("position").alias("new_qend"))
    return ends.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*", "new_qstart", "new_qend")


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return sorted(one.columns) == sorted(two.columns) and not one.exceptAll(two.select(*one.columns)).limit(1).count() and not two.select(*one.columns).exceptAll(one).limit(1).count()


def dali_attributes(blocks: DataFrame) -> DataFrame:
    """Bounds, lengths, score and identity of aligned pairs."""
    from ..functions import sequences as S

    cols = S.aligned_columns(F.col("aln_qseq"), F.col("aln_tseq"))
    b = blocks.withColumn("_cols", cols).withColumns({"_a": F.array_min("_cols"), "_z": F.array_max("_cols")})
    at = lambda seq, c: S.sequence_position(F.col(seq), F.when(F.col(c).isNull(), F.raise_error(F.lit("nothing is aligned")).cast("int")).otherwise(F.col(c)))
    return b.select("aln_number", "query", "target", at("aln_qseq", "_a").alias("qstart"), at("aln_qseq", "_z").alias("qend"), at("aln_tseq", "_a").alias("tstart"), at("aln_tseq", "_z").alias("tend"), S.residue_count(F.col("aln_qseq")).alias("qlen"), S.residue_count(F.col("aln_tseq")).alias("tlen"), "z", S.percent_identity(F.col("aln_qseq"), F.col("aln_tseq")).alias("pident"))


def dali_motif(blocks: DataFrame, motif: str) -> DataFrame:
    """The pairs whose target has the motif at the query's positions."""
    from ..functions.sequences import has_motif

    return blocks.where(has_motif(F.col("aln_qseq"), F.col("aln_tseq"), motif))


def pairwise_fastas(df: DataFrame, query: str = "query", target: str = "target", qseq: str = "aln_qseq", tseq: str = "aln_tseq", per_query_dir: bool = True) -> DataFrame:
    """(path, text) of one aligned FASTA for each pair, hits on itself left out."""
    name = F.concat(F.col(query), F.lit("xxx"), F.col(target), F.lit(".fasta.aln"))
    path = F.concat(F.col(query), F.lit("/"), name) if per_query_dir else name
    return without_self_hits(df, query, target).select(path.alias("path"), F.concat(F.lit(">"), F.col(query), F.lit("\n"), F.col(qseq), F.lit("\n>"), F.col(target), F.lit("\n"), F.col(tseq), F.lit("\n")).alias("text"))
