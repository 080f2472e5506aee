"""PDB atom records, structure reports and matrices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import lines


def scan_pdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Atoms of PDB files by the format's fixed columns; a directory gives its ``*.pdb``.

    Atoms come with the line they were read from, ``atom_ordinal`` rises in file order, and ``model`` counts from 0.
    """
    raw = spark.read.option("pathGlobFilter", "*.pdb").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    cut = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    kind = F.rtrim(F.substring("value", 1, 6))
    raw = raw.where(kind.isin("ATOM", "HETATM", "MODEL")).withColumn("model", F.greatest(F.sum((kind == "MODEL").cast("int")).over(Window.partitionBy("file").orderBy("n")) - 1, F.lit(0)))
    element = F.when(cut(77, 78) != "", cut(77, 78)).otherwise(F.substring(F.regexp_replace(cut(13, 16), "[0-9]", ""), 1, 1))
    num = lambda a, b, t: F.expr(f"try_cast(trim(substring(value, {a}, {b - a + 1})) as {t})")
    return raw.where(kind != "MODEL").select(
        "file", "model", F.substring("value", 22, 1).alias("chain"), num(23, 26, "int").alias("resseq"), cut(27, 27).alias("icode"), cut(18, 20).alias("resname"),
        F.when(kind == "HETATM", F.when(cut(18, 20) == "HOH", "W").otherwise("H")).otherwise("").alias("hetflag"), F.col("n").alias("atom_ordinal"), cut(13, 16).alias("atom_name"), cut(17, 17).alias("altloc"),
        num(31, 38, "double").alias("x"), num(39, 46, "double").alias("y"), num(47, 54, "double").alias("z"), num(55, 60, "double").alias("occupancy"), num(61, 66, "double").alias("bfactor"), F.upper(element).alias("element"), F.col("value").alias("line"),
    )


def parse_dali_blocks(text: str) -> Iterator[dict]:
    """Pairwise alignment blocks of a report: each begins with a line ``No n: Query=… Sbjct=… Z-score=…``."""
    section = re.search(r"^# Pairwise alignments[^\n]*\n(.*?)(?=^#|\Z)", text, re.MULTILINE | re.DOTALL)
    if not section or not section[1].strip():
        raise ValueError("the report has no section of pairwise alignments")
    head = re.compile(r"^No\s+(\d+):\s+Query=(\S+)\s+Sbjct=(\S+)\s+Z-score=\s*(\S+)", re.MULTILINE)
    starts = list(head.finditer(section[1]))
    for m, after in zip(starts, [*starts[1:], None], strict=True):
        rows = [r for r in section[1][m.end() : after.start() if after else None].split("\n") if r]
        parts = {"aln_qdssp": "", "aln_qseq": "", "aln_tseq": "", "aln_tdssp": ""}
        below = False  # a DSSP line belongs to the target once its sequence has come
        for r in rows:
            label, body = r[:5], r[6:]
            if label.startswith("DSSP"):
                parts["aln_tdssp" if below else "aln_qdssp"] += body
                below = False
            elif label in ("Query", "Sbjct"):
                parts["aln_qseq" if label == "Query" else "aln_tseq"] += re.sub(r"[\d ]", "", body)
                below = label == "Sbjct"
        if not len(parts["aln_qseq"]) == len(parts["aln_tseq"]) == len(parts["aln_qdssp"]):
            raise ValueError(f"block {m[1]}: lines of different lengths")
        yield {"aln_number": int(m[1]), "query_id": m[2][:-1], "target_id": m[3][:-1], "z": float(m[4]), **parts}


def scan_dali_blocks(spark: SparkSession, path: str, key: DataFrame | None = None) -> DataFrame:
    """Alignment blocks of reports; names come from ``key`` (id, structure), ``x`` for ids it lacks or without a key."""
    cols = "file string, aln_number int, query_id string, target_id string, z double, aln_qdssp string, aln_qseq string, aln_tseq string, aln_tdssp string"
    names = [c.split()[0] for c in cols.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([{"file": f, **b} for f, t in zip(part["file"], part["value"], strict=True) for b in parse_dali_blocks(t)], columns=names)

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return name_blocks(raw.mapInPandas(run, cols), key)


def name_blocks(blocks: DataFrame, key: DataFrame | None) -> DataFrame:
    if key is None:
        return blocks.withColumns({"query": F.lit("x"), "target": F.lit("x")})
    for side in ("query", "target"):
        one = key.select(F.col("id").alias(f"{side}_id"), F.col("structure").alias(side))
        blocks = blocks.join(one, f"{side}_id", "left").withColumn(side, F.coalesce(side, F.lit("x")))
    return blocks


def scan_dali_summary(spark: SparkSession, path: str, key: DataFrame, query_name: str = "", lengths: DataFrame | None = None, min_cov: float = 0, min_z: float = 0, min_alnlen: float = 0, min_rmsd: float = 0) -> DataFrame:
    """The summary rows of reports: query, target, ids, alnlen, qlen, tlen, cov, pident, rmsd and z, under minima.

    Rows whose columns have run together are dropped. qlen is that of ``lengths`` (name, qlen), else tlen for a hit on
    itself, else 0; ``cov`` is alnlen by the greater of qlen and tlen, null where both are 0.
    """
    rows = lines(spark, path).select("value", F.col("ordinal.file").alias("file"), F.col("ordinal.n").alias("n"))
    ends = rows.where(F.col("value").rlike("^# (Structural equivalences|Pairwise alignments|Translation-rotation matrices)")).groupBy("file").agg(F.min("n").alias("end"))
    query = rows.where(F.col("value").startswith("# Query: ")).groupBy("file").agg(F.min_by("value", "n").alias("q")).select("file", F.expr("substring(q, 10, length(q) - 10)").alias("query_id"))
    part = F.split(F.trim("value"), r"\s+")
    hits = rows.where(~F.col("value").startswith("#") & (F.trim("value") != "")).join(ends, "file", "left").where("end is null or n < end").join(query, "file")
    num = lambda i: F.expr(f"try_cast(p[{i}] as double)")
    hits = hits.withColumn("p", part).where(F.size("p") >= 7).select("file", "n", "query_id", F.expr("left(p[1], length(p[1]) - 2)").alias("target_id"), num(2).alias("z"), num(3).alias("rmsd"), num(4).alias("alnlen"), num(5).alias("tlen"), num(6).alias("pident")).where("z + rmsd + alnlen + tlen + pident is not null")
    from ..functions.text import remove_pdb_and_fasta_suffix

    named = key.select(F.col("id"), remove_pdb_and_fasta_suffix(F.col("structure")).alias("structure"))
    hits = hits.join(named.select(F.col("id").alias("target_id"), F.col("structure").alias("target")), "target_id", "left").withColumn("target", F.coalesce("target", F.lit("")))
    if query_name:
        hits = hits.withColumn("query", remove_pdb_and_fasta_suffix(F.lit(query_name)))
    else:
        hits = hits.join(named.select(F.col("id").alias("query_id"), F.col("structure").alias("query")), "query_id", "left").withColumn("query", F.coalesce("query", F.lit("")))
    sheet = lengths.select(F.col("name").alias("query"), F.col("qlen").cast("double").alias("given")) if lengths is not None else None
    hits = hits.join(sheet, "query", "left") if sheet is not None else hits.withColumn("given", F.lit(None).cast("double"))
    return dali_statistics(hits, min_cov, min_z, min_alnlen, min_rmsd).select("query", "target", "query_id", "target_id", "alnlen", "qlen", "tlen", "cov", "pident", "rmsd", "z", F.struct("file", "n").alias("ordinal"))


def dali_statistics(hits: DataFrame, min_cov: float = 0, min_z: float = 0, min_alnlen: float = 0, min_rmsd: float = 0) -> DataFrame:
    """qlen, coverage and the minima, from columns given (a known query length or null), query_id, target_id, alnlen, tlen, rmsd and z."""
    qlen = F.coalesce("given", F.when(F.col("query_id") == F.col("target_id"), F.col("tlen")).otherwise(F.lit(0.0)))
    out = hits.withColumn("qlen", qlen).withColumn("cov", F.try_divide("alnlen", F.greatest("qlen", "tlen")))
    return out.where((F.coalesce("cov", F.lit(0.0)) >= min_cov) & (F.col("z") >= min_z) & (F.col("alnlen") >= min_alnlen) & (F.col("rmsd") >= min_rmsd))


def rename_newick(text: str, key: dict[str, str]) -> str:
    """Leaf ids (before a colon and a length) replaced by the key's names; an id loses its chain character for the lookup."""
    return re.sub(r"\w+(?=:\d+(?:\.\d+)?)", lambda m: key.get(m[0][:-1], m[0]), text)


def rename_matrix(spark: SparkSession, path: str, key: DataFrame) -> DataFrame:
    """Rows of a similarity matrix without its first line: (n, name, values), ids replaced by the key's names."""
    rows = lines(spark, path).select("value", F.col("ordinal.n").alias("n"))
    first = rows.agg(F.min("n")).first()[0]
    cells = F.split(F.trim("value"), r"\s+")
    body = rows.where((F.col("n") > F.lit(first)) & (F.trim("value") != "")).withColumn("c", cells)
    body = body.select("n", F.expr("left(c[0], length(c[0]) - 1)").alias("id"), F.expr("transform(slice(c, 2, size(c)), v -> cast(v as double))").alias("values"))
    return body.join(key, "id", "left").select("n", F.coalesce("structure", "id").alias("name"), "values")


PAE_SCHEMA = "pae array<array<double>>, plddt array<double>, iptm double"


def scan_pae(spark: SparkSession, path: str) -> DataFrame:
    """(file, pae, plddt, iptm) of prediction scores; ``pae`` and ``plddt`` must be there."""
    df = spark.read.schema(PAE_SCHEMA).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "pae", "plddt", "iptm")
    need = lambda c, t: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"no {c} in "), "file")).cast(t))
    return df.select("file", need("pae", "array<array<double>>").alias("pae"), need("plddt", "array<double>").alias("plddt"), "iptm")


def scan_iptm(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, iptm as text); the key is required and the file must be JSON."""
    if not path.rstrip("/").endswith(".json") and "*" not in path:
        raise ValueError("a .json file is needed")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.iptm").alias("iptm"))
    checked = F.when(F.col("iptm").isNotNull(), F.col("iptm")).otherwise(F.raise_error(F.concat(F.lit("no iptm in "), "file")).cast("string"))
    return raw.select("file", F.regexp_replace(F.substring_index("file", "/", -1), r"\.json$", "").alias("name"), checked.alias("iptm"))


def first_chain_length(col) -> F.Column:
    """Length of the first chain from the first line of an a3m file, ``#98,76`` and more."""
    return F.regexp_extract(col, r"^#(\d+)", 1).try_cast("int")


def model_name_parts(name) -> F.Column:
    """struct(sample, model_type, rank, model) of a prediction's file name; the rank loses leading zeros."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[A-Za-z]+$", "")
    pattern = r"^(.*?)_(?:all|scores|distogram)_rank_0*(\d+)_(.*)_(model_\d+(?:_seed_\d+)?)$"
    return F.struct(F.regexp_extract(stem, pattern, 1).alias("sample"), F.regexp_extract(stem, pattern, 3).alias("model_type"), F.regexp_extract(stem, pattern, 2).alias("rank"), F.regexp_extract(stem, pattern, 4).alias("model"))


def scan_distograms(spark: SparkSession, path: str) -> DataFrame:
    """(file, logits, bin_edges) of distograms kept as JSON; pickles are not read, as they can run code."""
    df = spark.read.schema("logits array<array<array<double>>>, bin_edges array<double>").option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_path").alias("file"), "logits", "bin_edges")
