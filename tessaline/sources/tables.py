"""Tab-separated tables under the header and row policies of the file formats.

Spark's CSV reader would unquote cells, drop blank lines and pad ragged rows, so lines are read as text and split. A file's order
is kept in a column ``ordinal``: lines rise with it within a file, and files follow each other by path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """How a format treats headers, blank lines and rows of another width.

    ``header``: the first cells by which a header is known, or None where the first line is one whatever it says.
    ``repeated``: headers are skipped anywhere. ``blank`` and ``ragged``: ``raise``, ``skip``, or for ragged rows ``pad``.
    """

    header: tuple[str, ...] | None = None
    repeated: bool = False
    blank: str = "skip"
    ragged: str = "raise"


STRICT = Policy(("query",), True, "raise", "raise")
FILTER = Policy(("query",), True, "skip", "raise")
LOOSE = Policy(("query",), False, "skip", "skip")
PLAIN = Policy(None, False, "skip", "pad")
NESTED = Policy(None, False, "skip", "raise")
CLUSTER = Policy(("cluster_rep", "cluster_ID"), True, "raise", "raise")
POLICIES = {"P1": STRICT, "P2": FILTER, "P3": LOOSE, "P4": PLAIN, "P5": NESTED, "P6": CLUSTER}


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, ordinal, file)`` of text files."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).alias("ordinal"))


def parse_fields(colnames: str | list[str] | None) -> list[str]:
    """Column names as a list, from a list or a comma-separated text."""
    if not colnames:
        return []
    return list(colnames) if not isinstance(colnames, str) else [c.strip() for c in colnames.split(",")]


def scan_table(spark: SparkSession, path: str | list[str], policy: Policy | str = FILTER, colnames: str | list[str] | None = None, required: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """All columns as text, and ``ordinal``. Names come from ``colnames`` or from the header; ``keep`` prunes columns.

    With names given, a line equal to them is a header. Only the header line of the first file reaches the driver.
    """
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    rows = lines(spark, path)
    names = parse_fields(colnames)
    cells = F.split("value", "\t", -1)
    if not names:
        head = rows.where("value <> ''").orderBy("ordinal").select("value").first()
        if head is None:
            raise ValueError(f"{path} is empty")
        names = head.value.split("\t")
        if policy.header and names[0] not in policy.header:
            raise ValueError(f"{path} has no header that starts with {' or '.join(policy.header)}; give the column names")
    if missing := [c for c in required or [] if c not in names]:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    blank = F.col("value") == ""
    first = F.col("ordinal") == F.lit(None)
    if policy.repeated and policy.header:
        is_header = F.get(cells, F.lit(0)).isin(*policy.header)
    else:
        top = rows.where("value <> ''").agg(F.min("ordinal").alias("o")).first().o
        first = (F.col("ordinal.file") == F.lit(top.file if top else "")) & (F.col("ordinal.n") == F.lit(top.n if top else -1))
        looks = F.get(cells, F.lit(0)).isin(*policy.header) if policy.header and not parse_fields(colnames) else F.col("value") == F.lit("\t".join(names))
        is_header = first & looks
    rows = rows.where(~F.coalesce(is_header, F.lit(False)))
    if policy.blank == "skip":
        rows = rows.where(~blank)
    parts = rows.select("ordinal", cells.alias("c"))
    fits = F.size("c") == len(names)
    if policy.ragged == "skip":
        parts = parts.where(F.size("c") >= len(names))
    elif policy.ragged == "raise":
        parts = parts.withColumn("c", F.when(fits, F.col("c")).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(names)} cells in: "), F.array_join("c", "|"))).cast("array<string>")))
    wanted = keep or names
    return parts.select(*(F.get("c", F.lit(names.index(n))).alias(n) for n in wanted), "ordinal")


def scan_alignments(spark: SparkSession, path: str, colnames=None, policy: Policy | str = STRICT) -> DataFrame:
    return scan_table(spark, path, policy, colnames, required=["query"])


def scan_clusters(spark: SparkSession, path: str, colnames=None) -> DataFrame:
    """Cluster table: ``cluster_rep`` and ``cluster_member`` are needed, and a member belongs to one row."""
    df = scan_table(spark, path, CLUSTER, colnames, required=["cluster_rep", "cluster_member"])
    twice = df.groupBy("cluster_member").count().where("count > 1").select("cluster_member").first()
    if twice:
        raise ValueError(f"cluster member {twice[0]} comes more than once")
    return df


def scan_nested_clusters(spark: SparkSession, path: str, colnames=None) -> DataFrame:
    """Cluster levels from the outermost to members, without file suffixes in any cell."""
    from ..functions.text import remove_file_suffix

    df = scan_table(spark, path, NESTED, colnames)
    return df.select(*(remove_file_suffix(F.col(c)).alias(c) for c in df.columns if c != "ordinal"), "ordinal")


def scan_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column clusters: distinct (cluster_rep, cluster_member)."""
    return scan_table(spark, path, PLAIN, ["cluster_rep", "cluster_member"]).select("cluster_rep", "cluster_member").distinct()


def scan_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines, as ``id``."""
    return lines(spark, path).where("value <> ''").select(F.col("value").alias("id")).distinct()


def scan_accessions(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """Distinct accessions in one column of a table; rows that start with the cell ``query`` are headers."""
    from ..functions.text import accession_of

    cells = F.split("value", "\t", -1)
    rows = lines(spark, path).where("value <> ''").where(F.get(cells, F.lit(0)) != "query")
    return rows.select(accession_of(F.get(cells, F.lit(column))).alias("id")).where("id is not null").distinct()


def scan_name_lookup(spark: SparkSession, path: str) -> DataFrame:
    """accession, geneName and fullName; trailing tabs go, and names that a line lacks are empty. The last of an accession wins."""
    cells = F.split(F.regexp_replace("value", "\t+$", ""), "\t", -1)
    rows = lines(spark, path).where("value <> ''").select(F.get(cells, F.lit(0)).alias("accession"), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias("geneName"), F.coalesce(F.get(cells, F.lit(2)), F.lit("")).alias("fullName"), "ordinal")
    return rows.groupBy("accession").agg(F.max_by("geneName", "ordinal").alias("geneName"), F.max_by("fullName", "ordinal").alias("fullName"))


def scan_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(name, qlen) of a sheet of query lengths."""
    from ..functions.text import remove_pdb_and_fasta_suffix

    df = scan_table(spark, path, PLAIN, ["name", "qlen"])
    return df.groupBy(remove_pdb_and_fasta_suffix(F.col("name")).alias("name")).agg(F.max_by(F.col("qlen").cast("int"), "ordinal").alias("qlen"))


def scan_structure_key(spark: SparkSession, paths: list[str] | str, delimiter: str = ",,") -> DataFrame:
    """(id, structure) of key files: ids have four characters and come once, structures lose ``.pdb``."""
    from ..functions.text import split_literal

    paths = paths.split(",") if isinstance(paths, str) else paths
    parts = split_literal(F.col("value"), delimiter)
    rows = lines(spark, paths).where("value <> ''").select(F.regexp_replace(F.get(parts, F.lit(0)), r"\.pdb$", "").alias("structure"), F.get(parts, F.lit(1)).alias("id"))
    bad = rows.groupBy("id").count().where("count > 1 or id is null or length(id) <> 4").first()
    if bad:
        raise ValueError(f"structure key: id {bad[0]} is repeated or does not have four characters")
    return rows
