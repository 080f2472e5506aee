"""Taxonomy: lineages from a node table, canonical ranks, and counts of taxa in clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alignment_taxid, cluster_taxid
from ..storage import materialise

RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")


def lineages(nodes: DataFrame, max_depth: int = 100) -> DataFrame:
    """(taxid, lineage) from (taxid, parent, rank, name): ``array<struct<taxid, rank, name>>`` from root to node.

    Pointer jumping: each round doubles the ancestors that a node knows, so the depth takes its logarithm in joins. A node
    whose parent is null, itself or missing is a root.
    """
    n = nodes.select("taxid", F.when(F.col("parent") != F.col("taxid"), F.col("parent")).alias("parent"), F.struct("taxid", "rank", "name").alias("own"))
    known = n.select(F.col("taxid").alias("_p")).distinct()
    n = n.join(known, F.col("parent") == F.col("_p"), "left")
    cur = materialise(n.select("taxid", F.col("_p").alias("up"), F.array("own").alias("lineage")), "lineage")
    reach = 1
    while cur.where("up is not null").limit(1).count():
        if reach > 2 * max_depth:
            raise ValueError("the taxonomy has a cycle or is too deep")
        above = cur.select(F.col("taxid").alias("up"), F.col("up").alias("_up2"), F.col("lineage").alias("_above"))
        cur = cur.join(above, "up", "left").select("taxid", F.col("_up2").alias("up"), F.when(F.col("_above").isNull(), F.col("lineage")).otherwise(F.concat("_above", "lineage")).alias("lineage"))
        cur = materialise(cur, "lineage")
        reach *= 2
    return cur.select("taxid", "lineage")


def canonical_lineage(lineage: Column, levels: Sequence[str] = RANKS, terminal_as_species: bool = True) -> Column:
    """Names at the requested ranks, empty where there is none; of several nodes of a rank the deepest counts.

    If species is the last level and the lineage goes deeper, the last node's name stands for it.
    """

    def at(level: str) -> Column:
        name = F.try_element_at(F.filter(lineage, lambda n: n["rank"] == level), F.lit(-1))["name"]
        if terminal_as_species and level == "species" and levels[-1] == "species":
            name = F.when(name.isNotNull(), F.element_at(lineage, -1)["name"])
        return F.coalesce(name, F.lit(""))

    return F.array(*(at(level) for level in levels))


def taxon_table(lineage: DataFrame, levels: Sequence[str] = RANKS) -> DataFrame:
    """taxid and a column of names for each level."""
    c = lineage.select(F.col("taxid").cast("string").alias("taxid"), canonical_lineage(F.col("lineage"), levels).alias("c"))
    return c.select("taxid", *(F.get("c", F.lit(i)).alias(level) for i, level in enumerate(levels)))


def add_taxonomy(df: DataFrame, lineage: DataFrame, taxid: str = "taxid", levels: Sequence[str] = RANKS, prefix: str = "") -> DataFrame:
    """A column of names for each level; unknown ids get empty ones."""
    names = taxon_table(lineage, levels).select(F.col("taxid").alias("_taxid"), *(F.col(level).alias(prefix + level) for level in levels))
    out = df.join(names, F.trim(F.col(taxid).cast("string")) == F.col("_taxid"), "left").drop("_taxid")
    return out.withColumns({prefix + level: F.coalesce(prefix + level, F.lit("")) for level in levels})


def rank_and_name(df: DataFrame, nodes: DataFrame, taxid: str = "taxid") -> DataFrame:
    """``taxon_level`` and ``taxon_name`` (spaces as underscores); UNKNOWN for ids that are not in the table."""
    n = nodes.select(F.col("taxid").cast("string").alias("_taxid"), "rank", F.replace(F.col("name"), F.lit(" "), F.lit("_")).alias("name"))
    out = df.join(n, F.col(taxid).cast("string") == F.col("_taxid"), "left")
    return out.select(*df.columns, F.coalesce("rank", F.lit("UNKNOWN")).alias("taxon_level"), F.coalesce("name", F.lit("UNKNOWN")).alias("taxon_name"))


def name_to_taxid(df: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """``taxid_of_name``: of the exact name, else of the name without trailing digits and spaces, else X."""
    n = nodes.groupBy(F.col("name").alias("_n")).agg(F.min(F.col("taxid").cast("string")).alias("_t"))
    out = df.withColumn("_short", F.regexp_replace(F.col(name), r"[\d ]+$", ""))
    out = out.join(n.withColumnRenamed("_t", "_t1"), F.col(name) == F.col("_n"), "left").drop("_n")
    out = out.join(n.withColumnRenamed("_t", "_t2"), F.col("_short") == F.col("_n"), "left").drop("_n")
    return out.select(*df.columns, F.coalesce("_t1", "_t2", F.lit("X")).alias("taxid_of_name"))


def lineage_counts(taxids: DataFrame, names: DataFrame, by: Sequence[str], levels: Sequence[str] = RANKS) -> DataFrame:
    """(*by, superkingdom, level, taxon, count): distinct taxids of each name at each level.

    ``taxids`` has *by and taxid; ``names`` is a taxon table. A name's superkingdom is the greatest of its taxids', so the result
    does not depend on order. Unknown ids count under empty names.
    """
    if "superkingdom" not in levels:
        raise ValueError("superkingdom must be among the levels")
    own = taxids.select(*by, F.col("taxid").cast("string").alias("taxid")).distinct().join(names, "taxid", "left")
    long = own.select(*by, F.coalesce("superkingdom", F.lit("")).alias("superkingdom"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(level).alias("level"), F.coalesce(level, F.lit("")).alias("taxon")) for i, level in enumerate(levels)))).alias("e"))
    return long.groupBy(*by, "e.level", "e.taxon").agg(F.max("superkingdom").alias("superkingdom"), F.count("*").alias("count")).select(*by, "superkingdom", "level", "taxon", "count")


def cluster_taxa_counts(clusters: DataFrame, names: DataFrame, alignments: DataFrame | None = None, levels: Sequence[str] = RANKS, delimiter: str = "__", position: int = -1) -> DataFrame:
    """Taxa of every cluster's members, and with alignments of the targets that its members hit too.

    cluster_ID, cluster_rep, cluster_count, superkingdom, level, taxon and count; ids of clusters are ranked if they lack any. A query
    that belongs to no cluster is an error.
    """
    from .clusters import rank_clusters

    ranked = rank_clusters(clusters)
    if "cluster_count" not in ranked.columns:
        ranked = ranked.join(ranked.groupBy("cluster_rep").agg(F.count("*").alias("cluster_count")), "cluster_rep")
    head = ranked.select("cluster_rep", "cluster_ID", "cluster_count").distinct()
    tax = ranked.select("cluster_rep", cluster_taxid(F.col("cluster_member"), delimiter, position).alias("taxid"))
    if alignments is not None:
        given = F.col("taxid") if "taxid" in alignments.columns else None
        hits = alignments.select(F.col("query").alias("cluster_member"), alignment_taxid(F.col("target"), given, delimiter, position).alias("taxid"))
        hits = hits.join(ranked.select("cluster_member", "cluster_rep"), "cluster_member", "left")
        known = F.when(F.col("cluster_rep").isNotNull(), F.col("cluster_rep")).otherwise(F.raise_error(F.concat(F.lit("in no cluster: "), "cluster_member")).cast("string"))
        tax = tax.unionByName(hits.select(known.alias("cluster_rep"), "taxid"))
    counts = lineage_counts(tax, names, ["cluster_rep"], levels)
    return counts.join(head, "cluster_rep").select("cluster_ID", "cluster_rep", "cluster_count", "superkingdom", "level", "taxon", "count")
