"""The queries of this subpackage, as the driver runs them, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, maxscore, mixing, neardup, oracles, packing, quality, secrets, substring, suffix, urlfilter
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_words(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"))
    return rows.drop("host_rate")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of one entry a page over all pages; list and fetch times are made from pages, as the tables hold none."""
    at = F.expr(f"timestamp '{urlfilter.FIRST_DAY} 00:00:00' + make_dt_interval(cast(page_id % 366 as int))")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched"))
    return urlfilter.temporal_filter(pages, urlfilter.derived_entries(pages))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


#: Target weights of the sources, by their names in order: the first weighs 5, the second 3, the third 2, the fourth 1, and so on again.
WEIGHTS = (5, 3, 2, 1)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents by unequal weights; the tables hold none, so ``WEIGHTS`` are dealt to the sources by name."""
    docs = table(spark, sf_dir, "documents")
    names = [r[0] for r in docs.select("source").where("source is not null").distinct().orderBy("source").limit(mixing.SOURCES + 1).collect()]
    weights = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    return mixing.schedule(docs, weights).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_substring_dedup,
        op3_suffix_dedup,
        op4_exact_top_k,
        op5_quality_rules,
        op6_packing,
        op7_url_filter,
        op8_minhash_near_dedup,
        op9_source_mixing,
        op10_language_id,
    )
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING,
    "op3_suffix_dedup": oracles.SUFFIX,
    "op4_exact_top_k": oracles.TOP_K,
    "op5_quality_rules": oracles.QUALITY,
    "op7_url_filter": oracles.URL_FILTER.format(first=urlfilter.FIRST_DAY),
}
