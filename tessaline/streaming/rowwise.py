"""Row-local operators on streams, and grouped ones within each micro-batch.

Filters, projections and lookups against static tables work on a streaming DataFrame as they are. Operators that rank or
cluster need bounded input; ``per_batch`` applies them to each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import cigar_matches, coverage


def read_alignments(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated alignment files as they arrive, all columns as text; headers and blank lines are skipped."""
    cells = F.split("value", "\t", -1)
    rows = spark.readStream.text(path).where((F.col("value") != "") & (F.get(cells, F.lit(0)) != names[0]))
    return rows.select(*(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)))


def filter_stream(df: DataFrame, field: str = "alntmscore", low: float = 0.4, high: float = 1.0) -> DataFrame:
    from ..operators.alignments import range_filter

    return range_filter(df, field, low, high)


def coverage_stream(df: DataFrame, cigar: str = "cigar", qlen: str = "qlen", tlen: str = "tlen") -> DataFrame:
    m = cigar_matches(F.col(cigar))
    return df.withColumns({"cigar_qcov": coverage(m, F.col(qlen).try_cast("long")), "cigar_tcov": coverage(m, F.col(tlen).try_cast("long"))})


def windowed_counts(df: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and keys; rows later than the watermark allows are left out by Spark."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).count().select(F.col("window.start").alias("window_start"), *keys, "count")


def per_batch(df: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs an operator on every micro-batch and writes its rows below ``path``, one folder a batch, so a replay overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
