"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and code points 9 to 13, which are also what bytes.split() splits on.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *names: str, **types: str) -> DataFrame:
    """Only the named columns, in fixed types; whatever else ``docs`` holds cannot clash with an operator's own columns."""
    return docs.select(*(F.col(f"`{n}`").cast(types.get(n, "string")).alias(n) for n in names))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that none of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that a Python worker holds one whatever the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def map_rows(docs: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` over columns as Python lists. ``make`` is called once a task and gives the function for its batches."""
    bounded_batches(docs.sparkSession)
    target = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch.to_pydict())
            if out is not None:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return docs.mapInArrow(run, target)


def map_table(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` from a table to one of the same columns, whatever characters their names hold."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f"c{i}" for i in range(len(names))])

    return plain.mapInArrow(renamed, plain.schema).toDF(*names)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
