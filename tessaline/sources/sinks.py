"""Writers. Files are written by the executors through Spark; a single file is an option for parity with small tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import float_text


def as_text(df: DataFrame, columns: Sequence[str] | None = None, missing: str = "", list_sep: str = ",") -> DataFrame:
    """All columns as a format writes them: floats by their shortest text, lists joined, nulls as ``missing``."""
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        t = types[c]
        col = F.col(f"`{c}`")
        if t in ("double", "float"):
            col = float_text(col.cast("double"))
        elif t == "boolean":
            col = F.when(col, "True").otherwise(F.when(~col, "False"))
        elif t.startswith("array"):
            col = F.array_join(F.transform(col, lambda x: x.cast("string")), list_sep, missing)
        else:
            col = col.cast("string")
        return F.coalesce(col, F.lit(missing)).alias(c)

    return df.select(*map(cell, columns or df.columns))


def serialise(df: DataFrame, columns: Sequence[str] | None = None, sep: str = "\t", guard: bool = False) -> DataFrame:
    """One text column ``value``; with ``guard`` separators within values become underscores."""
    t = as_text(df, columns)
    return t.select(F.concat_ws(sep, *(F.replace(F.col(f"`{c}`"), F.lit(sep), F.lit("_")) if guard else F.col(f"`{c}`") for c in t.columns)).alias("value"))


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, header: bool = True, sep: str = "\t", mode: str = "overwrite", single: bool = False, order: Sequence[str] | None = None, guard: bool = False) -> None:
    """Delimited text. With a header each part file starts with it; ``single`` writes one part for small results."""
    columns = list(columns or [c for c in df.columns if c != "ordinal"])
    out = df.orderBy(*order) if order else df
    text = serialise(out, columns, sep, guard)
    if single:
        text = text.coalesce(1)
    if header:
        text.select(F.col("value").alias(sep.join(columns).replace("`", ""))).write.mode(mode).option("header", True).option("quote", "\u0000").option("escape", "\u0000").option("sep", "\u0001").option("emptyValue", "").csv(path)
    else:
        text.write.mode(mode).text(path)


def append_table(df: DataFrame, path: str, **options) -> None:
    write_table(df, path, header=False, mode="append", **options)


def write_csv(df: DataFrame, path: str, quoted: bool = True, single: bool = False) -> None:
    if not quoted:
        write_table(df, path, sep=",", single=single)
        return
    text = as_text(df)
    (text.coalesce(1) if single else text).write.mode("overwrite").option("header", True).csv(path)


def write_fasta(df: DataFrame, path: str, name: str = "id", seq: str = "seq", mode: str = "overwrite", single: bool = False, order: Sequence[str] | None = None) -> None:
    """Two lines a record; sequences are never wrapped."""
    out = df.orderBy(*order) if order else df
    text = out.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))
    (text.coalesce(1) if single else text).write.mode(mode).text(path)


def write_files(files: DataFrame, directory: str, path: str = "path", text: str = "text") -> None:
    """One file for each row of (path, text), written by the executors through Hadoop's file systems where Python sees no such path.

    ``directory`` must be one that executors share. Names keep letters, digits, dots, dashes, underscores and slashes.
    """
    safe = F.regexp_replace(F.regexp_replace(F.col(path), r"[^A-Za-z0-9._/-]", "_"), r"(^|/)\.+(?=/|$)", "$1_")

    def save(rows) -> None:
        import os

        for r in rows:
            target = os.path.join(directory, r.path.lstrip("/"))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{os.getpid()}.part"
            with open(partial, "w") as f:
                f.write(r.text)
            os.replace(partial, target)  # a task that runs twice leaves one whole file

    files.select(safe.alias("path"), F.col(text).alias("text")).foreachPartition(save)


def pdb_text(atoms: DataFrame, group: Sequence[str] = ("file",)) -> DataFrame:
    """(*group, text) of single-model structures: serials restart at 1, a TER line ends each chain, and END the file.

    Lines are copied from ``line`` with serial and residue number set anew.
    """
    w = Window.partitionBy(*group).orderBy("atom_ordinal")
    nxt = F.lead("chain").over(w)
    a = atoms.withColumns({"_i": F.row_number().over(w), "_last": nxt.isNull() | (nxt != F.col("chain"))})
    a = a.withColumn("_serial", F.col("_i") + F.coalesce(F.sum(F.col("_last").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = lambda c: F.lpad(c.cast("string"), 5, " ")
    body = F.concat(F.rpad(F.substring("line", 1, 6), 6, " "), number(F.col("_serial")), F.lit(" "), F.substring("line", 13, 10), F.lpad(F.col("resseq").cast("string"), 4, " "), F.substring("line", 27, 80))
    ter = F.concat(F.lit("\nTER   "), number(F.col("_serial") + 1), F.lit("      "), F.lpad("resname", 3, " "), F.lit(" "), F.col("chain"), F.lpad(F.col("resseq").cast("string"), 4, " "), F.rpad(F.coalesce("icode", F.lit("")), 1, " "), F.lit(" " * 53))
    a = a.select(*group, "_i", F.concat(body, F.when(F.col("_last"), ter).otherwise("")).alias("t"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "t"))), lambda x: x["t"]), "\n")
    return a.groupBy(*group).agg(F.concat(lines, F.lit("\nEND   \n")).alias("text"))


def write_pdb(atoms: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The structures of ``atoms``, one after another, each as ``pdb_text`` gives it."""
    pdb_text(atoms).select(F.regexp_replace("text", "\n$", "").alias("value")).coalesce(1).write.mode(mode).text(path)
