"""FASTA and GenBank."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_fasta(spark: SparkSession, path: str | list[str], keep_last: bool = True) -> DataFrame:
    """``(ordinal, id, description, seq)`` of FASTA files, plain or gzip; the id is the header's first word.

    Records are cut at line starts by the text reader's own delimiter, so a large file is read by many tasks. With ``keep_last``
    the last of repeated ids wins, at the place of the first.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).alias("ordinal"))
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    header = F.substring_index(record, "\n", 1)
    df = raw.where(F.trim(record) != "").select("ordinal", F.regexp_extract(header, r"^(\S*)", 1).alias("id"), header.alias("description"), F.regexp_replace(F.substr(record, F.length(header) + 1), r"\s+", "").alias("seq"))
    if not keep_last:
        return df
    last = df.groupBy("id").agg(F.min("ordinal").alias("ordinal"), F.max_by("description", "ordinal").alias("description"), F.max_by("seq", "ordinal").alias("seq"))
    return last.select("ordinal", "id", "description", "seq")


_LOCATION = re.compile(r"\d+")


def parse_genbank(text: str) -> Iterator[dict]:
    """Records of a GenBank file as name, and features of type, start (0-based), end, strand and qualifiers. Broken ones are skipped."""
    for chunk in re.split(r"^//\s*$", text, flags=re.MULTILINE):
        name = re.search(r"^LOCUS\s+(\S+)", chunk, re.MULTILINE)
        body = re.search(r"^FEATURES.*?\n(.*?)(?=^\S|\Z)", chunk, re.MULTILINE | re.DOTALL)
        if not name:
            continue
        features = []
        for part in re.split(r"\n(?=     \S)", body[1].rstrip("\n")) if body else []:
            head = re.match(r"     (\S+)\s+([^/]*?)(?=\n\s+/|\Z)", part, re.DOTALL)
            numbers = [int(n) for n in _LOCATION.findall(re.sub(r"[A-Za-z_][\w.]*:", "", head[2]))] if head else []
            if not numbers:
                continue
            qualifiers: dict[str, list[str]] = {}
            for key, quoted, plain in re.findall(r'\n\s+/(\w+)(?:=(?:"((?:[^"]|"")*)"|([^\n]*)))?', part[head.end() :]):
                value = re.sub(r"\s*\n\s+", "" if key == "translation" else " ", quoted).replace('""', '"') if quoted else plain.strip()
                qualifiers.setdefault(key, []).append(value)
            features.append({"type": head[1], "start": min(numbers) - 1, "end": max(numbers), "strand": -1 if "complement" in head[2] else 1, "qualifiers": qualifiers})
        yield {"name": name[1], "features": features}


def scan_genbank(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, name, features)``; a file is parsed as a whole, records of many files in parallel."""
    schema = "file string, n int, name string, features array<struct<type:string,start:int,end:int,strand:int,qualifiers:map<string,array<string>>>>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"file": f, "n": i, **r} for f, t in zip(part["file"], part["value"], strict=True) for i, r in enumerate(parse_genbank(t))]
            yield pd.DataFrame(rows, columns=["file", "n", "name", "features"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.mapInPandas(run, schema).select(F.struct("file", "n").alias("ordinal"), "name", "features")


def genbank_proteins(records: DataFrame, delimiter: str = "__", accessions: DataFrame | None = None) -> DataFrame:
    """A row for each coding sequence: name, scaffold, locus_tag, protein_id, start, end, strand, gene_order, organism_name,
    protein_name and sequence. ``accessions`` (id), if it has any, keeps the records it names."""
    from ..functions.text import pad_to_five_digits, remove_bad_characters

    if accessions is not None and accessions.limit(1).count():
        records = records.join(accessions.select(F.col("id").alias("name")), "name", "left_semi")
    coding = records.select("ordinal", "name", F.posexplode(F.filter("features", lambda f: f["type"] == "CDS")).alias("i", "f"))
    q = lambda key, default: F.coalesce(F.get(F.try_element_at(F.col("f.qualifiers"), F.lit(key)), F.lit(0)), F.lit(default))
    order = pad_to_five_digits(F.col("i") + 1)
    tag = remove_bad_characters(q("locus_tag", "X"))
    return coding.select(
        "ordinal", F.concat_ws(delimiter, "name", q("protein_id", "X"), tag, order).alias("out_name"), F.col("name").alias("scaffold"), tag.alias("locus_tag"), q("protein_id", "X").alias("protein_id"), F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.strand").alias("strand"), order.alias("gene_order"), remove_bad_characters(F.col("name")).alias("organism_name"), remove_bad_characters(q("product", "X")).alias("protein_name"), q("translation", "None").alias("sequence")
    ).withColumnRenamed("out_name", "name")


def chunk_sequences(seqs: DataFrame, max_length: int, min_length: int = 50, overlapping: bool = False) -> DataFrame:
    """``(ordinal, part, id, seq)``: sequences up to ``max_length`` pass whole, longer ones in windows named ``PART{i}_{id}``.

    The part number counts windows before those shorter than ``min_length`` are dropped.
    """
    from ..functions.sequences import chunks

    whole = seqs.where(F.length("seq") <= max_length).select("ordinal", F.lit(0).alias("part"), "id", "seq")
    cut = seqs.where(F.length("seq") > max_length).select("ordinal", "id", F.posexplode(chunks(F.col("seq"), max_length, overlapping)).alias("part", "seq"))
    cut = cut.select("ordinal", "part", F.concat(F.lit("PART"), F.col("part"), F.lit("_"), F.col("id")).alias("id"), "seq")
    return whole.unionByName(cut).where(F.length("seq") >= min_length)


def multimerise(seqs: DataFrame, cardinality: list[int], order: str = "ordinal", group: list[str] | None = None) -> DataFrame:
    """One sequence from several in order, each repeated by its cardinality and all joined by colons."""
    from ..functions.sequences import multimer

    packed = seqs.groupBy(*(group or [])).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("seq").alias("seq")))).alias("s"))
    return packed.select(*(group or []), multimer(F.col("s.seq"), F.array(*map(F.lit, cardinality))).alias("seq"))


def one_sequence_a_file(seqs: DataFrame) -> DataFrame:
    """The sequences, after a check that every file holds exactly one."""
    n = F.count("*").over(Window.partitionBy("ordinal.file"))
    return seqs.withColumn("_n", n).withColumn("seq", F.when(F.col("_n") == 1, F.col("seq")).otherwise(F.raise_error(F.lit("a file with more than one sequence")).cast("string"))).drop("_n")
