"""Lookups in public web services, with the fetcher given by the caller, and their cache as a table.

``fetch`` runs on the executors, a batch of ids at a time. ``http_fetch`` is a plain one with retries; tests and offline use give
their own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the services' clients.
RETRIES, BACKOFF, RETRY_STATUS, PAGE_SIZE, POLL_SECONDS, BATCH = 5, 0.25, (500, 502, 503, 504), 500, 3, 50


def http_fetch(url: str, timeout: float = 60) -> str:
    """The body at an address; server errors are tried again with growing pauses."""
    import urllib.error
    import urllib.request

    for attempt in range(RETRIES + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:
                return reply.read().decode()
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == RETRIES:
                raise
            time.sleep(BACKOFF * 2**attempt)
    raise AssertionError


def map_ids(ids: DataFrame, fetch: Callable[[list[str]], list[dict]], batch: int = BATCH) -> DataFrame:
    """(accession, body) for each id that the service knows; the last of several answers wins."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            todo = part["id"].tolist()
            found: dict[str, str] = {}
            for at in range(0, len(todo), batch):
                for r in fetch(todo[at : at + batch]):
                    found[r["from"]] = json.dumps(r["to"])
            yield pd.DataFrame({"accession": list(found), "body": list(found.values())})

    return ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct().mapInPandas(run, "accession string, body string")


def _path(body: Column, *paths: str) -> Column:
    v = F.try_parse_json(body)
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths), F.lit(""))


def extract_names(bodies: DataFrame) -> DataFrame:
    """accession, geneName and fullName from the services' records, by their order of preference; empty where there is none."""
    return bodies.select(
        "accession",
        _path(F.col("body"), "$.genes[0].geneName.value", "$.genes[0].orfNames[0].value").alias("geneName"),
        _path(F.col("body"), "$.proteinDescription.recommendedName.fullName.value", "$.proteinDescription.submissionNames[0].fullName.value").alias("fullName"),
    )


def lookup_with_cache(ids: DataFrame, fetch: Callable[[list[str]], list[dict]], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Names of the ids, and the cache with what was new. Only ids that the cache lacks are asked for; its rows win."""
    wanted = ids.select(F.col("id").alias("accession")).distinct()
    missing = wanted if cache is None else wanted.join(cache.select("accession"), "accession", "left_anti")
    new = extract_names(map_ids(missing.select(F.col("accession").alias("id")), fetch))
    grown = new if cache is None else cache.select("accession", "geneName", "fullName").unionByName(new)
    return grown.join(wanted, "accession", "left_semi"), grown


def output_names(rows: DataFrame, extra: list[str], key: str = "uniprotID", delimiter: str = "__") -> DataFrame:
    """``out_name``: the id and further columns, joined."""
    return rows.withColumn("out_name", F.concat_ws(delimiter, F.col(key), *(F.col(c) for c in extra)))


def download_models(rows: DataFrame, fetch: Callable[[str], str], api: str, key: str = "uniprotID", extra: list[str] | None = None, delimiter: str = "__") -> DataFrame:
    """(uniprotID, out_name, pdb, pae, message) from a model service: its answer names the addresses of both files.

    An id that the service does not know gets a message and no files.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, name in zip(part["id"], part["out_name"], strict=True):
                try:
                    found = json.loads(fetch(api.format(i)))[0]
                    out.append((i, name, fetch(found["pdbUrl"]), fetch(found["paeDocUrl"]), None))
                except Exception as e:  # noqa: BLE001  one missing model does not stop the others
                    out.append((i, name, None, None, f"not found: {e}"))
            yield pd.DataFrame(out, columns=["uniprotID", "out_name", "pdb", "pae", "message"])

    named = output_names(rows, extra or [], key, delimiter).select(F.col(key).alias("id"), "out_name")
    return named.mapInPandas(run, "uniprotID string, out_name string, pdb string, pae string, message string")
