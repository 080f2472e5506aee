"""Temporal list join: URL filters by what a dated list held when a page was fetched.

Dated entries (key, date, action) become validity intervals for each key, and every capture is joined as of its fetch time to
the intervals of the keys that its URL falls under: its host, all parent domains, and host with every path prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Fetch times of the query: pages carry none, so page_id counts days from here, modulo 366.
FIRST_DAY = "2024-01-01"


def intervals(entries: DataFrame) -> DataFrame:
    """``(key, since, until)``: a block lasts until the next allow of its key; repeated blocks extend, not restart.

    Entries of one key and date: the block wins. Entries with a null are ignored. The host of a key counts in lower case, its path as it is.
    """
    host = F.substring_index("key", "/", 1)
    e = entries.select(F.concat(F.lower(host), F.expr("substr(key, length(substring_index(key, '/', 1)) + 1)")).alias("key"), F.col("listed").cast("timestamp").alias("listed"), F.col("action"))
    e = e.where("key is not null and listed is not null and action is not null")
    e = e.groupBy("key", "listed").agg(F.max((F.col("action") == "block").cast("int")).alias("on"))
    w = Window.partitionBy("key").orderBy("listed")
    e = e.withColumn("before", F.lag("on", 1, 0).over(w)).where("on <> before")
    return e.withColumn("until", F.lead("listed").over(w)).where("on = 1").select("key", F.col("listed").alias("since"), "until")


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host of a URL, lower case without user, port and last dot, and the parts of its path."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    host = F.when(host != "", host)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return host, F.filter(F.split(path, "/"), lambda p: p != "")


def keys_of(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host of a URL and all keys that it falls under; the parts of a numeric address are no domains."""
    host, parts = host_and_path(url)
    labels = F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return host, F.array_distinct(F.concat(domains, prefixes))


def temporal_filter(captures: DataFrame, entries: DataFrame, page: str = "page_id", url: str = "url", fetched: str = "fetched", small: int = 100_000) -> DataFrame:
    """page_id, host, n_active, blocked, matched_key and active_since for every row of ``captures``.

    ``n_active`` counts the entries active at fetch time; the longest of their keys is ``matched_key``, with the start of its interval.
    A null or unparsable URL has a null host, and it and a null fetch time match nothing. Each distinct pair of URL and time is
    evaluated once, so repeated rows cost a join and all get their row; null ids stay null; an empty table gives an empty result; other
    columns are ignored, whatever their names. Intervals are
    broadcast if there are at most ``small``; otherwise both joins are shuffles whose skewed keys Spark splits.
    """
    rows = captures.select(F.col(f"`{page}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("_url"), F.col(f"`{fetched}`").cast("timestamp").alias("_at"))
    spans = materialise(intervals(entries), "intervals")
    if spans.limit(small + 1).count() <= small:
        spans = F.broadcast(spans)
    keys = rows.select("_url", "_at").where("_url is not null and _at is not null").distinct().select("_url", "_at", F.explode(keys_of(F.col("_url"))[1]).alias("key"))
    hits = keys.join(spans, (keys["key"] == spans["key"]) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    hits = hits.groupBy("_url", "_at").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length(keys["key"]).alias("n"), keys["key"].alias("key"), F.col("since"))).alias("best"))
    hits = materialise(hits.select(F.col("_url").alias("_u"), F.col("_at").alias("_t"), "n_active", F.col("best.key").alias("matched_key"), F.col("best.since").alias("active_since")), "verdicts")
    out = rows.join(hits, (F.col("_url") == F.col("_u")) & (F.col("_at") == F.col("_t")), "left")
    return out.select("page_id", keys_of(F.col("_url"))[0].alias("host"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce(F.col("n_active") > 0, F.lit(False)).alias("blocked"), "matched_key", F.date_format("active_since", "yyyy-MM-dd").alias("active_since"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list for tables that hold none: an entry for each page (page_id, url) with a host.

    By page_id modulo 3 the key is the page's host, its host with the first part of its path (or the host), or its host without the
    first label (or the host, if it has two). The entry is dated 7 page_id days after ``FIRST_DAY``, modulo 366, and allows
    where 13 page_id leaves 3 or 4 modulo 5.
    """
    host, parts = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), parts.alias("parts")).where("host is not null")
    key = F.expr("""
      CASE WHEN page_id % 3 = 1 AND size(parts) > 0 THEN concat(host, '/', parts[0])
           WHEN page_id % 3 = 2 AND size(split(host, '[.]')) > 2 AND NOT host RLIKE '^[0-9.]+$' THEN substr(host, instr(host, '.') + 1)
           ELSE host END""")
    listed = F.expr(f"date_add(date '{FIRST_DAY}', cast(7 * page_id % 366 as int))").cast("string")
    return p.select(key.alias("key"), listed.alias("listed"), F.expr("if(13 * page_id % 5 < 3, 'block', 'allow')").alias("action"))
