"""Host-level quality rules.

Rule failures of documents are counted by host, the hosts' failure rates are shrunk with a beta prior fitted to all hosts
by moments, and the verdicts on hosts are joined back to the documents.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .common import SPACES, keyed, map_rows, utf8

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows that the text holds twice or more, first occurrences included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    count, covered, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none of anything."""
    text = text or ""
    words = utf8(text).split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _features():
    def step(cols: dict[str, list]) -> dict[str, list]:
        rows = [text_features(t) for t in cols.pop("text")]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return cols | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return step


def document_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base features of every document, with ``base_failed``."""
    rows = keyed(docs, "doc_id", "text", host, doc_id="long").withColumnRenamed(host, "host")
    out = map_rows(rows, _features, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def host_rates(features: DataFrame) -> DataFrame:
    """A row for each host: documents, failures and the failure rate shrunk to the corpus.

    The prior is a beta distribution whose mean is the rate of all documents and whose strength comes from the variance
    between hosts beyond what binomial noise explains. Only six sums over hosts reach the driver.
    """
    hosts = materialise(features.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), "hosts")
    h, n, f, sq = hosts.agg(F.count("*"), F.sum("n"), F.sum("f"), F.sum(F.col("f").cast("double") * F.col("f") / F.col("n"))).first()
    mean = f / n if n else 0.0
    noise = mean * (1 - mean)
    between = max((sq / n - mean * mean) - noise * (h - 1) / n, 1e-9) if n else 1.0
    strength = min(max(noise / between - 1, 1.0), 1e6)
    return hosts.withColumn("rate", (F.col("f") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5, broadcast_hosts: int = 100_000) -> DataFrame:
    """Base features, ``base_failed`` and ``kept`` of every document (a row for each row of ``docs``).

    A host whose shrunk failure rate exceeds ``max_rate`` is rejected with all its documents; the others lose only the
    documents that fail the base rules. Documents of a null host share one host. Null and empty texts have no words and
    fail. Repeated rows count as often as they come; an empty table gives an empty result; other columns are ignored.
    The hosts are broadcast if there are at most ``broadcast_hosts``; otherwise the join is a shuffle whose skewed hosts
    Spark splits.
    """
    features = materialise(document_features(docs, host), "features")
    hosts = host_rates(features).select(F.col("host").alias("_host"), (F.col("rate") > max_rate).alias("host_rejected"), F.col("rate").alias("host_rate"))
    small = hosts.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    joined = features.join(F.broadcast(hosts) if small else materialise(hosts, "hosts"), F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"), "host_rate")
