"""Language identification by word-first backoff.

Known words score by their log frequency in each language; a word that no language knows falls back to the longest
character n-grams of it that are known, from ``MAX_N`` characters down to one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, map_rows, map_table

WORDS = re.compile(r"[^\W\d_]+")
MAX_N = 4
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return [w for w in WORDS.findall(text.lower()) if w.isalpha()] if text else []


def ngrams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies of units by language: table 0 of words, table n of n-grams.

    ``base`` holds what a unit scores in the languages that did not show it, and ``start``, ``lang`` and ``gain`` how much
    more it scores in those that did, so the size follows the units and not their product with the languages.
    """

    langs: list[str]
    units: list[dict[str, int]]
    start: list[np.ndarray]
    lang: list[np.ndarray]
    gain: list[np.ndarray]
    base: np.ndarray

    @classmethod
    def fit(cls, counts: list[tuple[str, int, str, int]]) -> Model:
        """From rows of language, table, unit and count. Frequencies are add-half smoothed."""
        langs = sorted({c[0] for c in counts})
        at = {lang: i for i, lang in enumerate(langs)}
        model = cls(langs, [], [], [], [], np.zeros((MAX_N + 1, len(langs))))
        by: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(MAX_N + 1)]
        for lang, n, unit, count in counts:
            by[n].setdefault(unit, []).append((at[lang], count))
        for n, own in enumerate(by):
            pairs = [p for rows in own.values() for p in rows]
            lang, count = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], float)
            total = np.bincount(lang, count, len(langs)) + 0.5 * len(own) + 1
            model.base[n] = np.log(0.5) - np.log(total)
            model.units.append({unit: i for i, unit in enumerate(own)})
            model.start.append(np.cumsum([0] + [len(rows) for rows in own.values()]))
            model.lang.append(lang)
            model.gain.append(np.log(count + 0.5) - np.log(0.5))
        return model

    def word_scores(self, words: list[str]) -> np.ndarray:
        """For each word its log frequencies, or their mean over its known n-grams of the greatest length that has any."""
        out = np.zeros((len(words), len(self.langs)))
        left = list(enumerate(words))
        for n in (0, *range(MAX_N, 0, -1)):
            get, owner, unit, rest = self.units[n].get, [], [], []
            for i, word in left:
                known = [u for g in ([word] if n == 0 else ngrams(word, n)) if (u := get(g)) is not None]
                if known:
                    owner += [i] * len(known)
                    unit += known
                else:
                    rest.append((i, word))
            if unit:
                who, which = np.array(owner), np.array(unit)
                own, share = np.unique(who), 1 / np.bincount(who, minlength=len(words))[who]
                first, size = self.start[n][which], np.diff(self.start[n])[which]
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                out[own] = self.base[n]
                np.add.at(out, (np.repeat(who, size), self.lang[n][at]), self.gain[n][at] * np.repeat(share, size))
            left = rest
        return out


class Scorer:
    """Predictions of a task, which remembers the scores of words."""

    def __init__(self, model: Model, room: int = 1 << 22):
        self.model, self.code = model, {}
        self.most = max(1024, room // max(len(model.langs), 1))
        self.scores = np.zeros((0, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.code]
        if len(self.code) + len(new) > self.most:
            self.code, self.scores, new = {}, self.scores[:0], list(words)
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        if self.code and max(len(self.code), 1) > len(self.scores):
            bigger = np.zeros((2 * len(self.code), self.scores.shape[1]))
            bigger[: len(self.scores)] = self.scores
            self.scores = bigger
        if new:
            self.scores[len(self.code) - len(new) : len(self.code)] = self.model.word_scores(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share of the likelihood, tempered to the mean evidence of a word; ties go to the lesser name."""
        langs, out, at = self.model.langs, [], 0
        own = [words_of(t) for t in texts]
        sums = np.zeros((len(texts), len(langs)))
        while at < len(own):  # some hundred thousand words at a time, or a text
            to, n = at + 1, len(own[at])
            while to < len(own) and n + len(own[to]) <= 1 << 17:
                n += len(own[to])
                to += 1
            flat = [w for words in own[at:to] for w in words]
            self.learn(set(flat))
            rows = self.scores[np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))]
            np.add.at(sums, np.repeat(np.arange(at, to), [len(w) for w in own[at:to]]), rows)
            at = to
        for text, words, total in zip(texts, own, sums, strict=True):
            if not langs or not words and not any(map(str.isalpha, text or "")):
                out.append((UNKNOWN, 0.0))
                continue
            mean = total / max(len(words), 1) * min(len(words), 8)
            share = np.exp(mean - mean.max())
            best = int(share.argmax())
            out.append((langs[best], float(share[best] / share.sum())))
        return out


def _count_units():
    def step(cols: dict[str, list]) -> dict[str, list]:
        words: Counter = Counter()
        for lang, text in zip(cols["lang"], cols["text"], strict=True):
            words.update((lang, w) for w in words_of(text))
        tally: Counter = Counter()
        for (lang, word), k in words.items():
            tally[lang, 0, word] = k
            for n in range(1, MAX_N + 1):
                for g in ngrams(word, n):
                    tally[lang, n, g] += k
        return {"lang": [k[0] for k in tally], "n": [k[1] for k in tally], "unit": [k[2] for k in tally], "count": list(tally.values())}

    return step


def held_out() -> F.Column:
    """Documents that training never sees: the crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: More languages than this are an error.
LANGUAGES = 10_000


def train(docs: DataFrame, sample_docs: int = 4_000, units: int = 20_000, all_units: int = 2_000_000) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out third.

    ``sample_docs`` bounds the expected number of training documents, the same for each language (and at least one); a document is
    chosen by the hash of its id and text, so any run chooses alike. ``units`` bounds the words and the n-grams of each length that a
    language keeps, the most frequent ones (ties: the lesser unit), and ``all_units`` those of all languages together, and with them the model that
    is sent to the executors. An empty table gives a model without languages; more than ``LANGUAGES`` languages are an error.
    """
    rows = keyed(docs, "doc_id", "text", "lang", doc_id="long").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model.fit([])
    each = max(1, sample_docs // len(sizes))
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in sizes.items()], "l string, rate double")
    chosen = rows.join(F.broadcast(rates), F.col("lang") == F.col("l")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < F.col("rate") * 1_000_000_000)
    counts = map_rows(chosen.select("lang", "text"), _count_units, "lang string, n int, unit string, count long").groupBy("lang", "n", "unit").agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "unit"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= min(units, max(1, all_units // len(sizes)))).select("lang", "n", "unit", "count").collect()
    return Model.fit(sorted(map(tuple, kept)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Text alone decides. ``lang_pred`` is ``und`` with score 0 where the text is null, empty or has no letter, or where nothing
    was learned. Null ids are never held out; repeated rows each get their row; other columns are ignored; an empty table gives an
    empty result; a text of any length is read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``all_units`` units for each of five tables

    def make():
        scorer = Scorer(shared.value)

        def step(cols: dict[str, list]) -> dict[str, list]:
            found = scorer.predict(cols["text"])
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return step

    rows = keyed(docs, "doc_id", "text", doc_id="long").select("doc_id", "text", held_out().alias("held_out"))
    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def filter_languages(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least ``min_score``, columns unchanged but for ``lang``.

    ``lang`` becomes the predicted language. Texts that are null or without letters go; repeated rows stay; an empty table stays empty. The prediction runs beside the other columns, so no join is needed.
    """
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.predict(batch.column("text").to_pylist())
            keep = pa.array([f[0] != UNKNOWN and f[1] >= min_score for f in found])
            at = batch.schema.get_field_index("lang")
            yield batch.set_column(at, batch.schema.field(at), pa.array([f[0] for f in found], batch.schema.field(at).type)).filter(keep)

    return map_table(docs, run)
