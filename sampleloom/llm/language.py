"""Language ID by word-first backoff: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, spread

#: Labelled rows that a model is fitted on, about; a hash of doc_id and text picks them.
FIT_ROWS = 8_000
#: The longest character n-gram.
LONGEST = 5
#: Calibration of the score, not of the language: a text's words aren't independent, so its mean log frequencies count as those of this
#: many words at most. The README has how often scores of held-out documents are right.
EVIDENCE = 12
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Unseen words whose scores a worker remembers, distinct words that it counts before it hands on their n-grams' counts,
#: and distinct n-grams in a batch of counts, about.
_CACHE, _HELD, _GRAMS = 100_000, 8_000, 300_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out from learning: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters(text: str | None) -> list[str]:
    words = _LETTERS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def _grams(word: str, n: int) -> list[str]:
    word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (n, gram, lang, count) of a task's documents; n = 0 for whole words."""
    seen: dict[str, Counter[str]] = {}

    def counts(lang: str, out: Counter[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), pa.array([lang] * len(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["n", "gram", "lang", "count"])

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            out: Counter[tuple[int, str]] = Counter()
            for w, k in words.items():
                out[0, w] += k
                for n in range(1, LONGEST + 1):
                    for g in _grams(w, n):
                        out[n, g] += k
                if len(out) > _GRAMS:
                    yield counts(lang, out)
                    out = Counter()
            yield counts(lang, out)
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen.setdefault(lang, Counter()).update(_letters(text.as_py()))
            if sum(map(len, seen.values())) > _HELD:
                yield from flush()
    yield from flush()


@dataclass
class LanguageModel:
    """Log frequencies: tables[0] of words, tables[n] of n-grams, each a row of `scores` (a column per language)."""

    langs: list[str]
    tables: list[dict[str, int]]
    scores: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, fit_rows: int = FIT_ROWS, least: int = 3) -> LanguageModel:
        """Learns from text and lang of about fit_rows documents with a lang that aren't held out.

        Words and n-grams seen fewer than `least` times are left out. Counting runs in the tasks; the driver gets the
        summed counts of that bounded sample.
        """
        docs = spread(bounded_batches(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
        known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        total = known.count()
        if total > fit_rows:
            known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
        counts = known.select("lang", "text").mapInArrow(_count, "n int, gram string, lang string, count long")
        counts = counts.groupBy("n", "gram", "lang").agg(F.sum("count").alias("count"))
        enough = counts.groupBy("n", "gram").agg(F.collect_list(F.struct("lang", "count")).alias("by"), F.sum("count").alias("total")).where(F.col("total") >= least)
        rows = enough.select("n", "gram", F.explode("by").alias("x")).select("n", "gram", "x.lang", "x.count").toArrow()
        return cls.of(rows["n"].to_pylist(), rows["gram"].to_pylist(), rows["lang"].to_pylist(), rows["count"].to_pylist())

    @classmethod
    def of(cls, ns: list[int], grams: list[str], langs: list[str], counts: list[int]) -> LanguageModel:
        names = sorted(set(langs))
        column = {x: k for k, x in enumerate(names)}
        tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        size = 0
        for n, g in sorted(zip(ns, grams, strict=True)):
            if g not in tables[n]:
                tables[n][g] = size
                size += 1
        raw = np.zeros((size, len(names)))
        for n, g, lang, c in zip(ns, grams, langs, counts, strict=True):
            raw[tables[n][g], column[lang]] += c
        scores = np.zeros_like(raw)
        for t in tables:
            if t:
                rows = np.fromiter(t.values(), int)
                # add-half smoothing within each table and language
                scores[rows] = np.log((raw[rows] + 0.5) / (raw[rows].sum(axis=0) + 0.5 * len(rows)))
        return cls(names, tables, scores)

    def rows(self, word: str) -> list[int]:
        """The score rows of a word: its own if it is known, else of its longest known n-grams."""
        k = self.tables[0].get(word)
        if k is not None:
            return [k]
        for n in range(LONGEST, 0, -1):
            t = self.tables[n]
            if found := [k for g in _grams(word, n) if (k := t.get(g)) is not None]:
                return found
        return []

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (its share of probability over EVIDENCE words at most) of each text."""
        if "_unseen" not in self.__dict__:
            self._unseen: dict[str, int] = {}
            self._table = np.vstack([self.scores, np.zeros((_CACHE + 1, len(self.langs)))]).astype(np.float32)
        known, unseen, table, base = self.tables[0], self._unseen, self._table, len(self.scores)
        langs, scores = [], []
        for text in texts:
            words = Counter(_letters(text))
            if not words or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, new, rows, ends = [], [], [], []
            for w in words:
                k = known.get(w)
                if k is None:
                    k = unseen.get(w)
                    if k is None:
                        k = -1 - len(new)
                        new.append(w)
                        rows += self.rows(w)
                        ends.append(len(rows))
                at.append(k)
            places = np.array(at)
            n = np.fromiter(words.values(), float, len(words))
            found = table[np.maximum(places, 0)]
            if new:  # the mean of each unseen word's n-grams; a word without any counts nothing
                sums = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self.scores[rows], axis=0)])
                last = np.array(ends)
                first = np.concatenate([[0], last[:-1]])
                means = (sums[last] - sums[first]) / np.maximum(last - first, 1)[:, None]
                found[places < 0] = means[-1 - places[places < 0]]
                room = _CACHE - len(unseen)  # words that come first are the frequent ones: a full table stays
                for w, m in zip(new[:room], means, strict=False):
                    table[base + len(unseen)] = m
                    unseen[w] = base + len(unseen)
            mean = n @ found / n.sum()
            p = np.exp((mean - mean.max()) * min(EVIDENCE, n.sum()))
            best = int(p.argmax())
            langs.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_unseen", "_table")}


def identify_languages(docs: DataFrame, *, fit_rows: int = FIT_ROWS, model: LanguageModel | None = None) -> DataFrame:
    """docs with lang_pred and score appended; every column of docs stays.

    The two names get underscores where docs has them already (see result_names). lang_pred is a learned language, or `und` with score 0 where the text is null or has
    no letter, or nothing was learned. Only the text decides. Ties go to the language that sorts first. Long texts count whole, rows that repeat an id or a text
    each get the same answer, an empty table gives no rows. For learning, a document whose rows repeat counts as often as it is there.
    """
    docs = bounded_batches(docs)
    model = model or LanguageModel.fit(docs, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit_rows

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        langs, scores = shared.value.predict(None if t is None or t != t else t for t in texts)
        return pd.DataFrame({"lang_pred": langs, "score": [min(1.0, max(0.0, s)) if math.isfinite(s) else 0.0 for s in scores]})

    pred, score = result_names(docs)
    found = free_name(docs, "found", pred, score)
    rows = spread(docs).withColumn(found, predict(F.col("text").cast("string")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{found}`.lang_pred").alias(pred), F.col(f"`{found}`.score").alias(score))


def result_names(docs: DataFrame) -> tuple[str, str]:
    """The names that identify_languages gives its two columns."""
    return free_name(docs, "lang_pred"), free_name(docs, "score")
