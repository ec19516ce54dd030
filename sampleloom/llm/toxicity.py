"""Toxicity: cumulative-link ordinal regression on sparse words, with one set of weights for all thresholds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, spread, written

#: Labelled documents that a model is fitted on, about, features that it may use at most, and folds of the sample.
FIT_ROWS, WORDS, FOLDS = 12_000, 2000, 3
_LETTERS = re.compile(r"[^\W\d_]+")


def _tokens(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _marks(word: str) -> list[str]:
    """The features of a word: itself and its beginnings of 3 to 6 letters, which inflections and compounds share."""
    return [f"={word}", *(f"{word[:k]}*" for k in range(3, 7) if len(word) >= k)]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold each feature, all and the positive ones, by fold."""
    every: Counter[tuple[str, int]] = Counter()
    positive: Counter[tuple[str, int]] = Counter()
    for batch in batches:
        for text, grade, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = {(m, fold) for w in set(_tokens(text.as_py())) for m in _marks(w)}
            every.update(found)
            if grade > 0:
                positive.update(found)
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
    columns = [[w for w, _ in every], [f for _, f in every], list(every.values()), [positive[x] for x in every]]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "fold", "n", "n1"])


def _associated(counts: DataFrame, n: int, n1: int, most: int, least: int) -> list[str]:
    """The `most` features of counts (word, n, n1) whose presence tells n1 positive of n documents best, by likelihood ratio."""
    if not n1 or n1 == n:
        return []
    a, b = F.col("n1"), F.col("n") - F.col("n1")
    c, d = F.lit(n1) - a, F.lit(n - n1) - b
    part = lambda x, row, col: F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(0.0)
    g = part(a, F.col("n"), F.lit(n1)) + part(b, F.col("n"), F.lit(n - n1)) + part(c, n - F.col("n"), F.lit(n1)) + part(d, n - F.col("n"), F.lit(n - n1))
    return sorted(r.word for r in counts.where(F.col("n") >= least).select("word", g.alias("g")).orderBy(F.desc("g"), "word").limit(most).collect())


@dataclass
class _Sample:
    """The labelled sample on the driver: counts of the chosen features as CSR (at, index, count), labels and folds."""

    names: list[str]
    at: np.ndarray
    index: np.ndarray
    count: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    chosen: list[list[str]]

    def of(self, rows: np.ndarray, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The CSR arrays of some rows and features, with log(1 + count) as values."""
        place = {x: k for k, x in enumerate(names)}
        new = np.array([place.get(x, -1) for x in self.names], int)
        owner = np.repeat(np.arange(len(self.label)), np.diff(self.at))
        take = rows[owner] & (new[self.index] >= 0)
        at = np.concatenate([[0], np.cumsum(np.bincount(owner[take], minlength=len(rows))[rows])])
        return names, at, new[self.index[take]], np.log1p(self.count[take])


def _sampled(docs: DataFrame, words: int, folds: int, least: int = 5) -> _Sample:
    """The sample of docs (text, label, fold): features chosen from all rows (chosen[0]) and without each fold in turn."""
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(folds) for c in ("n", "n1")]
    counts = written(docs.mapInArrow(_count_words, "word string, fold int, n long, n1 long").groupBy("word").agg(*sums).where(" + ".join(f"n_{f}" for f in range(folds)) + f" >= {least}"), "features")
    per = {r.fold: (r.n, r.n1) for r in docs.groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("n1")).collect()}
    chosen = []
    for out in [None, *range(folds)] if folds > 1 else [None]:
        kept = [f for f in range(folds) if f != out]
        n, n1 = (sum(per.get(f, (0, 0))[k] for f in kept) for k in (0, 1))
        columns = [sum((F.col(f"{c}_{f}") for f in kept), F.lit(0)).alias(c) for c in ("n", "n1")]
        chosen.append(_associated(counts.select("word", *columns), n, n1, words, least))
    discard(counts)
    names = sorted({w for c in chosen for w in c})
    blank = OrdinalModel({w: k for k, w in enumerate(names)}, np.zeros(len(names)), np.zeros(1))
    shared = docs.sparkSession.sparkContext.broadcast(blank)  # words * (folds + 1) features at most

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.counts(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["index", "count", "label", "fold"])

    rows = docs.mapInArrow(sparse, "index array<int>, count array<int>, label int, fold int").toArrow().combine_chunks()  # bounded by the sample
    flat = lambda c: np.concatenate([np.zeros(0, np.int32), *[x.flatten().to_numpy() for x in rows[c].chunks]])
    size = np.concatenate([[0], *[np.diff(np.asarray(x.offsets)) for x in rows["index"].chunks]])
    return _Sample(names, np.cumsum(size), flat("index"), flat("count"), np.array(rows["label"].to_pylist(), int), np.array(rows["fold"].to_pylist(), int), chosen)


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]) with ascending thresholds; x has log(1 + count) of each feature."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, words: list[str], at: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, penalty: float = 2.0, rounds: int = 300) -> OrdinalModel:
        """Maximum likelihood with a squared penalty, by Adam over the whole sample; rows are CSR (at, index, value)."""
        k = max(1, int(grade.max(initial=0)))
        n, row = len(grade), np.repeat(np.arange(len(grade)), np.diff(at))
        share = np.array([np.clip((grade > j).mean() if n else 0.5, 1e-4, 1 - 1e-4) for j in range(k)])
        theta = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(k))
        w, first, gaps = np.zeros(len(words)), theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
        p = np.concatenate([w, [first], gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, rounds + 1 if n else 1):
            w, theta = p[: len(w)], p[len(w)] + np.concatenate([[0], np.cumsum(np.exp(p[len(w) + 1 :]))])
            eta = np.bincount(row, w[index] * value, n)
            above = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -30, 30)))
            full = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
            up, down = full[np.arange(n), grade], full[np.arange(n), grade + 1]
            prob = np.maximum(up - down, 1e-12)
            slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
            su, sd = slope[np.arange(n), grade] / prob, slope[np.arange(n), grade + 1] / prob
            g_eta = su - sd
            g_theta = np.array([(sd[grade == j]).sum() - (su[grade == j + 1]).sum() for j in range(k)])
            g_w = np.bincount(index, g_eta[row] * value, len(w)) - penalty * w
            tail = g_theta[::-1].cumsum()[::-1]
            g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(p[len(w) + 1 :])]) / n
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta = p[len(w)] + np.concatenate([[0], np.cumsum(np.exp(p[len(w) + 1 :]))])
        return cls({x: j for j, x in enumerate(words)}, p[: len(words)].copy(), theta)

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each feature is in a text; long texts count whole."""
        known, cache = self.words, self.__dict__.setdefault("_cache", {})
        if len(cache) > 100_000:
            cache.clear()
        found: Counter[int] = Counter()
        for w, c in Counter(_tokens(text)).items():
            own = cache.get(w)
            if own is None:
                own = cache[w] = tuple(k for m in _marks(w) if (k := known.get(m)) is not None)
            for k in own:
                found[k] += c
        return found

    def margin(self, text: str | None) -> float:
        found = self.counts(text)
        return float(self.weights[list(found)] @ np.log1p(list(found.values()))) if found else 0.0

    def above(self, texts: Iterable[str | None]) -> np.ndarray:
        """P(grade > k) for each text and k."""
        eta = np.array([self.margin(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About fit_rows different documents (text, toxic) with a label, picked by a hash of id and text; one label each, the largest.

    The number of rows is settled before: a document whose id or text repeats counts once, so no id brings in more than its different texts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    total = rows.select("doc_id").join(known, "doc_id").count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    return written(rows.join(known, "doc_id").dropDuplicates(["doc_id", "text"]).select("text", "toxic"), "labelled")


def fit_severity(graded: DataFrame, words: int = WORDS) -> OrdinalModel:
    """The model of documents with graded labels (text, grade 0, 1, ...); the driver gets their counts of the chosen features only."""
    rows = graded.select(F.col("text").cast("string").alias("text"), F.col("grade").cast("int").alias("label"), F.lit(0).alias("fold"))
    sample = _sampled(rows, words, 1)
    return OrdinalModel.fit(*sample.of(np.ones(len(sample.label), bool), sample.chosen[0]), sample.label)


def fit_toxicity(labelled: DataFrame, words: int = WORDS, folds: int = FOLDS) -> tuple[OrdinalModel, dict[str, float]]:
    """The model of documents (text, toxic 0/1), whose labels have no grades, and figures of rows that its parts never saw.

    Grades come from how sure a binary fit is of a document that it wasn't fitted on: for each fold features are
    chosen and weights fitted on the other folds. Documents that aren't toxic have grade 0; the toxic ones are cut
    into thirds of that margin, grades 1 to 3. The figures: auc, how often a toxic document's margin is above
    another's; rank, the rank correlation of grades with the severities of models fitted without the document's fold.
    """
    rows = labelled.select("text", (F.col("toxic") > 0).cast("int").alias("label"), F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"))
    s = _sampled(written(rows, "folds"), words, folds)
    every = np.ones(len(s.label), bool)
    margin, severity = np.zeros(len(s.label)), np.zeros(len(s.label))

    def held_out(grade: np.ndarray, result: np.ndarray, binary: bool) -> None:
        for f in range(folds):
            inside, outside = s.fold != f, s.fold == f
            if not inside.any() or not outside.any():
                continue
            m = OrdinalModel.fit(*s.of(inside, s.chosen[1 + f]), grade[inside], rounds=150)
            _, at, index, value = s.of(outside, s.chosen[1 + f])
            eta = np.bincount(np.repeat(np.arange(outside.sum()), np.diff(at)), m.weights[index] * value, outside.sum())
            # margins of different fits are compared by their probabilities
            result[outside] = eta - m.thresholds[0] if binary else (1 / (1 + np.exp(-np.clip(eta[:, None] - m.thresholds, -30, 30)))).sum(axis=1)

    held_out(s.label, margin, True)
    grade, toxic = s.label.copy(), s.label > 0
    if toxic.any():
        grade[toxic] = 1 + (margin[toxic, None] > np.quantile(margin[toxic], [1 / 3, 2 / 3])).sum(axis=1)
    held_out(grade, severity, False)
    figures = {"rows": float(len(grade)), "auc": _auc(margin, toxic), "rank": _rank_correlation(severity, grade)}
    return OrdinalModel.fit(*s.of(every, s.chosen[0]), grade), figures


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties share their mean."""
    values, place, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[place] if len(values) else np.zeros(0)


def _auc(score: np.ndarray, positive: np.ndarray) -> float:
    n, m = int(positive.sum()), int((~positive).sum())
    return float((_ranks(score)[positive].sum() - n * (n + 1) / 2) / (n * m)) if n and m else float("nan")


def _rank_correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = _ranks(a), _ranks(b)
    return float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else float("nan")


def predict_severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Rows (doc_id, severity, grade, p_toxic, toxic) for each row of docs (doc_id, text); other columns are ignored.

    severity is the expected grade, the sum of P(grade > k); grade the number of k with P(grade > k) >= 0.5; toxic
    whether grade is 1 or more. A null or empty text has no words and so the probabilities of the thresholds alone;
    long texts count whole; rows that repeat an id or a text each get their own row; a null doc_id stays null. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS features at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.above(t.as_py() for t in batch.column(1))
            grade = (p >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(p[:, 0].copy()), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
