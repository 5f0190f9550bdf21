"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

Method. Grades 0 (clean) to 3 (severe) have P(grade <= k) = sigmoid(theta_k - w.x), with one weight
vector for all ordered thresholds. Features are words and word beginnings, so that inflected words
share weight; a feature's value is the logarithm of its rate in the document. Every feature that leans to
toxic rows and depends on the label, by a chi-squared test at SIGNIFICANT, is used, so a text without any is
clean. Labels only say toxic or not, so the grades of the training rows are derived: toxic rows are ranked by
their rate of words that toxic rows use far more often, and cut in thirds. The model is fitted on a bounded
sample of labelled rows (``sample``, by hash of the id), which bounds its features too, and applied to all rows.

Defined results: null or wordless text has no features and gets the model's base severity; a label
row without its document, or with a null label, is not used; of documents with one id, one text (the least) is
fitted on, and repeated label rows count once; without labels of both kinds every
document gets severity 0; very long texts are read whole; rows are kept as they come, repeated ones too; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, remembered, rows_of, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8000
#: Chi-squared with one degree of freedom from which on a feature is used: one in a thousand by chance.
SIGNIFICANT = 10.83
#: Rows of the sample that have a feature, at least. Lengths of word beginnings.
LEAST_ROWS, PREFIXES = 4, range(4, 10)
GRADES = 4
#: A document is toxic from this probability of a grade above 0 on.
DECISION = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def rate(tf, n):
    return np.log1p(200.0 * np.asarray(tf, float) / (np.asarray(n, float) + 10))


class Counts:
    """Counts of known features in texts; remembers which features a word has."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.of_word: dict[str, tuple[int, ...]] = {}
        remembered("features of words", dict)  # lets other operators' memory go; this one's ends with the task

    def of(self, tokens: list[str]) -> Counter:
        known = self.of_word
        if len(known) > 200_000:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = tuple(self.index[f] for f in features_of(w) if f in self.index)
        found: Counter = Counter()
        for ids in filter(None, map(known.__getitem__, tokens)):
            found.update(ids)
        return found


@dataclass
class OrdinalModel:
    features: list[str]
    weights: list[float]
    thresholds: list[float]

    def scorer(self):
        """A function of a text: expected severity, probability of a grade above 0, most probable grade."""
        counts = Counts({f: i for i, f in enumerate(self.features)})

        def score(text: str | None) -> tuple[float, float, int]:
            if not self.thresholds:
                return 0.0, 0.0, 0
            tokens = words(text)
            x = sum(self.weights[i] * math.log1p(200.0 * tf / (len(tokens) + 10)) for i, tf in sorted(counts.of(tokens).items()))
            below = [1 / (1 + math.exp(-min(40.0, max(-40.0, t - x)))) for t in self.thresholds]
            steps = np.diff([0.0, *below, 1.0])
            return sum(1 - b for b in below), 1 - below[0], int(np.argmax(steps))

        return score


def severity_grades(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 to 3 for toxic ones, in thirds of their rate of marker words."""
    grades = np.zeros(len(toxic), int)
    if (toxic == 1).any():
        cuts = np.quantile(marked[toxic == 1], [1 / 3, 2 / 3])
        grades[toxic == 1] = 1 + (marked[toxic == 1, None] > cuts).sum(1)
    return grades


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_cols: int, l2: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient steps with momentum and scaling."""
    n, k = len(grades), GRADES - 1
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_cols), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    lo, hi = np.maximum(grades - 1, 0), np.minimum(grades, k - 1)
    for step in range(1, steps + 1):
        w, gaps = p[:n_cols], np.exp(p[n_cols + 1 :])
        theta = p[n_cols] + np.concatenate([[0], np.cumsum(gaps)])
        x = np.bincount(rows, vals * w[cols], n)
        up = np.where(grades < k, 1 / (1 + np.exp(-np.clip(theta[hi] - x, -30, 30))), 1.0)
        down = np.where(grades > 0, 1 / (1 + np.exp(-np.clip(theta[lo] - x, -30, 30))), 0.0)
        like = np.maximum(up - down, 1e-9)
        gu, gd = up * (1 - up) / like, down * (1 - down) / like  # of log likelihood by each threshold
        g_theta = np.bincount(hi[grades < k], gu[grades < k], k) - np.bincount(lo[grades > 0], gd[grades > 0], k)
        g = np.concatenate([-np.bincount(cols, vals * (gu - gd)[rows], n_cols), [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps]) / n
        g[:n_cols] -= l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return p[:n_cols], p[n_cols] + np.concatenate([[0], np.cumsum(np.exp(p[n_cols + 1 :]))])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each kind that have a feature, counted within the task."""
    remembered("features of words", dict)  # lets other operators' memory go
    rows: tuple[Counter, Counter] = (Counter(), Counter())
    for toxic, text in rows_of(batches):
        rows[toxic].update({f for w in set(words(text)) for f in features_of(w)})
    schema = pa.schema([("feature", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
    yield from batched(((f, rows[0][f], rows[1][f]) for f in rows[0].keys() | rows[1].keys()), schema, 20_000)


def _sparse_rows(index: dict[str, int]):
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(index)

        def each():
            for toxic, text in rows_of(batches):
                tokens = words(text)
                c = sorted(counts.of(tokens).items())
                yield toxic, len(tokens), [i for i, _ in c], [k for _, k in c]

        yield from batched(each(), schema, 500)

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """The model, fitted on at most ``sample`` labelled rows."""
    chosen = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id")  # at most `sample` ids are sent
    rows = written(met.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("toxic", "text"), "labelled")
    kinds = rows.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not kinds.clean or not kinds.toxic:
        return OrdinalModel([], [], [])
    n0, n1 = float(kinds.clean), float(kinds.toxic)
    by_feature = rows.mapInArrow(_feature_rows, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).filter(F.col("a") + F.col("b") >= LEAST_ROWS)
    lean = F.col("b") * n0 - F.col("a") * n1
    chi = lean * lean * (n0 + n1) / (n0 * n1 * (F.col("a") + F.col("b")) * (n0 + n1 - F.col("a") - F.col("b") + 1))
    best = by_feature.withColumn("chi", chi).filter((lean > 0) & (F.col("chi") >= SIGNIFICANT)).orderBy(F.desc("chi"), "feature").collect()  # of the sample alone
    features = [r.feature for r in best]
    marker = np.array([r.b / n1 > 8 * (r.a + 0.5) / n0 and not r.feature.startswith("^") for r in best])
    got = rows.mapInArrow(_sparse_rows({f: i for i, f in enumerate(features)}), "toxic int, n long, ids array<int>, tf array<int>").collect()
    got.sort(key=lambda r: (r.toxic, r.n, r.ids, r.tf))  # the same order in every run
    toxic, n = np.array([r.toxic for r in got]), np.array([r.n for r in got])
    at = np.repeat(np.arange(len(got)), [len(r.ids) for r in got])
    ids, tf = (np.array([x for r in got for x in r[k]], int) for k in (2, 3))
    marked = np.bincount(at, tf * marker[ids], len(got)) / np.maximum(n, 1) if len(ids) else np.zeros(len(got))
    w, theta = fit_ordinal(at, ids, rate(tf, n[at]), severity_grades(toxic, marked), len(features))
    return OrdinalModel(features, [float(x) for x in w], [float(t) for t in theta])


_SCORES = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity, p_toxic, grade, toxic of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample bounds its weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        yield from batched(((doc_id, *score(text)) for doc_id, text in rows_of(batches)), _SCORES, 5000)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int").withColumn("toxic", F.col("p_toxic") >= DECISION)


def clean_rows(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def p_toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for text in texts:
            yield pd.Series([score(t)[1] for t in text], dtype=float)

    return docs.filter(p_toxic(F.coalesce(F.col("text").cast("string"), F.lit(""))) < DECISION)
