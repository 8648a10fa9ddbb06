"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(w.x - t_k) for ordered thresholds t_0 < t_1 < ...: one vector of weights over
hashed text is shared by all grades, the thresholds place the grades on its scale. The expected grade and
the tail probability of the upper grades follow.

x holds hashed byte trigrams (square roots of their shares, so that a text's vector has length one) and
a few shares of the text's form: words equal to the one before, distinct words, capitals, signs, digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, column, out_batch, pieces, text_bytes

BITS = 14  # of the hashed trigrams
FORM = 6  # further features: shares of the text's form
DIM = (1 << BITS) + FORM
UPPER = np.zeros(256, bool)
UPPER[ord("A"):ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0"):ord("9") + 1] = True
SIGN = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])


def text_vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the text's features; an empty text has none."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0)
    raw = np.frombuffer(data, np.uint8)
    b = raw.astype(np.uint32)
    grams = b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else b
    hashed = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    counts = np.bincount(hashed, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    words = data.split()
    n = max(1, len(words))
    sums = np.bincount(raw, minlength=256)
    form = np.array([sum(map(eq, words, words[1:])) / n, len(set(words)) / n / (1 + np.log(n)), sums[UPPER].sum() / len(b), sums[SIGN].sum() / len(b),
                     sums[DIGIT].sum() / len(b), sums[ord("\n")] / len(b)])
    return np.concatenate([at, np.arange(FORM) + (1 << BITS)]), np.concatenate([np.sqrt(counts[at] / len(hashed)), np.sqrt(form)])


@dataclass
class Ordinal:
    """The fitted model: grades in order, weights, thresholds (one less than grades)."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, one row per text."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: list[int], steps: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> Ordinal:
    """Full-batch gradient descent with Adam steps on the cumulative-link likelihood; grades weigh alike."""
    k = len(grades) - 1
    if k < 1:
        return Ordinal(grades, np.zeros(DIM), np.zeros(0))
    level = np.searchsorted(grades, grade)
    share = np.bincount(level, minlength=k + 1) / len(level)
    doc = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    place, value = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
    weight = (1 / (share * (k + 1)))[level] / len(level)
    params = np.concatenate([np.zeros(DIM), [0.0], np.zeros(k - 1)])  # first threshold, then logs of the gaps
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, gaps = params[:DIM], np.exp(params[DIM + 1:])
        th = params[DIM] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(doc, weights=w[place] * value, minlength=len(rows))
        # P(grade = c) = s_{c-1} - s_c with s the chances to pass; gradient of the log likelihood
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - th[None, :], -30, 30)))
        up = np.concatenate([np.ones((len(s), 1)), s, np.zeros((len(s), 1))], axis=1)
        p = np.maximum(np.take_along_axis(up, level[:, None], 1) - np.take_along_axis(up, level[:, None] + 1, 1), 1e-12)
        slope = s * (1 - s)
        hit = np.zeros_like(s)  # d log p / d s_j
        r = np.arange(len(level))
        low, high = level > 0, level < k
        hit[r[low], level[low] - 1] += 1 / p[low, 0]
        hit[r[high], level[high]] -= 1 / p[high, 0]
        g = hit * slope * weight[:, None]
        gz = g.sum(1)
        gw = np.bincount(place, weights=gz[doc] * value, minlength=DIM) - ridge * w
        gt = -g.sum(0)
        tails = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([gw, [gt.sum()], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(grades, params[:DIM], params[DIM] + np.concatenate([[0.0], np.cumsum(np.exp(params[DIM + 1:]))]))


def learn(docs: DataFrame, labels: DataFrame, rating: str = "quality", sample: int = 6000, max_grades: int = 20) -> Ordinal:
    """The model of at most ``sample`` rated documents (smallest hash of the id first): their vectors, some
    kilobytes each, are fitted together. Null ratings and ids are passed over."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(rating).cast("int").alias("grade")).where("grade is not null") \
        .groupBy("doc_id").agg(F.max("grade").alias("grade"))
    known = known.join(bounded_sample(known.select("doc_id"), sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            vectors = [text_vector(t) for t in text_bytes(b)]
            yield out_batch(grade=b.column(b.schema.get_field_index("grade")), place=pa.array([p.astype(np.uint16).tobytes() for p, _ in vectors], pa.binary()),
                            value=pa.array([v.astype(np.float32).tobytes() for _, v in vectors], pa.binary()))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(run, "grade int, place binary, value binary").collect()  # at most `sample` rows
    grades = sorted({r["grade"] for r in got})
    if len(grades) > max_grades:
        raise ValueError(f"{len(grades)} grades; at most {max_grades} are graded ratings")
    rows = [(np.frombuffer(r["place"], np.uint16).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float)) for r in got]
    return fit_ordinal(rows, np.array([r["grade"] for r in got], dtype=np.int64), grades)


def graded(docs: DataFrame, model: Ordinal, upper: int | None = None) -> DataFrame:
    """doc_id, expected_grade and tail_prob, the chance of grade ``upper`` (None: the highest) or better."""
    grades = np.array(model.grades, dtype=float)
    cut = len(grades) - 1 if upper is None else int(np.searchsorted(grades, upper))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            z = np.array([float(model.weights[p] @ v) for p, v in map(text_vector, text_bytes(b))])
            above = model.above(z)
            each = -np.diff(np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1), axis=1)
            expected = each @ grades if len(grades) else np.full(len(z), np.nan)
            tail = above[:, cut - 1] if 0 < cut < len(grades) else np.full(len(z), 1.0 if cut <= 0 else 0.0)
            yield out_batch(doc_id=pa.array(column(b, "doc_id"), pa.int64()), expected_grade=expected, tail_prob=tail)

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, expected_grade double, tail_prob double")
    return out.select("doc_id", F.when(~F.isnan("expected_grade"), F.col("expected_grade")).alias("expected_grade"), "tail_prob")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.25, sample: int = 6000) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_prob (chance of the highest grade), keep
    (tail_prob at least ``least``; below one half, so that a text too short to tell is kept).

    Null and empty texts have no features and get the thresholds' chances. Without ratings, or with one
    grade only, every chance is 1 and the expected grade that grade (null without ratings). Repeated rows
    give repeated results; an empty table gives an empty result."""
    return graded(docs, learn(docs, labels, sample=sample)).withColumn("keep", F.col("tail_prob") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.25, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with the columns of ``docs``; no shuffle of texts."""
    model = learn(docs, labels, sample=sample)

    @F.pandas_udf("double")
    def tail(texts: pd.Series) -> pd.Series:
        z = np.array([float(model.weights[p] @ v) for p, v in (text_vector((t or "").encode()) for t in texts)])
        return pd.Series(model.above(z)[:, -1] if len(model.thresholds) else np.ones(len(z)))

    return docs.where(tail(F.col("text").cast("string")) >= least)
