"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

A document's features are its distinct words and their leading letters (5, 6 and 7), hashed. One
weight vector is shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - score), with the
thresholds in ascending order. It is fitted on the driver by proximal gradient steps with an L1
penalty and weights of zero or more (no clean word makes up for a toxic one), from a bounded sample of labelled rows (`sample_rows`) whose features are made on the
executors. The score is a sum over distinct words, so prediction is one pass over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

SAMPLE_ROWS = 6000  # bound of the rows that the fit reads
BITS = 22
LEADING = (5, 6, 7)
LEAST_ROWS = 4  # sample rows that a feature must occur in
DEVIATIONS = 6.0  # standard deviations above chance that a feature must go with higher grades
PENALTY = 1e-4
ROUNDS = 1000
FLAG = 0.2  # least P(grade > 0) of a document that is called toxic
SEED = 13
CACHED_WORDS = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word: itself and its leading letters."""
    forms = [word + "$", *(word[:n] for n in LEADING if len(word) >= n)]
    return [zlib.crc32(f.encode("utf-8", "replace")) >> (32 - BITS) for f in forms]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class SeverityModel:
    features: np.ndarray  # sorted feature numbers with a weight
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def word_score(self, word: str) -> float:
        own = np.array(word_features(word))
        at = np.minimum(np.searchsorted(self.features, own), max(0, len(self.features) - 1))
        return float(self.weights[at][self.features[at] == own].sum()) if len(self.features) else 0.0

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS, least_rows: int = LEAST_ROWS,
    deviations: float = DEVIATIONS,
) -> SeverityModel:
    """Cumulative-link regression on rows of feature numbers (repeats count) with grades 0..K."""
    k = int(grades.max()) if len(grades) else 0
    if k == 0:
        return SeverityModel(np.empty(0, np.int64), np.empty(0), np.full(max(1, k), 30.0))
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pairs, times = np.unique(row.astype(np.int64) << 32 | flat, return_counts=True)
    row, feature = pairs >> 32, pairs & 0xFFFFFFFF
    names, col, spread = np.unique(feature, return_inverse=True, return_counts=True)
    # Weights stay at zero or above, and only features that go with higher grades beyond chance take part.
    base = (grades > 0).mean()
    excess = np.bincount(col, (grades > 0)[row]) - spread * base
    keep = ((spread >= least_rows) & (excess > deviations * np.sqrt(spread * base * (1 - base))))[col]
    row, col, value = row[keep], col[keep], times[keep].astype(np.float64)
    names, col = names[np.unique(col)], np.unique(col, return_inverse=True)[1]
    n, m = len(rows), len(names)
    weight = weight / weight.sum()
    scale = 1 / np.sqrt(np.bincount(col, weight[row] * value**2, m))  # features of unit second moment
    value = value * scale[col]
    x = lambda w: np.bincount(row, value * w[col], n)
    xt = lambda r: np.bincount(col, value * r[row], m)
    v = np.ones(m)
    for _ in range(15):
        v = xt(weight * x(v)).astype(np.float64)  # without any feature, counts are whole numbers
        norm = np.linalg.norm(v)
        v = v / max(norm, 1e-300)
    step = 1 / (0.25 * norm + 1e-9)
    share = np.array([weight[grades > j].sum() for j in range(k)])
    thresholds = np.log((1 - share + 1e-6) / (share + 1e-6))
    gap = 1e-3 * np.arange(k)
    thresholds = np.maximum.accumulate(thresholds - gap) + gap
    w, ahead, t = np.zeros(m), np.zeros(m), 1.0
    for _ in range(rounds):
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        score = x(ahead)
        a, b = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        slope = weight * (1 - a - b)
        p = np.maximum(a - b, 1e-9)
        push = np.zeros(k + 2)
        np.add.at(push, grades + 1, -weight * a * (1 - a) / p)
        np.add.at(push, grades, weight * b * (1 - b) / p)
        thresholds = np.maximum.accumulate(thresholds - 2.0 * push[1:-1] - gap) + gap  # in ascending order, a little apart
        new = np.maximum(ahead - step * (xt(slope) + penalty), 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    used = np.flatnonzero(w)
    return SeverityModel(names[used], (w * scale)[used], thresholds)


def grade_toxic(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 of 0/1 labels. Grade 2 is not in the labels: it is made of the features here, so only
    grade 0 against the rest can be held against labels. A toxic row is severe if it holds more telling features than the median toxic row.

    Telling: in 4 * LEAST_ROWS rows or more, at least nineteen of twenty of them toxic.
    """
    toxic = toxic.astype(np.int64)
    if not toxic.any():
        return toxic
    own = [np.unique(r) for r in rows]
    flat = np.concatenate(own)
    names, col = np.unique(flat, return_inverse=True)
    rows_with = np.bincount(col)
    toxic_with = np.bincount(col, np.repeat(toxic, [len(r) for r in own]))
    telling = (rows_with >= 4 * LEAST_ROWS) & (toxic_with >= 0.95 * rows_with)
    at = np.repeat(np.arange(len(own)), [len(r) for r in own])
    found = np.bincount(at, telling[col], len(own))
    return toxic + (toxic & (found > np.median(found[toxic == 1])))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [[f for w in sorted(distinct_words(t)) for f in word_features(w)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["label", "f"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> SeverityModel:
    """The model learnt from documents with a 0/1 label (null labels are left out).

    At most `sample_rows` labelled texts, half of either label as far as they go, are chosen by hashes:
    of about twice as many ids (4 * sample_rows at most), those of smallest hash, each different text
    once. Only they and two counts reach the driver. Of rows with one id the smallest text counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1):
        return SeverityModel(np.empty(0, np.int64), np.empty(0), np.full(2, 30.0))
    quota = max(1, sample_rows // 2)
    share = F.when(F.col("label") == 1, (2 * quota + 50) / counts[1]).otherwise((2 * quota + 50) / max(1, counts.get(0, 0)))
    draw = F.xxhash64("id", F.lit(SEED))
    # Hashes are spread evenly, so those below this share are about twice the quota: only they are ranked.
    low = known.where(F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < share).distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy(draw, "id"))
    chosen = F.broadcast(low.withColumn("nth", nth).where(F.col("nth") <= 2 * sample_rows).drop("nth"))  # 4 * sample_rows ids at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"), F.min(draw).alias("draw"))
    rows = rows.groupBy("label", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2")).agg(F.min(F.struct("draw", "id", "text")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("first.draw", "first.id"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= quota).select("label", "first.text")
    sample = rows.mapInArrow(_rows, "label int, f array<int>").toArrow()
    label = sample.column("label").to_numpy()
    features = [np.asarray(x.values, dtype=np.int64) for x in sample.column("f")]
    order = sorted(range(len(label)), key=lambda i: (int(label[i]), len(features[i]), features[i].tobytes()))  # the same fit whatever the order of arrival
    label, features = label[order], [features[i] for i in order]
    true = np.array([counts.get(0, 0), counts[1]], dtype=float)
    seen = np.maximum(1, np.bincount(label, minlength=2))
    return fit_ordinal(features, grade_toxic(features, label), (true / seen)[label])


def _predict(batches: Iterator[pa.RecordBatch], model: SeverityModel) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        scores = []
        for text in batch.column(1).to_pylist():
            words = distinct_words(text)
            for w in words.difference(known):
                known[w] = model.word_score(w)
            scores.append(sum(sorted(filter(None, map(known.__getitem__, words)))))
            if len(known) > CACHED_WORDS:
                known = {}
        above = model.above(np.array(scores, dtype=np.float64).reshape(-1))
        grade = (above >= 0.5).sum(1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= FLAG)],
            names=["doc_id", "p_toxic", "expected_severity", "severity", "toxic"],
        )


def predict_toxicity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_toxic, expected_severity, severity, toxic) of every row of `docs`.

    severity is the grade whose thresholds the document more likely passes, toxic is P(grade > 0) >= FLAG.
    expected_severity is the sum over thresholds of P(grade above it). Null and empty texts score as
    texts without any word; null ids stay null; repeated rows give repeated results; other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, p_toxic double, expected_severity double, severity int, toxic boolean")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
