"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import Shelf, bucket, frugal, table, texts
from quarry.llm.features import BITS, Words, ngrams

#: Labelled rows of each class that a model is fitted on at most, those of the smallest hashes, and bytes of their texts: rows after
#: that are not read for the fit, nor those with more than an eighth of it.
PER_CLASS, SAMPLE_BYTES = 2000, 32 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text, y of at most per_class labelled rows of each class, and SAMPLE_BYTES of text. The window has one partition, of
    twice per_class rows."""
    rows = [labels.where(F.col(label) == v).select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    found = texts(docs).join(F.broadcast(rows[0].unionByName(rows[1])), "doc_id").withColumn("_bytes", F.octet_length("text"))
    whole = F.sum("_bytes").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    return found.where(F.col("_bytes") <= SAMPLE_BYTES // 8).withColumn("_sum", whole).where(F.col("_sum") <= SAMPLE_BYTES).drop("_bytes", "_sum")


def dual_descent(rows: list[np.ndarray], y: np.ndarray, dims: int, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Hinge-loss weights over unit vectors with equal values at the given indices, the last of which is a bias."""
    rng, w, alpha = np.random.default_rng(7), np.zeros(dims + 1), np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            g = y[i] * (w[idx] @ val + w[-1]) - 1
            new = min(max(alpha[i] - g / (val @ val + 1), 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * val
                w[-1] += step
                alpha[i] = new
    return w


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities: logistic regression of the label on the margin, by Newton steps."""
    a, c, x = 1.0, 0.0, np.stack([z, np.ones(z.size)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        curve = (x * np.maximum(p * (1 - p), 1e-6)) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x @ (y - p) - 1e-3 * np.array([a, c]))
        a, c = a + float(np.clip(step[0], -2, 2)), c + float(np.clip(step[1], -2, 2))
    return max(a, 0.0), c


def trained(idx: list[np.ndarray], y: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the indicators with a bias last, and the log-count ratios."""
    count = [np.ones(dims), np.ones(dims)]
    for i, v in zip(idx, y, strict=True):
        count[v][i] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    unit = [(i, ratio[i] / max(np.linalg.norm(ratio[i]), 1e-9)) for i in idx]
    w = dual_descent(unit, 2.0 * y - 1, dims)
    return np.append(w[:-1] * ratio, w[-1]), ratio


def margin(w: np.ndarray, ratio: np.ndarray, i: np.ndarray | None) -> float:
    """The distance from the decision; the bias alone without indicators."""
    return float(w[-1]) + (0.0 if i is None or not i.size else float(w[i].sum(dtype=np.float64)) / max(float(np.linalg.norm(ratio[i])), 1e-9))


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights with a bias, log-count ratios, slope and shift; all zero (a score of 0.5) without rows of both classes.

    The slope and shift are fitted on margins of rows that the model they come from has not seen."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "idx": [ngrams(t, memo).tobytes() for t in f["text"]]})

    got = sorted(((r.doc_id, r.y, r.idx) for r in labelled.mapInPandas(run, "doc_id long, y int, idx binary").toLocalIterator()))
    dims, y = 1 << BITS, np.array([r[1] for r in got], int)
    if not {0, 1} <= {*y.tolist()}:
        return np.zeros(dims + 1), np.zeros(dims), 0.0, 0.0
    idx = [np.frombuffer(r[2], np.int32) for r in got]
    part = np.random.default_rng(3).permutation(len(got)) % 3
    z = np.zeros(len(got))
    for k in range(3):
        seen, rest = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if {0, 1} <= {*y[seen].tolist()}:
            w, ratio = trained([idx[i] for i in seen], y[seen], dims)
            z[rest] = [margin(w, ratio, idx[i]) for i in rest]
    return *trained(idx, y, dims), *calibrated(z, y)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float, float]) -> DataFrame:
    """doc_id, score for every row; null and empty texts have the bias alone."""
    w, ratio, slope, shift = model
    shared = Shelf(docs.sparkSession).share((w.astype(np.float32), ratio.astype(np.float32)))  # 2 * 2**BITS numbers

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, (w, ratio) = Words(), shared.value
        for f in frames:
            z = np.array([margin(w, ratio, ngrams(t, memo) if t else None) for t in f["text"]])
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": 1 / (1 + np.exp(-np.clip(slope * z + shift, -50, 50)))})

    return texts(docs).mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels of held-out rows are not read.

    Null and empty texts score what the bias says; repeated rows score alike; a null doc_id counts as held out; without labels of both
    classes every row scores 0.5; an empty table gives none; other columns are ignored."""
    known = labels.where("quality in (0, 1)").where(bucket(3) != 1)
    s = score(docs, fit(sample(docs, known, "quality")))
    return s.select("doc_id", F.coalesce(bucket(3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
