"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a short vector of transformed statistics (lengths, shares of
character kinds, repetition of words and lines).  Per class, the mean and covariance
come from all labelled learning rows, as sums that partitions add up; the covariance
is shrunk towards the pooled one and towards a multiple of the identity.  A score is
the logistic of the difference of the two Gaussian log densities (squared
Mahalanobis distances from cached Cholesky factors, log determinants, log priors).

Defined results: null and empty texts have the statistics of an empty text and get a
score; rows whose label is null or neither 0 nor 1 teach nothing; where one doc_id
has labels of both kinds, both count; with fewer than two rows of a class the score
is the share of label 1 (0.5 without labels); repeated rows are scored alike; an
empty table gives no rows; further columns are ignored; a null doc_id has no label and is
not held out.  Labels, ``lang``, ``source`` and ``doc_id`` never enter a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lasting, slices
from .langid import held_out

_KIND = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol, 8 beyond ASCII
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[32, 9, 13, 11, 12]] = 4
_KIND[10] = 5
_KIND[[ord(c) for c in ".,;:'\"?-"]] = 6
_KIND[[ord(c) for c in "!#$%&*|@<>{}[]()=+~^_/\\`"]] = 7
_KIND[128:] = 8

N_FEATURES = 14


def _logit(p: float) -> float:
    p = min(max(p, 0.0), 1.0)
    return math.log((p + 0.01) / (1.01 - p))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=9).astype(float)
    n = max(1.0, float(len(raw)))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, distinct = max(1, len(words)), set(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    length = sum(map(len, words))
    letters = max(1.0, kinds[1] + kinds[2])
    return [
        math.log1p(len(raw)),
        _logit(kinds[2] / letters),
        _logit(kinds[3] / n),
        _logit((kinds[4] + kinds[5]) / n),
        _logit(kinds[6] / n),
        _logit(kinds[7] / n),
        _logit(kinds[8] / n),
        math.log1p(length / w),
        # words repeat more in longer texts: the exponent in w ** e distinct words does not
        math.log(max(1, len(distinct))) / math.log(w + 1),
        _logit(same / w),
        _logit(1 - len(set(lines)) / max(1, len(lines))),
        math.log1p(w / max(1, len(lines))),
        _logit(sum(x.endswith((".", "!", "?")) for x in lines) / max(1, len(lines))),
        _logit(max(map(len, words), default=0) / (20 + length)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            x = [statistics(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "held_out", "x"]
            )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sum and sum of outer products of this partition, as one vector."""
    acc = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.array(batch.column("x").to_pylist())
        y = np.array(batch.column("quality").to_pylist())
        for c in np.unique(y):
            z = np.column_stack([np.ones((y == c).sum()), x[y == c]])
            acc[int(c)] = acc.get(int(c), 0) + z.T @ z
    if acc:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(acc), pa.int32()), pa.array([m.ravel().tolist() for m in acc.values()], pa.list_(pa.float64()))], ["quality", "m"]
        )


@dataclass
class QuadraticDiscriminant:
    means: list[np.ndarray]
    inverse_factors: list[np.ndarray]  # inverse of the Cholesky factor, once per class
    constants: list[float]  # log prior - half log determinant
    base: float  # share of label 1, for want of a class

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        part = []
        for mean, inv, const in zip(self.means, self.inverse_factors, self.constants):
            d = (x - mean) @ inv.T
            part.append(const - 0.5 * (d * d).sum(axis=1))
        return part[1] - part[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.base)
        z = np.clip(self.log_odds(x), -500, 500)
        return 1.0 / (1.0 + np.exp(-z))


def fit_from_moments(moments: dict[int, np.ndarray], pool: float = 0.15, ridge: float = 0.02) -> QuadraticDiscriminant:
    """Discriminant from per-class matrices sum of (1, x)(1, x)'."""
    n = {c: float(moments[c][0, 0]) if c in moments else 0.0 for c in (0, 1)}
    total = n[0] + n[1]
    base = n[1] / total if total else 0.5
    if min(n.values()) < 2:
        return QuadraticDiscriminant([], [], [], base)
    mean, cov = {}, {}
    for c in (0, 1):
        m = moments[c]
        mean[c] = m[0, 1:] / n[c]
        cov[c] = m[1:, 1:] / n[c] - np.outer(mean[c], mean[c])
    pooled = sum(n[c] * cov[c] for c in (0, 1)) / total
    d = len(pooled)
    out = QuadraticDiscriminant([], [], [], base)
    for c in (0, 1):
        # Fewer rows shrink more, towards the pooled covariance and its diagonal.
        lam = min(1.0, pool + d / n[c])
        s = (1 - lam) * cov[c] + lam * pooled
        s = s + ridge * np.diag(np.diag(pooled)) + 1e-6 * max(1e-6, np.trace(pooled) / d) * np.eye(d)
        factor = np.linalg.cholesky(s)
        out.means.append(mean[c])
        out.inverse_factors.append(np.linalg.inv(factor))
        out.constants.append(math.log(n[c] / total) - float(np.log(np.diag(factor)).sum()))
    return out


def fit(labelled: DataFrame) -> QuadraticDiscriminant:
    """Model from columns ``x`` (statistics) and ``quality`` of all rows with label 0 or 1."""
    d = N_FEATURES + 1
    rows = (
        labelled.where("quality in (0, 1)").select("x", F.col("quality").cast("int").alias("quality"))
        .mapInArrow(_sums, "quality int, m array<double>")
        .select("quality", F.posexplode("m").alias("i", "v"))
        .groupBy("quality", "i").agg(F.sum("v").alias("v")).collect()  # 2 * d * d numbers at most
    )
    moments = {}
    for q, i, v in rows:
        moments.setdefault(q, np.zeros(d * d))[i] = v
    return fit_from_moments({q: m.reshape(d, d) for q, m in moments.items()})


def _scorer(model: QuadraticDiscriminant):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = model.scores(np.array(batch.column("x").to_pylist()).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return score


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = lasting(spark, "op10")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = ws.stash(
        docs.select("doc_id", held_out(3, 1).alias("held_out"), "text").mapInArrow(_features, f"doc_id {kind}, held_out boolean, x array<double>"),
        "statistics",
    )
    model = fit(stats.where("not held_out").join(labels, "doc_id"))
    return stats.mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
