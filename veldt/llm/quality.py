"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a Gaussian over transformed statistics of the text. Its covariance is shrunk towards
the pooled covariance, and that towards its diagonal. Class counts, sums and cross-products are
summed over all labelled rows in the tasks, so that the driver sees one small matrix a class; the
Cholesky factors are computed once and reused for every score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import in_tasks, materialize

STATISTICS = ("words", "word_chars", "upper", "digits", "stops", "shouts", "bars", "symbols", "accents", "line_ends", "distinct", "repeats", "line_repeats")
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"-", "!", "|", "#$%&*+/<=>@\\^_`{}~()[]", "\n"), 1):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[0xC0:] = 9  # first bytes of characters beyond ASCII


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty."""
    raw = (text or "").encode()
    n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    letters, chars, w = n[1] + n[2] + n[9], max(1, len(raw)), max(1, len(words))

    def share(x: float, of: float) -> float:
        return float(np.log(x / max(1, of) + 1e-3))

    return [
        float(np.log1p(len(words))),
        float(np.log((chars - n[8]) / w)),
        share(n[2], letters),
        share(n[3], chars),
        share(n[4], w),
        share(n[5], w),
        share(n[6], w),
        share(n[7], w),
        share(n[9], letters),
        share(n[8], w),
        float(np.log(max(1, len(set(words))) / w**0.9)),
        share(sum(map(eq, words, words[1:])), w),
        share(len(lines) - len(set(lines)), len(lines)),
    ]


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x: array<double>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_tasks, run, f"id {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log priors of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    priors: np.ndarray
    scale: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of ``x``."""
        if not len(self.means):
            return np.full(len(x), self.priors[1])
        logs = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(np.log(prior) - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) * self.scale, -700, 700)))


def fit(features: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.05, scale: float = 0.25, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on all rows of ``features`` that have a label.

    A row's label is 1 if the mean of its id's labels is 0.5 or more; null ids and labels are left
    out. With one class alone every score is that class, with none it is 0.5. ``scale`` tempers the
    log-density difference, as the statistics are not truly Gaussian.
    """
    d = len(STATISTICS)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, d)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel())], ["at", "v"])

    moments = features.join(known, "id").select("y", "x").transform(in_tasks, run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    sums = np.zeros(2 * (1 + d + d * d))
    for row in moments.collect():  # a number for each place of two matrices
        sums[row["at"]] = row["v"]
    sums = sums.reshape(2, -1)
    n = sums[:, 0]
    if n.min() == 0:
        p = 0.5 if n.sum() == 0 else float(n[1] > 0)
        return Discriminant(np.zeros((0, d)), np.zeros((0, d, d)), np.array([1 - p, p]))
    means = sums[:, 1 : 1 + d] / n[:, None]
    scatter = sums[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + ridge * np.eye(d)
    factors = []
    for k in (0, 1):
        weight = (1 - shrink) * n[k] / (n[k] + d)  # few rows lean on the pooled covariance
        factors.append(np.linalg.cholesky(weight * scatter[k] / n[k] + (1 - weight) * pooled + ridge * np.eye(d)))
    return Discriminant(means, np.array(factors), n / n.sum(), scale)


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether an id belongs to the fold that no label is learnt from; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def score(features: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) for every row of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    kind = features.schema["id"].dataType.simpleString()
    return features.select("id", "x").transform(in_tasks, run, f"id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Discriminant]:
    """The statistics of all documents, written to the shared folder, and the fitted model."""
    features = materialize(featurise(docs, id_col, text_col), "statistics")
    return features, fit(features, labels.where(~held_out(F.col(id_col))), id_col=id_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; no column is changed."""
    _, model = train(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.transform(in_tasks, run, docs.schema)
