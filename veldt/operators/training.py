"""Elastic-net logistic models trained together, one pass over the rows an epoch (M3, M5).

All candidates, models of their own features under their own penalties, are rows of one coefficient
matrix. A pass multiplies each block of rows with the whole matrix once and gives the gradients of
all candidates on the training rows and their losses on the held-out rows, so the rows are read as
often as there are epochs, however many candidates there are. Blocks' sums are added by cell of the
matrix in the cluster; the driver sees the matrix alone.

An epoch is one accelerated proximal gradient step of the whole training set on standardised
features: deterministic, and the same for every order and partitioning of the rows but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.scalars import CLIP
from veldt.operators import checks, metrics
from veldt.operators.models import Linear
from veldt.session import ship

BLOCK = 4096  # rows that meet the matrix at once
HISTORY = "candidate string, epoch int, alpha double, l1 double, n bigint, log_loss double, brier double"


@dataclass(frozen=True)
class Candidate:
    """A model's features, its elastic-net penalty, and after how many epochs it stops."""

    name: str
    features: tuple[str, ...]
    alpha: float = 3e-5
    l1: float = 0.3
    epochs: int = 30


@dataclass(frozen=True)
class Trained:
    """What the passes gave: coefficients of standardised features after each epoch, and held-out losses."""

    candidates: tuple[Candidate, ...]
    names: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    path: tuple[np.ndarray, ...]  # after epoch 0, 1, ...: a row a candidate, the intercept first
    history: tuple[dict, ...]
    columns: Mapping[str, Column]

    def linear(self, candidate: str, epoch: int | None = None) -> Linear:
        """The model in units of the features as given, after an epoch or its last one."""
        k = [c.name for c in self.candidates].index(candidate)
        own = self.path[min(self.candidates[k].epochs if epoch is None else epoch, len(self.path) - 1)][k]
        weights = own[1:] / self.scale
        used = {n: float(w) for n, w in zip(self.names, weights) if n in self.candidates[k].features}
        return Linear(float(own[0] - (weights * self.mean).sum()), used, features={n: self.columns[n] for n in used})

    def losses(self, spark: SparkSession) -> DataFrame:
        """A row for each candidate and epoch: its losses on the held-out rows."""
        by_name = {c.name: c for c in self.candidates}
        rows = [(h["candidate"], h["epoch"], by_name[h["candidate"]].alpha, by_name[h["candidate"]].l1, h["n"], h["log_loss"], h["brier"]) for h in self.history]
        return spark.createDataFrame(rows, HISTORY)

    def best(self, rows: DataFrame, label: str) -> tuple[str, int]:
        """(candidate, epoch) by log loss, then Brier score, then average precision of failures on ``rows`` (K6).

        Average precision is only made for those that tie before; what still ties goes to the earlier epoch, and then the earlier candidate.
        """
        key = lambda h: (h["log_loss"], h["brier"])
        least = min(map(key, self.history))
        tied = [h for h in self.history if key(h) == least]
        if len(tied) > 1:
            scores = [metrics.average_precision(rows.select(F.col(label).alias("y"), self.linear(h["candidate"], h["epoch"]).raw().alias("p"), F.lit(1.0).alias("w")), []).first()[0] or 0.0 for h in tied]
            tied = [h for h, s in zip(tied, scores) if s == max(scores)]
        return tied[0]["candidate"], tied[0]["epoch"]


def prepare(rows: DataFrame, label: str, features: Mapping[str, Column], held: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(y, w, held, x): one scan that holds every candidate's features, to be kept for the passes."""
    x = F.array(*(c.cast("double") for c in features.values()))
    return rows.select(F.col(label).cast("double").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), (held if held is not None else F.lit(False)).alias("held"), x.alias("x"))


def _blocks(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for s in range(0, batch.num_rows, BLOCK):
        y, w, held, x = (c.slice(s, BLOCK) for c in batch.columns)
        if y.null_count or w.null_count or held.null_count or x.null_count or x.flatten().null_count:
            raise checks.IntegrityError("null label, weight, role or feature in the rows of a fit")
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), features)
        if not np.isfinite(x).all():
            raise checks.IntegrityError("a feature is not finite in the rows of a fit")
        yield y.to_numpy(), w.to_numpy(), held.to_numpy(zero_copy_only=False), x


def _summed(scan: DataFrame, features: int, cells: int, of_block) -> np.ndarray:
    """Sums over all blocks of what ``of_block`` gives, an array of ``cells`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            for block in _blocks(batch, features):
                total += of_block(*block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "value"])

    ship(scan.sparkSession)
    out = np.zeros(cells)
    for r in scan.mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def _moments(scan: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(weight, means, products of centred features) of the training rows, in two passes."""
    first = _summed(scan, p, 1 + p, lambda y, w, held, x: np.append((w * ~held).sum(), (w * ~held) @ x))
    if not first[0] > 0:
        raise checks.IntegrityError("no training rows")
    mean = first[1:] / first[0]

    def products(y, w, held, x):
        z = x - mean
        return ((z * (w * ~held)[:, None]).T @ z).ravel()

    return first[0], mean, _summed(scan, p, p * p, products).reshape(p, p) / first[0]


def _losses_and_gradients(tried: np.ndarray, kept: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Gradients at ``tried`` on training rows; log loss, Brier score and weight at ``kept`` on held-out rows."""
    k = len(tried)

    def of_block(y, w, held, x):
        z = (x - mean) / scale
        train, test = np.flatnonzero(~held), np.flatnonzero(held)
        with np.errstate(over="ignore"):
            rest = (1 / (1 + np.exp(-(tried[:, :1] + tried[:, 1:] @ z[train].T))) - y[train]) * w[train]
            q = np.clip(1 / (1 + np.exp(-(kept[:, :1] + kept[:, 1:] @ z[test].T))), CLIP, 1 - CLIP)
        gradient = np.concatenate([rest.sum(1)[:, None], rest @ z[train]], 1)
        log = -(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q)) @ w[test]
        return np.concatenate([gradient.ravel(), log, ((q - y[test]) ** 2) @ w[test], [w[test].sum(), len(test)]])

    return of_block, k


def train(scan: DataFrame, columns: Mapping[str, Column], candidates: list[Candidate], bound: str = "gram") -> Trained:
    """Train all candidates on the training rows of ``scan`` and measure each after every epoch on its held-out rows.

    ``columns`` are the features of ``scan``, in its order. The objective is the mean weighted log loss
    plus alpha (l1 |b| + (1 - l1) b^2 / 2) of standardised coefficients b, without the intercept. A
    constant feature keeps the coefficient 0. Steps come from the largest curvature: of the features'
    correlations (``gram``), or from their number, which is never less (``trace``). Null or infinite
    values are an error, as is a table without training rows; without held-out rows there is no
    history. A candidate that stops early stays as it was.
    """
    names, p = tuple(columns), len(columns)
    if bound not in ("gram", "trace"):
        raise ValueError("bound is gram or trace")
    total, mean, square = _moments(scan, p)
    sd = np.sqrt(np.diag(square))
    varies = sd > 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(varies, sd, 1.0)
    mask = np.array([[n in c.features and v for n, v in zip(names, varies)] for c in candidates])
    alpha, l1 = (np.array([getattr(c, f) for c in candidates]) for f in ("alpha", "l1"))
    ridge, lasso = (alpha * (1 - l1))[:, None], (alpha * l1)[:, None]
    step = 1 / (_curvature(square / np.outer(scale, scale), mask, bound) / 4 + ridge[:, 0])[:, None]
    epochs = max(c.epochs for c in candidates)
    kept = tried = np.zeros((len(candidates), p + 1))
    pace, path, history = 1.0, [kept], []
    for epoch in range(epochs + 1):
        of_block, k = _losses_and_gradients(tried, kept, mean, scale)
        got = _summed(scan, p, k * (p + 1) + 2 * k + 2, of_block)
        log, brier, weight, n = got[k * (p + 1) : -2 - k], got[-2 - k : -2], got[-2], int(got[-1])
        if epoch and weight > 0:
            history += [{"candidate": c.name, "epoch": epoch, "n": n, "log_loss": float(log[i] / weight), "brier": float(brier[i] / weight)} for i, c in enumerate(candidates) if epoch <= c.epochs]
        if epoch == epochs:
            break
        moved = _step(tried, got[: k * (p + 1)].reshape(k, p + 1) / total, mask, step, ridge, lasso)
        going = np.array([epoch < c.epochs for c in candidates])[:, None]
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        moved = np.where(going, moved, kept)
        tried, kept, pace = moved + (pace - 1) / after * (moved - kept), moved, after
        path.append(kept)
    return Trained(tuple(candidates), names, mean, scale, tuple(path), tuple(history), dict(columns))


def _curvature(correlation: np.ndarray, mask: np.ndarray, bound: str) -> np.ndarray:
    """The largest curvature of the squares of each candidate's features and the intercept."""
    if bound == "trace":
        return np.maximum(1.0, mask.sum(1))
    return np.array([max(1.0, np.linalg.eigvalsh(correlation[np.ix_(m, m)])[-1]) if m.any() else 1.0 for m in mask])


def _step(at: np.ndarray, gradient: np.ndarray, mask: np.ndarray, step: np.ndarray, ridge: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    intercept = at[:, :1] - step * gradient[:, :1]
    moved = at[:, 1:] - step * (gradient[:, 1:] + ridge * at[:, 1:])
    moved = np.sign(moved) * np.maximum(np.abs(moved) - step * lasso, 0)
    return np.concatenate([intercept, np.where(mask, moved, 0.0)], 1)
