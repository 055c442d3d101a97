"""Models trained together, against plain numpy on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import checks, training

NAMES = ("a", "b", "c", "flat")


def numpy_path(x, y, w, candidates):
    """Coefficients of each candidate after each epoch."""
    mean = np.average(x, axis=0, weights=w)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    out = []
    for c in candidates:
        use = [i for i, n in enumerate(NAMES) if n in c.features and sd[i] > 0]
        z = (x[:, use] - mean[use]) / sd[use]
        full = np.concatenate([np.ones((len(y), 1)), z], 1)
        step = 1 / (np.linalg.eigvalsh((full * w[:, None]).T @ full / w.sum())[-1] / 4 + c.alpha * (1 - c.l1))
        b, t, pace, path = np.zeros(len(use) + 1), np.zeros(len(use) + 1), 1.0, []
        for _ in range(c.epochs):
            g = full.T @ (w * (1 / (1 + np.exp(-full @ t)) - y)) / w.sum()
            new = t - step * (g + c.alpha * (1 - c.l1) * np.append(0, t[1:]))
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * c.alpha * c.l1, 0)
            after = (1 + np.sqrt(1 + 4 * pace**2)) / 2
            t, b, pace = new + (pace - 1) / after * (new - b), new, after
            path.append((use, b))
        out.append(path)
    return mean, sd, out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(5, 2, (900, 1)), rng.normal(0, 1e-3, (900, 1)), rng.integers(0, 2, (900, 1)), np.full((900, 1), 3.0)], 1)
    y = (rng.random(900) < 1 / (1 + np.exp(-(0.6 * (x[:, 0] - 5) + 500 * x[:, 1] - 0.3)))).astype(float)
    return x, y, rng.integers(1, 4, 900).astype(float), rng.random(900) < 0.3


def scan(spark, data):
    x, y, w, held = data
    df = spark.createDataFrame([(*map(float, r), float(a), float(b), bool(c)) for r, a, b, c in zip(x, y, w, held)], "a double, b double, c double, flat double, y double, w double, held boolean")
    return df, {n: F.col(n) for n in NAMES}


CANDIDATES = [
    training.Candidate("all", NAMES, 1e-3, 0.3, 12),
    training.Candidate("short", NAMES, 1e-3, 0.3, 3),
    training.Candidate("sparse", ("a", "c"), 0.2, 0.9, 12),
    training.Candidate("ridge", ("b",), 0.1, 0.0, 7),
]


def test_paths_and_losses_equal_numpy(spark, data):
    df, columns = scan(spark, data)
    got = training.train(training.prepare(df.repartition(5), "y", columns, F.col("held"), F.col("w")), columns, CANDIDATES)
    x, y, w, held = data
    mean, sd, paths = numpy_path(x[~held], y[~held], w[~held], CANDIDATES)
    assert len(got.path) == 13 and len(got.history) == 12 + 3 + 12 + 7
    losses = {(h["candidate"], h["epoch"]): h for h in got.history}
    for c, path in zip(CANDIDATES, paths):
        for epoch, (use, b) in enumerate(path, 1):
            model = got.linear(c.name, epoch)
            raw = b[1:] / sd[use]
            np.testing.assert_allclose([model.weights[NAMES[i]] for i in use], raw, rtol=1e-7, atol=1e-9)
            np.testing.assert_allclose(model.intercept, b[0] - raw @ mean[use], rtol=1e-7, atol=1e-9)
            q = np.clip(1 / (1 + np.exp(-(model.intercept + x[held][:, use] @ raw))), 1e-7, 1 - 1e-7)
            np.testing.assert_allclose(losses[c.name, epoch]["log_loss"], np.average(-(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)), weights=w[held]), rtol=1e-9)
            np.testing.assert_allclose(losses[c.name, epoch]["brier"], np.average((q - y[held]) ** 2, weights=w[held]), rtol=1e-9)
    assert got.linear("all").weights["flat"] == 0 and set(got.linear("sparse").weights) == {"a", "c"}
    best = min(got.history, key=lambda h: (h["log_loss"], h["brier"]))
    assert got.best(df.where("held"), "y") == (best["candidate"], best["epoch"])
    assert got.losses(spark).count() == len(got.history)


def test_many_epochs_reach_the_optimum(spark, data):
    from veldt.operators import models

    df, columns = scan(spark, data)
    columns = {n: columns[n] for n in ("a", "b", "c")}
    got = training.train(training.prepare(df, "y", columns), columns, [training.Candidate("m", ("a", "b", "c"), 1e-2, 0.5, 60)]).linear("m")
    want = models.fit(df, "y", columns, 1e-2, 0.5)
    for n in columns:
        assert got.weights[n] == pytest.approx(want.weights[n], rel=1e-2, abs=1e-3)  # Spark ML divides by the sample deviation


def test_ties_go_by_average_precision_and_then_by_epoch(spark, data):
    df, columns = scan(spark, data)
    none = [training.Candidate("first", ("flat",), 1e-3, 0.3, 2), training.Candidate("second", ("flat",), 1e-3, 0.3, 2)]
    got = training.train(training.prepare(df, "y", columns, F.col("held")), columns, none)
    assert got.best(df.where("held"), "y")[0] == "first"


def test_what_can_not_be_fitted_is_an_error(spark, data):
    df, columns = scan(spark, data)
    with pytest.raises(checks.IntegrityError, match="no training rows"):
        training.train(training.prepare(df, "y", columns, F.lit(True)), columns, CANDIDATES)
    for bad in ("null", "'NaN'", "'Infinity'"):
        with pytest.raises(Exception, match="not finite|null label"):
            training.train(training.prepare(df.withColumn("a", F.expr(f"CAST({bad} AS DOUBLE)")), "y", columns), columns, CANDIDATES)


def test_cross_fitted_threat_meets_roles_once_and_scores_by_its_own_fold(spark, monkeypatch):
    from veldt.operators import models

    i = F.col("id")
    rows = spark.range(1500).select("id", (i % 60).alias("m"), (i % 60 % 3).cast("int").alias("fold"), ((i * 7) % 97 / 96.0).alias("x"), ((i * 5) % 89 / 88.0).alias("y"), ((i * 3) % 83 / 82.0).alias("ex"), ((i * 11) % 79 / 78.0).alias("ey"), (i % 95 / 90.0).alias("time"), (1 + i % 2).alias("period"), (1 + i % 7).alias("stage"), ((i * i) % 11 < 3 + i % 3).cast("int").alias("hit"))
    columns = {"x": F.col("x"), "y": F.col("y"), "end_x": F.col("ex"), "end_y": F.col("ey"), "time": F.col("time"), "period": F.col("period"), "stage": F.col("stage")}
    calls, line = [], models.metrics.calibration_line
    monkeypatch.setattr(models.metrics, "calibration_line", lambda *a, **k: calls.append(1) or line(*a, **k))
    got = models.cross_fitted_threat(rows, "m", "fold", "hit", columns, ["id"], 3, 0.25, seed=5, iterations=8)
    assert len(calls) == 1
    got = {r["id"]: r for r in got.collect()}
    assert len(got) == 1500
    roles = models.threat_roles(rows, "m", "fold", 3, 0.25, 5).where("outer_fold = 1")
    own, start = rows.join(roles, "m"), models.state_points(columns)["start"]
    train = own.where("role = 'training'")
    scale = models.scaler(train, start)
    model = models.fit(train, "hit", models.scaled(start, scale), 1e-5, 0.0, 8).calibrated(own.where("role = 'calibration'"), "hit")
    want = own.where("role = 'holdout'").select("id", *(c.alias(k) for k, c in models.threats(model, scale, columns).items())).collect()
    assert len(want) == 500
    for r in want:
        assert got[r["id"]]["outer_fold"] == 1
        for k in models.POINTS:
            assert abs(got[r["id"]][f"threat_{k}"] - r[k]) < 1e-7


def test_a_match_of_two_roles_in_a_fold_is_an_error(spark):
    from veldt.operators import models

    rows = spark.createDataFrame([(1,)], "m int")
    roles = spark.createDataFrame([(0, 1, "training"), (0, 1, "holdout")], "outer_fold int, m int, role string")
    with pytest.raises(Exception, match="two roles"):
        models.dealt(rows, roles, "m", 1).collect()
