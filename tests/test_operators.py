"""Operators on small hand-made tables, and against plain computations."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veldt.operators import aggregates as A
from veldt.operators import checks as C
from veldt.operators import metrics as M
from veldt.operators import models
from veldt.operators import relational as R
from veldt.operators import resample
from veldt.operators import robustness as B
from veldt.operators import windows as W


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_forward_label_stays_in_its_group(spark):
    df = frame(spark, [(g, i, int((g, i) == (1, 4))) for g in (1, 2) for i in range(1, 6)], "g int, i int, e int")
    rows = df.select("g", "i", *(W.forward_label(F.col("e"), ["g"], ["i"], h).alias(f"h{h}") for h in (1, 3))).orderBy("g", "i").collect()
    assert [r["h1"] for r in rows] == [0, 0, 0, 1, 0] + [0] * 5 and [r["h3"] for r in rows] == [0, 1, 1, 1, 0] + [0] * 5
    with pytest.raises(ValueError):
        W.forward_label(F.col("e"), ["g"], ["i"], 0)


def test_ranks(spark):
    df = frame(spark, [(1, 10.0), (2, 10.0), (3, 8.0), (4, None)], "k int, v double").withColumn("g", F.lit(1))
    rows = df.select("k", W.min_rank("v", ["g"]).alias("m"), W.average_rank("v", ["g"], descending=True).alias("a")).orderBy("k").collect()
    assert [r["m"] for r in rows] == [1, 1, 3, None] and [r["a"] for r in rows] == [1.5, 1.5, 3.0, None]


@pytest.mark.parametrize("n", [1, 2, 7, 10, 33, 99])
def test_allocation_adds_up(spark, n):
    shares = {"train": 0.7, "tune": 0.1, "calibrate": 0.1, "test": 0.1}
    got = spark.range(1).select(W.allocation(F.lit(n), shares).alias("m")).first()["m"]
    assert sum(got.values()) == n and (n != 7 or [got[k] for k in shares] == [5, 1, 1, 0])


def test_folds_and_picks(spark):
    df = W.positions(spark.range(7).withColumn("s", F.lit("a")), ["s"], ["id"])
    assert [r[0] for r in df.orderBy("id").select(W.round_robin(5)).collect()] == [0, 1, 2, 3, 4, 0, 1]
    for n, want in ((20, 2), (2, 1), (1, 0)):
        got = W.positions(spark.range(n).withColumn("s", F.lit("a")), ["s"], ["id"]).select(W.calibration_pick(0.125).alias("c"))
        assert got.where("c").count() == want
    roles = models.fold_roles(spark.range(40).select(F.col("id").alias("m"), (F.col("id") % 2).alias("s")), "m", ["s"], 4)
    assert C.one_role_per_fold(roles, "outer_fold", "m", "role", "holdout").first()[:] == (0, 0)


def test_quantile_bins_equal_pandas(spark):
    rng = random.Random(3)
    values = [1.0, 2.0, 2.0, 3.0, 4.0] + [float(rng.randrange(40)) for _ in range(400)]
    for q, own in ((2, values[:5]), (20, values)):
        got = W.quantile_bins(frame(spark, list(enumerate(own)), "i int, v double"), "v", q).orderBy("i").collect()
        assert [r["bin"] for r in got] == pd.qcut(own, q, labels=False, duplicates="drop").tolist()


def test_bins_at_their_edges(spark):
    df = frame(spark, [(x,) for x in (0.0, 0.05, 0.1, 0.95, 1.0)], "p double")
    rows = df.select(W.right_closed_bin(F.col("p"), 20).alias("r"), W.left_closed_bin(F.col("p"), 20).alias("l")).collect()
    assert [r["r"] for r in rows] == [0, 0, 1, 18, 19] and [r["l"] for r in rows] == [0, 1, 2, 19, 19]


def test_weighted_median_and_spearman(spark):
    df = frame(spark, [(1.0, 1), (2.0, 1), (3.0, 2), (None, 5), (9.0, 0)], "v double, w int")
    assert A.weighted_median(df, "v", "w").first()[0] == 2.0
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, 200).astype(float), rng.integers(0, 9, 200).astype(float)
    got = A.spearman(frame(spark, list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y").first()["spearman"]
    assert math.isclose(got, np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1], abs_tol=1e-12)
    assert A.spearman(frame(spark, [(1.0, 2.0), (2.0, 3.0)], "x double, y double"), "x", "y").first()["spearman"] is None
    assert A.spearman(frame(spark, [(1.0, 2.0)] * 4, "x double, y double"), "x", "y").first()["spearman"] is None


def scored(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.integers(1, 20, n) / 20.0
    y = (rng.random(n) < p).astype(int)
    w = rng.integers(1, 4, n).astype(float)
    return frame(spark, [(float(a), int(b), float(c), int(i % 9)) for i, (a, b, c) in enumerate(zip(p, y, w))], "p double, y int, w double, m int"), p, y, w


def test_auc_and_precision_by_definition(spark):
    df, p, y, w = scored(spark)
    a, b = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pair = w[a][:, None] * w[b][None, :]
    better = (p[a][:, None] > p[b][None, :]) + 0.5 * (p[a][:, None] == p[b][None, :])
    assert math.isclose(M.auc(df, []).first()["auc"], (pair * better).sum() / pair.sum(), abs_tol=1e-12)
    got, seen, hits, total = 0.0, 0.0, 0.0, w[y == 0].sum()
    for s in np.unique(p):
        own = p == s
        fails = w[own & (y == 0)].sum()
        seen, hits = seen + w[own].sum(), hits + fails
        got += hits / seen * fails / total
    assert math.isclose(M.average_precision(df, []).first()["average_precision"], got, abs_tol=1e-12)
    assert M.auc(df.where("y = 1"), []).first()["auc"] is None


def test_classification_without_predicted_failures(spark):
    df = frame(spark, [(0.9, 1), (0.8, 0)], "p double, y int")
    row = M.failure_classification(df, []).first()
    assert row["failure_precision"] == 0 and row["failure_f1"] == 0 and row["accuracy"] == 0.5


def test_calibration_line(spark):
    df, p, y, w = scored(spark, 2000)
    line = M.calibration_line(df, []).first()
    x = np.log(p / (1 - p))
    beta = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        m = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (w * m * (1 - m))[:, None]), design.T @ (w * (y - m)))
    assert np.allclose([line["intercept"], line["slope"]], beta, atol=1e-8)
    flat = M.calibration_line(df.withColumn("p", F.lit(0.4)), []).first()
    assert flat["slope"] == 0 and math.isclose(flat["intercept"], math.log((w * y).sum() / (w * (1 - y)).sum()), abs_tol=1e-9)
    assert M.calibration_line(df, ["m"]).count() == 9


def test_calibration_line_holds_a_row_for_each_probability(spark, monkeypatch):
    rows = [(m, 0.1 + 0.2 * (i % 4), int(i % 7 < 3 + i % 2), float(1 + i % 3)) for m in ("a", "b") for i in range(400)]
    df, held, own = frame(spark, rows, "m string, p double, y int, w double"), [], M.windows.matched
    monkeypatch.setattr(M.windows, "matched", lambda *a: held.append(a[0]) or own(*a))
    got = {r["m"]: r for r in M.calibration_line(df, ["m"]).collect()}
    assert held[0].count() == 2 * 4 * 2
    for r in got.values():
        rest = [(w, math.log(p / (1 - p)), y) for m, p, y, w in rows if m == r["m"]]
        left = [(w * (y - 1 / (1 + math.exp(-r["intercept"] - r["slope"] * x))), x) for w, x, y in rest]
        assert abs(sum(a for a, _ in left)) < 1e-6 and abs(sum(a * x for a, x in left)) < 1e-6


def test_reliability_keeps_empty_bins(spark):
    df, *_ = scored(spark)
    assert M.reliability(df, [], 40).count() == 40 and M.reliability_wilson(df, [], 40).count() < 40
    row = M.reliability_wilson(df, [], 1).first()
    assert row["low"] < row["observed"] < row["high"]


def test_bootstrap(spark):
    stats = frame(spark, [(i, 10 + i, float(i)) for i in range(6)], "m int, n int, v double")
    weights = resample.bootstrap_weights(stats, "m", 50, 7)
    assert {r[0] for r in weights.groupBy("replicate").agg(F.sum("weight").alias("s")).select("s").distinct().collect()} == {6}
    one = resample.ratio_intervals(stats.where("m = 3"), "m", {"r": ("v", "n", 100.0)}, 50).first()
    assert one["r"] == one["r_low"] == one["r_high"]
    row = resample.ratio_intervals(stats, "m", {"r": ("v", "n", 100.0)}, 200).first()
    assert row["r_low"] <= row["r"] <= row["r_high"]


def test_permutation_moves_columns_together(spark):
    df = frame(spark, [(i, i % 3, i * 10, i * 100) for i in range(60)], "i int, g int, a int, b int")
    out = W.permuted(df, ["g"], "i", ["a", "b"], 5)
    rows = out.collect()
    assert out.columns == df.columns and all(r["b"] == 10 * r["a"] for r in rows) and any(r["a"] != 10 * r["i"] for r in rows)
    assert all(r["a"] // 10 % 3 == r["g"] for r in rows) and sorted(r["a"] for r in rows) == [10 * i for i in range(60)]


def test_permutation_importance_deals_as_windows_do(spark):
    random.seed(11)
    rows = [(i, random.choice([None, 0, 1, 1, 1, *range(2, 9)]), i % 3 == 0, random.random(), random.random()) for i in range(400)]
    df = frame(spark, [(a, b, int(c), d, e) for a, b, c, d, e in rows], "i int, m int, y int, a double, b double").repartition(5)

    def score():
        return 0.1 + 0.4 * (F.col("a") + F.col("b"))

    base = M.all_metrics(df.select("y", score().alias("p"), F.lit(1.0).alias("w")), []).first()
    for largest in (resample.LARGEST, 50, 0):
        got = {(r[0], r[1]): r for r in resample.permutation_importance(df, score, "m", "i", {"one": ["a"], "both": ["a", "b"]}, 2, 3, largest=largest).collect()}
        assert set(got) == {(g, r) for g in ("one", "both") for r in (0, 1)}
        for (name, r), row in got.items():
            moved = W.permuted(df.where("m is not null"), ["m"], "i", ["a"] if name == "one" else ["a", "b"], 3 + r)
            want = M.all_metrics(moved.select("y", score().alias("p"), F.lit(1.0).alias("w")), []).first()
            assert all(row[f"{n}_delta"] == pytest.approx(want[n] - base[n]) for n in ("log_loss", "brier", "auc", "average_precision"))


def test_permuted_repeats_shuffle_no_row_twice(spark):
    df = frame(spark, [(i, i % 3, i % 2, i / 100) for i in range(90)], "i int, m int, y int, a double")
    seen = []
    original, M.all_metrics = M.all_metrics, lambda rows, by: seen.append(rows) or original(rows, by)
    try:
        resample.permutation_importance(df, lambda: F.col("a"), "m", "i", {"one": ["a"]}, 3, 3)
    finally:
        M.all_metrics = original
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_greedy_pairs(spark):
    pairs = frame(spark, [("r1", "a", "b", 9.0), ("r1", "c", "d", 8.0), ("r2", "b", "e", 7.0), ("r3", "c", "f", 6.0)], "role string, l string, r string, d double")
    got = R.greedy_pairs(pairs, 3, "role", ["l", "r"], [F.desc("d"), F.col("l")]).collect()
    assert [(x["role"], x["l"], x["r"], x["selected_pair"]) for x in got] == [("r1", "a", "b", 1), ("r3", "c", "f", 2)]
    assert R.greedy_pairs(pairs.where("false"), 3, "role", ["l", "r"], [F.desc("d")]).count() == 0


def test_checks(spark):
    df = frame(spark, [(1, 0.5), (1, 2.0), (2, None)], "k int, p double")
    assert C.duplicates(df, "k").first()[:] == (1, 2)
    with pytest.raises(C.IntegrityError):
        C.require_columns(df, "k", "missing")
    assert C.missing(df, "p").first()[0] == 1 and C.violations(df, ok=F.col("p").between(0, 1)).first()[0] == 2
    assert C.audit({"a": True}).gate().status == "PASS" and C.audit({"a": False}, {"a"}).gate().status == "REVIEW_REQUIRED"
    with pytest.raises(C.IntegrityError):
        C.audit({"a": False, "b": True}).gate()


def test_lookup_join_requires_a_partner(spark):
    df = frame(spark, [(1,), (2,)], "k int")
    table = frame(spark, [(1, "x")], "k int, v string")
    assert {r["v"] for r in R.lookup_join(df, table, ["k"], {"v": "unknown"}).collect()} == {"x", "unknown"}
    with pytest.raises(PySparkException):
        R.lookup_join(df, table, ["k"], required="v").collect()


def test_columns_by_alias(spark):
    df = frame(spark, [(1, 2)], "`Match ID` int, b int")
    assert R.find_column(df, ["match_id", "game"]) == "Match ID"
    assert R.fill_columns(df, {"b": "bigint", "c": "string"}).first()[:] == (2, None)
    with pytest.raises(C.IntegrityError):
        R.find_column(df, ["zzz"])


def model_rows(spark, n=900):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x + (c == 1) - 0.5)))).astype(int)
    return frame(spark, [(i, i % 30, i % 2, float(a), "abc"[b], int(t)) for i, (a, b, t) in enumerate(zip(x, c, y))], "id int, m int, s int, x double, c string, y int")


def test_cross_fit_scores_every_row_once(spark):
    df = model_rows(spark)
    roles = models.fold_roles(df, "m", ["s"], 3)

    def features(train):
        return models.standardised(train, {"x": F.col("x")}) | models.one_hot(models.freeze_categories(train, ["c"]))

    out = models.cross_fit(df, roles, "m", "y", features, ["id", "m"], 3, alpha=1e-4, l1=0.0)
    assert out.count() == out.select("id").distinct().count() == df.count()
    assert M.auc(out.withColumn("w", F.lit(1.0)), []).first()["auc"] > 0.7
    line = M.calibration_line(out.withColumn("w", F.lit(1.0)), []).first()
    assert abs(line["slope"] - 1) < 0.5


def test_model_save_and_order(spark, tmp_path):
    from veldt.sources import tables

    df = model_rows(spark)
    features = {"x": F.col("x")} | models.one_hot({"c": ["a", "b", "c"]})
    model = models.fit(df, "y", features, 1e-3, 0.3).calibrated(df, "y")
    tables.save_model(model, str(tmp_path / "m"), spark)
    again = tables.load_model(str(tmp_path / "m"), spark, features)
    assert again.weights == model.weights and again.platt == model.platt and model.importance()[0][0] == "x"
    p = df.select(model.probability().alias("a"), again.probability().alias("b"))
    assert p.where("a <> b or a <= 0 or a >= 1").count() == 0
    unseen = frame(spark, [("z",)], "c string").select(*(c.alias(k) for k, c in models.one_hot({"c": ["a", "b"]}).items())).first()
    assert tuple(unseen) == (0.0, 0.0)


def test_paired_differences_favour_the_full_model(spark):
    df = model_rows(spark).select("m", "y", (1 / (1 + F.exp(-1.5 * F.col("x")))).alias("full"), F.lit(0.5).alias("flat"), (0.3 + 0.4 * F.rand(1)).alias("noise"))
    long = df.unpivot(["m", "y"], ["full", "noise"], "model", "p")
    diff = resample.paired_differences(resample.metric_replicates(long, "m", "model", 20, 1), "full")
    row = A.replicate_summary(diff, "auc", ["comparator"]).first()
    assert row["low"] > 0 and row["replicates"] == 20


def test_comparison_needs_three_players(spark):
    df = frame(spark, [(s, p, float(v), float(v)) for s in ("ref", "x") for p, v in ((1, 1), (2, 2))], "spec string, player int, d double, e double")
    row = B.compare_players(df, "spec", "ref", ["player"], "d", "e", 10).first()
    assert row["common_players"] == 2 and row["decision_spearman"] is None and row["quadrant_agreement"] is None


def test_golden_team_identities():
    """Published team figures: net is success value less failure cost, and centring subtracts the baseline."""
    baseline = -0.9528630592451951
    for net, centred in ((-0.9770, -0.0241), (-1.2479, -0.2950), (-0.6185, 0.3344)):
        assert abs(net - baseline - centred) < 1e-4


def test_positions_in_large_and_null_groups(spark):
    rows = [(None if i % 7 == 0 else "ab"[i % 7 == 1], f"{(i * 7919) % 3001:04d}", i) for i in range(3001)]
    got = W.positions(frame(spark, rows, "g string, o string, i int").repartition(6), ["g"], ["o"])
    groups = {}
    for g, o, i in rows:
        groups.setdefault(g, []).append((o, i))
    want = {i: (k, len(own)) for own in groups.values() for k, (_, i) in enumerate(sorted(own), 1)}
    assert {r["i"]: (r["__place"], r["__size"]) for r in got.collect()} == want
    assert W.positions(frame(spark, [], "g string, o string"), ["g"], ["o"]).count() == 0
    assert sorted(r["__place"] for r in W.positions(spark.range(9), [], ["id"]).collect()) == list(range(1, 10))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__range" in plan and plan.count("Scan ExistingRDD") >= 1


def test_null_groups_are_groups(spark):
    rows = [(g, float(i % 5), float((i * 3) % 7), i % 2, 0.1 + 0.05 * (i % 9), 1.0 + i % 3) for g in (None, "a") for i in range(24)]
    df = frame(spark, rows, "g string, x double, z double, y int, p double, w double")
    alone = {g: df.where(F.col("g").eqNullSafe(F.lit(g))).drop("g") for g in (None, "a")}
    for f in (
        lambda d, by: M.auc(d, by), lambda d, by: M.average_precision(d, by), lambda d, by: M.all_metrics(d, by), lambda d, by: A.describe(d, "x", by),
        lambda d, by: A.weighted_median(d, "x", "w", by), lambda d, by: A.spearman(d, "x", "z", by), lambda d, by: W.exact_quantiles(d, "x", [0.3], by), lambda d, by: M.calibration_line(d, by),
    ):
        got = {r["g"]: r.asDict() for r in f(df, ["g"]).collect()}
        assert set(got) == {None, "a"}
        for g, own in alone.items():
            (want,) = f(own, []).collect()
            for k, v in want.asDict().items():
                assert got[g][k] == pytest.approx(v)


def test_lines_of_separated_labels_are_finite(spark):
    rows = [("apart", 0.1, 0), ("apart", 0.3, 0), ("apart", 0.6, 1), ("apart", 0.9, 1), ("turned", 0.2, 1), ("turned", 0.4, 0), ("one", 0.2, 1), ("one", 0.7, 1), ("fine", 0.2, 0), ("fine", 0.4, 1), ("fine", 0.6, 0), ("fine", 0.9, 1)]
    df = frame(spark, rows, "g string, p double, y int").withColumn("w", F.lit(1.0))
    got = {r["g"]: r for r in M.calibration_line(df, ["g"]).collect()}
    assert set(got) == {"apart", "turned", "one", "fine"}
    assert got["apart"]["slope"] > 1 and got["turned"]["slope"] < 0 and got["one"]["intercept"] > 1
    for g, own in got.items():  # the gradient of what is fitted is zero
        z = 0.0 if g == "fine" else M.RIDGE * sum(r[0] == g for r in rows)
        x = [(math.log(p / (1 - p)), y) for k, p, y in rows if k == g]
        rest = [(a, y - 1 / (1 + math.exp(-own["intercept"] - own["slope"] * a))) for a, y in x]
        assert abs(sum(r for _, r in rest) - z * own["intercept"]) < 1e-6 and abs(sum(a * r for a, r in rest) - z * own["slope"]) < 1e-6


def test_caliper_pairs_are_those_of_all_pairs(spark):
    random.seed(8)
    rows = [(i, random.choice(["r", "s", None]), f"t{i % 4}", random.choice([None, float("nan"), 0.0, 0.3, round(random.gauss(0, 1), 1)]), random.choice([0.0, -1.0, 0.1, 1.0, 1.1, 2.5, 1e6])) for i in range(120)]
    df = frame(spark, rows, "id int, role string, team string, a double, b double").repartition(4)
    for absolute, relative in (({"a": 0.3}, {}), ({"a": 0.0}, {"b": 0.1}), ({}, {"b": 0.5}), ({"a": 0.1, "b": 0.1}, {"b": 2.0})):
        def near(x, y):
            if any(v is None or v != v for c in (*absolute, *relative) for v in (x[3 if c == "a" else 4], y[3 if c == "a" else 4])):
                return False
            value = {"a": (x[3], y[3]), "b": (x[4], y[4])}
            return all(abs(value[c][0] - value[c][1]) <= k for c, k in absolute.items()) and all(sum(value[c]) > 0 and abs(value[c][0] - value[c][1]) / (sum(value[c]) / 2) <= k for c, k in relative.items())

        want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] is not None and x[2] != y[2] and near(x, y)}
        got = R.caliper_pairs(df, "role", "team", ["id"], ["b"], absolute, relative)
        assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == sorted(want)
    with pytest.raises(C.IntegrityError):
        R.pairs_within(df, "role", "team", ["id"], ["b"], most=100)


def test_pairs_of_blocks_are_all_pairs(spark):
    random.seed(10)
    rows = [(i, random.choice(["r", "r", "s", None]), f"t{i % 4}", random.choice([0.0, 0.3, random.gauss(0, 1)])) for i in range(150)]
    df = frame(spark, rows, "id int, role string, team string, a double").repartition(3)
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] is not None and x[2] != y[2])
    whole = {(r["left_id"], r["right_id"]): r["profile_distance"] for r in R.pairs_within(df, "role", "team", ["id"], ["a"]).collect()}
    got = R.pairs_within(df, "role", "team", ["id"], ["a"], block=7)
    assert R.pairs_within.__defaults__[0] is None  # no bound of its own
    assert got.columns == R.pairs_within(df, "role", "team", ["id"], ["a"]).columns
    rows = {(r["left_id"], r["right_id"]): r["profile_distance"] for r in got.collect()}
    assert sorted(rows) == sorted(whole) == want and all(rows[k] == pytest.approx(whole[k]) for k in want)


def test_greedy_rounds_take_what_the_scan_takes(spark):
    random.seed(9)
    for n in (1, 30, 400):
        rows = [(i, random.choice([None, *range(9)]), f"p{random.randint(0, 25)}", f"p{random.randint(0, 25)}", random.randint(0, 30)) for i in range(n)]
        used, want = set(), []
        for r in sorted(rows, key=lambda r: (-r[4], r[0])):
            keys = {("once", r[1]), ("party", r[2]), ("party", r[3])}
            if not keys & used:
                used |= keys
                want.append(r[0])
        pairs = frame(spark, rows, "id int, role int, l string, r string, d int").repartition(3)
        for most in (2, 100):
            got = R.greedy_pairs(pairs, most, "role", ["l", "r"], [F.desc("d"), F.col("id")])
            assert [r["id"] for r in got.orderBy("selected_pair").collect()] == want[:most]


def test_widest_pairs_by_bands_are_those_of_all_pairs(spark, monkeypatch):
    random.seed(13)
    rows = [(i, random.choice([None, *range(6)]), i % 4, random.choice([None, float("nan"), float("inf"), 0.0, round(random.uniform(-20, 20), 1), round(random.uniform(-20, 20), 1)])) for i in range(200)]
    df = frame(spark, rows, "id int, role int, team int, v double").withColumn("same", F.lit(1.0)).repartition(3)
    made, own = [], R._band
    monkeypatch.setattr(R, "_band", lambda *a: made.append(a[-2:]) or own(*a))
    known = [r for r in rows if r[1] is not None and r[3] is not None and abs(r[3]) < float("inf")]
    for most, caliper in ((2, 5.0), (100, 5.0), (100, 1e-3)):
        scan = sorted(((-abs(x[3] - y[3]), x[0], y[0], x[1]) for x in known for y in known if x[0] < y[0] and x[1] == y[1] and x[2] != y[2] and abs(x[3] - y[3]) <= caliper))
        want, used = [], set()
        for d, x, y, role in scan:
            if not {("r", role), x, y} & used and len(want) < most:
                used |= {("r", role), x, y}
                want.append((role, x, y))
        made.clear()
        got = R.greedy_widest_pairs(df.where("abs(v) < double('infinity')"), "role", "team", ["id"], ["same"], "v", caliper, most, band=50)
        picked = [(r["role"], r["left_id"], r["right_id"]) for r in got.orderBy("selected_pair").collect()]
        assert [r["selected_pair"] for r in got.orderBy("selected_pair").collect()] == list(range(1, len(picked) + 1))
        assert picked == want
        if most == 2:
            assert made[0][1] == 5.0 and made[0][0] > 4.0 and made[-1][0] > 0  # narrow bands, and not all of them


def test_bootstrap_of_ordered_metrics_equals_copied_rows(spark, monkeypatch):
    random.seed(6)
    rows = [(random.choice([None, *range(12)]), m, random.randint(0, 1), random.choice([0.2, 0.5, round(random.random(), 2)])) for _ in range(150) for m in ("full", "other")]
    rows += [(99, "full", 1, 0.5)] * 300  # a hot score and cluster
    df = frame(spark, rows, "match int, model string, y int, p double").repartition(3)
    monkeypatch.setattr(resample, "CHUNK", 7)
    got = {(r["replicate"], r["model"]): r for r in resample.metric_replicates(df, "match", "model", 23, 5, block=10).collect()}
    weight = {}
    for r in resample.bootstrap_weights(df, "match", 23, 5).collect():
        weight.setdefault(r["replicate"], {})[r["match"]] = r["weight"]
    for (k, model), r in got.items():
        own = [(y, p, weight[k].get(m, 0)) for m, o, y, p in rows if o == model and weight[k].get(m, 0)]
        up, down = sum(w for y, _, w in own if y), sum(w for y, _, w in own if not y)
        if up and down:
            area = sum(v * w * (1.0 if q < p else 0.5 if q == p else 0.0) for y, p, v in own if y for z, q, w in own if not z)
            assert r["auc"] == pytest.approx(area / up / down)
        steps = sum(w * sum(v for z, q, v in own if not z and q <= p) / sum(v for _, q, v in own if q <= p) for y, p, w in own if not y)
        assert r["average_precision"] == (pytest.approx(steps / down) if down else None)
        assert r["log_loss"] == pytest.approx(-sum(w * math.log(p if y else 1 - p) for y, p, w in own) / (up + down))
        assert r["brier"] == pytest.approx(sum(w * (p - y) ** 2 for y, p, w in own) / (up + down))
    assert set(got) == {(k, m) for k in range(23) for m in ("full", "other") if any(weight[k].get(a, 0) for a, o, *_ in rows if o == m)}


def test_bootstrap_of_few_scores_equals_that_of_ranges(spark, monkeypatch):
    random.seed(12)
    rows = [(random.choice([None, *range(40)]), m, random.randint(0, 1), random.choice([0.2, 0.5, round(random.random(), 1)])) for _ in range(300) for m in ("full", "other")]
    rows += [(99, "alone", 1, 0.5), (3, None, 1, 0.5)]
    df = frame(spark, rows, "match int, kind string, y int, p double").repartition(3)
    monkeypatch.setattr(resample, "CLUSTERS", 7)
    names, used = ("auc", "average_precision", "log_loss", "brier"), []
    monkeypatch.setattr(resample, "_ordered", lambda *a, own=resample._ordered: used.append(a) or own(*a))

    def found():
        got = resample.metric_replicates(df, "match", "kind", 15, 5, block=10)
        assert got.columns == ["replicate", "kind", *names]
        return {(r["replicate"], r["kind"]): [r[n] for n in names] for r in got.collect()}

    few = found()
    assert not used  # no cluster's weights are sent to every range of scores
    monkeypatch.setattr(resample, "SCORES", 0)
    many = found()
    assert used and set(few) == set(many) and {k for _, k in few} == {"full", "other", "alone"}
    for k, row in few.items():
        assert row == [pytest.approx(x) if x is not None else None for x in many[k]]


def test_audited_joins_check_in_their_own_job(spark, tmp_path):
    df = frame(spark, [(1, 0.5), (1, 2.0), (2, None), (None, 1.0)], "k int, p double").repartition(3)
    one = frame(spark, [(1, "a"), (2, "b"), (7, "c")], "k int, v string")
    context = spark.sparkContext
    context.setJobGroup("audited", "audited joins")
    good = C.joined(df.where("k IS NOT NULL"), one, ["k"], validate="m:1", complete=True)
    assert list(context.statusTracker().getJobIdsForGroup("audited")) == []  # nothing has run yet
    assert sorted((r["k"], r["v"]) for r in good.collect()) == [(1, "a"), (1, "a"), (2, "b")]
    context.setLocalProperty("spark.jobGroup.id", None)
    for bad, message in (
        (C.joined(df, one, ["k"], validate="1:1"), "repeated keys"),
        (C.joined(one, df, ["k"], validate="m:1"), "repeated keys"),
        (C.joined(one, df, ["k"], validate="1:m", complete=True), "without a partner"),
        (C.joined(df, one, ["k"], "left", "m:1", True), "without a partner"),  # a null key has none
    ):
        with pytest.raises(PySparkException, match=message):
            bad.select("v").collect()
        with pytest.raises(PySparkException):
            bad.write.parquet(str(tmp_path / "out"))
        assert not list(tmp_path.glob("out/*.parquet"))
    assert C.joined(one, df, ["k"], "left", "1:m").count() == 4
    with pytest.raises(ValueError):
        C.joined(one, df, ["k"], "right", "m:m", True)


def test_quantiles_by_narrowing_equal_pandas(spark, monkeypatch):
    rng = np.random.default_rng(2)
    hot = np.where(rng.random(6000) < 0.4, 1.5, rng.normal(0, 1, 6000)).round(3)
    data = pd.DataFrame({"g": [["a", "b", None][i % 3] for i in range(6000)] , "v": hot})
    data = pd.concat([data, pd.DataFrame({"g": ["one", "two", "two"], "v": [7.0, 1.0, 2.0]})])
    rows = [(g if isinstance(g, str) else None, float(v)) for g, v in data.itertuples(index=False)] + [("a", None), ("a", float("nan")), ("none", None)]
    df = frame(spark, rows, "g string, v double").repartition(5)
    shares = [0.0, 0.001, 0.25, 0.5, 0.61, 0.95, 1.0]
    for accuracy in (10_000, 100, 40):  # whole groups, and intervals of 6 and of 15 percent of a group
        monkeypatch.setattr(W, "ACCURACY", accuracy)
        got = {r["g"]: r["q"] for r in W.exact_quantiles(df, "v", shares, ["g"], "q").collect()}
        assert set(got) == {"a", "b", None, "one", "two"}
        for g, q in got.items():
            np.testing.assert_allclose(q, data[data.g.isna() if g is None else data.g == g].v.quantile(shares).to_numpy(), rtol=0, atol=1e-12)
        np.testing.assert_allclose(W.exact_quantiles(df, "v", shares).first()[0], data.v.quantile(shares).to_numpy(), rtol=0, atol=1e-12)
    whole = frame(spark, [(i,) for i in range(101)], "v bigint")
    assert W.exact_quantiles(whole, "v", [0.5, 0.255]).first()[0] == [50.0, 25.5]
    assert W.exact_quantiles(whole.where("false"), "v", [0.5]).count() == 0
