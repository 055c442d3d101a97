"""Queries of fitted models: threats from events to pass values, joint fits, frozen scoring and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import metrics as M
from veldt.operators import models
from veldt.operators import relational as R
from veldt.operators import windows as W
from veldt.plans.frames import PASSES, passes, rounded, table
from veldt.plans.registry import query

FOLDS, CALIBRATION, SEED, STEPS = 5, 0.25, 20260723, 10

#: Places on the pitch as simple functions of ids, the label of a purchase soon, and a fold for each match.
STATES = """st AS (SELECT event_id, user_id AS match_id, CAST(user_id % 5 AS INT) AS fold, (event_id % 97) / 96.0::DOUBLE AS x, ((event_id * 7) % 89) / 88.0::DOUBLE AS y, ((event_id * 5) % 101) / 100.0::DOUBLE AS end_x, ((event_id * 11) % 83) / 82.0::DOUBLE AS end_y,
  (event_id % 95) / 90.0::DOUBLE AS time, 1 + event_id % 2 AS period, row_number() OVER w AS stage, CAST(event_type <> 'error' AS INT) AS won, 0.05::DOUBLE + 0.009::DOUBLE * (event_id % 101) AS p,
  max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
COLUMNS = {c: F.col for c in ("x", "y", "end_x", "end_y", "time", "period", "stage")}


def _columns():
    return {c: f(c) for c, f in COLUMNS.items()}


def states(spark, d):
    e, i, order = table(spark, d, "events"), F.col("event_id"), ["ts", "event_id"]
    place = {"x": (i % 97) / 96.0, "y": ((i * 7) % 89) / 88.0, "end_x": ((i * 5) % 101) / 100.0, "end_y": ((i * 11) % 83) / 82.0}
    return e.select(
        "event_id", F.col("user_id").alias("match_id"), (F.col("user_id") % FOLDS).cast("int").alias("fold"), *(c.alias(k) for k, c in place.items()),
        ((i % 95) / 90.0).alias("time"), (1 + i % 2).alias("period"), W.stage(["user_id"], order).alias("stage"), (F.col("event_type") != "error").cast("int").alias("won"),
        (0.05 + 0.009 * (i % 101)).alias("p"), W.forward_label((F.col("event_type") == "purchase").cast("int"), ["user_id"], order, 5).alias("hit"),
    )


_ROLES = f"r AS (SELECT m.match_id, f.f AS outer_fold, CASE WHEN m.fold = f.f THEN 'holdout' WHEN CAST(('0x' || substr(sha256(CAST({SEED} + f.f AS VARCHAR) || '|' || m.match_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < {CALIBRATION} THEN 'calibration' ELSE 'training' END AS role FROM (SELECT DISTINCT match_id, fold FROM st) m, (SELECT CAST(unnest(range({FOLDS})) AS INT) AS f) f)"


@query("m8_threat_roles", f"WITH {STATES}, {_ROLES} SELECT outer_fold, role, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM r JOIN st USING (match_id) GROUP BY 1, 2")
def _(spark, d):
    """Rows and labels of every role in every fold: whole matches, each held out once."""
    s = states(spark, d)
    roles = models.threat_roles(s, "match_id", "fold", FOLDS, CALIBRATION, SEED)
    return s.join(roles, "match_id").groupBy("outer_fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


def _threat_values(spark, d):
    s = states(spark, d)
    got = models.cross_fitted_threat(s, "match_id", "fold", "hit", _columns(), ["event_id", "match_id", "won", "p"], FOLDS, CALIBRATION, seed=SEED, iterations=STEPS)
    v = S.pass_value(F.col("p"), F.col("threat_start"), F.col("threat_end"), F.col("threat_opponent"), F.col("won"), "double")
    return got.select("*", *(c.alias(k) for k, c in v.items()))


@query("m8_cross_fitted_threat_values")
def _(spark, d):
    """From events to pass values on threats that no row's own match was used for."""
    return rounded(_threat_values(spark, d), 6)


@query("m8_threat_identities", f"WITH {STATES} SELECT fold AS outer_fold, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, TRUE AS within, TRUE AS identities FROM st GROUP BY 1")
def _(spark, d):
    """Every row is scored once by its own fold; threats are probabilities; values add up."""
    v = _threat_values(spark, d)
    inside = [F.col(f"threat_{k}").between(0, 1) for k in models.POINTS]
    net = F.col("p") * (F.col("threat_end") - F.col("threat_start")) - (1 - F.col("p")) * (F.col("threat_start") + F.col("threat_opponent"))
    return v.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.every(inside[0] & inside[1] & inside[2]).alias("within"), (F.max(F.abs(net - F.col("expected_net_value"))) < 1e-12).alias("identities"))


#: A frozen model of five state features; scales are (mean, deviation).
_SCALE = {"x": (0.5, 0.3), "lateral": (0.4, 0.25), "goal_distance": (0.6, 0.3), "time": (0.5, 0.2), "stage": (1.1, 0.4)}
_WEIGHTS = {"x": 0.8, "lateral": -0.3, "goal_distance": -0.6, "time": 0.15, "stage": 0.25}


def _frozen_sql(x: str, y: str, stage: str) -> str:
    parts = {
        "x": x, "lateral": f"abs({y} - 0.5) * 2", "goal_distance": f"sqrt((1 - {x}) * (1 - {x}) + (({y} - 0.5) * (80.0::DOUBLE / 120.0)) * (({y} - 0.5) * (80.0::DOUBLE / 120.0)))",
        "time": "least(greatest(time, 0), 1.5)", "stage": f"ln(1 + least(greatest({stage}, 1), 100)::DOUBLE) / ln(11.0::DOUBLE)",
    }
    z = " + ".join(f"({_WEIGHTS[k]}) * (({c}) - {_SCALE[k][0]}) / {_SCALE[k][1]}" for k, c in parts.items())
    return f"1 / (1 + exp(-(0.2 + 1.1 * (-1.5 + {z}))))"


@query("m8_p21_frozen_threat_scoring", f"WITH {STATES}, t AS (SELECT event_id, p, won, {_frozen_sql('x', 'y', 'stage')} AS a, {_frozen_sql('end_x', 'end_y', '(stage + 1)')} AS b, {_frozen_sql('(1 - end_x)', '(1 - end_y)', '1')} AS c FROM st) SELECT event_id, round(a, 9) AS threat_start, round(b, 9) AS threat_end, round(c, 9) AS threat_opponent, round(p * (b - a) - (1 - p) * (a + c), 9) AS expected_net_value FROM t")
def _(spark, d):
    """The three scorings of stored coefficients, and the value that they give."""
    s = states(spark, d)
    features = {k: {n: c for n, c in f.items() if n in _WEIGHTS} for k, f in models.state_points(_columns()).items()}
    got = {k: models.Linear(-1.5, _WEIGHTS, (0.2, 1.1), models.scaled(f, _SCALE)).probability() for k, f in features.items()}
    rows = s.select("event_id", "p", "won", *(c.alias(f"threat_{k}") for k, c in got.items()))
    v = S.pass_value(F.col("p"), F.col("threat_start"), F.col("threat_end"), F.col("threat_opponent"), F.col("won"), "double")
    return rounded(rows.select("event_id", "threat_start", "threat_end", "threat_opponent", v["expected_net_value"].alias("expected_net_value")))


_FROZEN = {"flat": (0.5, 0.0, 0.0), "start": (0.2, 6.0, 0.0), "both": (0.9, 6.0, -4.0)}


@query("m3_k6_frozen_selection", f"WITH {PASSES}, q AS (SELECT c, won, 1 / (1 + exp(-(i + a * t_start + b * t_end))) AS q FROM pv, (VALUES {', '.join(f'({k!r}, {i}, {a}, {b})' for k, (i, a, b) in _FROZEN.items())}) f(c, i, a, b)), s AS (SELECT c, avg(-(won * ln(q) + (1 - won) * ln(1 - q))) AS log_loss, avg((q - won) * (q - won)) AS brier FROM q GROUP BY 1) SELECT c AS configuration, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, CAST(row_number() OVER (ORDER BY log_loss, brier, c) AS INT) AS place FROM s")
def _(spark, d):
    """Configurations with stored coefficients, ranked as tuning ranks them: by log loss, then Brier."""
    from pyspark.sql.window import Window

    v = passes(spark, d)
    features = {"a": F.col("t_start"), "b": F.col("t_end")}
    rows = [v.select(F.lit(k).alias("configuration"), F.col("won").alias("y"), models.Linear(i, {"a": a, "b": b}, features=features).raw().alias("p"), F.lit(1.0).alias("w")) for k, (i, a, b) in _FROZEN.items()]
    got = M.losses(R.union_all(*rows), ["configuration"])
    return rounded(got.withColumn("place", F.row_number().over(Window.orderBy("log_loss", "brier", "configuration"))))


@query("m6_m7_calibrated_folds", f"WITH {PASSES}, m AS (SELECT DISTINCT match_id, team FROM pv), h AS (SELECT *, (row_number() OVER (PARTITION BY team ORDER BY sha256('20260723|' || match_id)) - 1) % 3 AS own FROM m), f AS (SELECT h.*, CAST(t.f AS INT) AS outer_fold FROM h, range(3) t(f)), c AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, team ORDER BY sha256('20260723|calibration|' || outer_fold || '|' || match_id)) AS rn, count(*) OVER (PARTITION BY outer_fold, team) AS n FROM f WHERE own <> outer_fold), r AS (SELECT outer_fold, match_id, CASE WHEN n >= 2 AND rn <= least(n - 1, greatest(1, round_even(n * 0.125, 0))) THEN 'calibration' ELSE 'training' END AS role FROM c UNION ALL SELECT outer_fold, match_id, 'holdout' FROM f WHERE own = outer_fold) SELECT outer_fold, count(*) FILTER (role = 'training') AS n_training, count(*) FILTER (role = 'calibration') AS n_calibration, count(*) FILTER (role = 'holdout') AS n_holdout, round(avg(won) FILTER (role = 'training'), 4) AS raw_mean, round(avg(won) FILTER (role = 'calibration'), 4) AS calibrated_mean FROM r JOIN pv USING (match_id) GROUP BY 1")
def _(spark, d):
    """Fits and Platt lines of every fold, seen by what they must repeat: the labels' means of their own rows."""
    from veldt.plans.studies import _features

    v = passes(spark, d)
    roles = models.fold_roles(v.select("match_id", "team"), "match_id", ["team"], 3)
    own = models.dealt(v, roles, "match_id", 3).persist()
    out = []
    for f, model in enumerate(models.fit_folds(own, "won", lambda _, train: _features(train), 3, 1e-6, 0.0)):
        counts = [F.count_if(models.in_role(r, f)).alias(f"n_{r}") for r in ("training", "calibration", "holdout")]
        means = [F.avg(F.when(models.in_role(r, f), p)).alias(n) for r, p, n in (("training", model.raw(), "raw_mean"), ("calibration", model.probability(), "calibrated_mean"))]
        out.append(own.agg(*counts, *means).select(F.lit(f).alias("outer_fold"), "*"))
    return rounded(R.union_all(*out), 4)
