"""Queries of ranking, loss and calibration metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import metrics as M
from veldt.plans.frames import PASSES, passes, rounded
from veldt.plans.registry import query


def _long(spark, d):
    """Both models' probabilities in long form."""
    base = passes(spark, d).select("event_id", "match_id", F.col("won").alias("y"), F.col("p").alias("main"), F.col("p_other").alias("other"))
    return base.unpivot(["event_id", "match_id", "y"], ["main", "other"], "model", "p").withColumn("w", (1 + F.col("event_id") % 3).cast("double"))


_L = f"WITH {PASSES}, l AS (SELECT 'main' AS model, event_id, match_id, won AS y, p, CAST(1 + event_id % 3 AS DOUBLE) AS w FROM pv UNION ALL SELECT 'other', event_id, match_id, won, p_other, CAST(1 + event_id % 3 AS DOUBLE) FROM pv)"
_AUC = ", t AS (SELECT model, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b FROM l GROUP BY 1, 2), u AS (SELECT *, a * (COALESCE(sum(b) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2) AS v FROM t), auc AS (SELECT model, sum(v) / (sum(a) * sum(b)) AS auc FROM u GROUP BY 1)"
_AP = ", f AS (SELECT model, p, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b, sum(w) AS w FROM l GROUP BY 1, 2), g AS (SELECT *, sum(b) OVER (PARTITION BY model ORDER BY p) / sum(w) OVER (PARTITION BY model ORDER BY p) * b AS v FROM f), ap AS (SELECT model, sum(v) / sum(b) AS average_precision FROM g GROUP BY 1)"


@query("m10_auc", _L + _AUC + " SELECT model, round(auc, 9) AS auc FROM auc")
def _(spark, d):
    return rounded(M.auc(_long(spark, d), ["model"]))


@query("m11_average_precision", _L + _AP + " SELECT model, round(average_precision, 9) AS average_precision FROM ap")
def _(spark, d):
    return rounded(M.average_precision(_long(spark, d), ["model"]))


@query("m12_losses", _L + " SELECT model, round(sum(-w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 9) AS log_loss, round(sum(w * (p - y) * (p - y)) / sum(w), 9) AS brier FROM l GROUP BY 1")
def _(spark, d):
    return rounded(M.losses(_long(spark, d), ["model"]))


_CLS = ", n AS (SELECT model, CAST(count(*) FILTER (p < 0.5 AND y = 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (p < 0.5 AND y = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (p >= 0.5 AND y = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS DOUBLE) AS tn FROM l GROUP BY 1)"


@query("m13_failure_classification", _L + _CLS + " SELECT model, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(tp / (tp + fp), 9) AS failure_precision, round(tp / (tp + fn), 9) AS failure_recall, round(2 * tp / (2 * tp + fp + fn), 9) AS failure_f1 FROM n")
def _(spark, d):
    return rounded(M.failure_classification(_long(spark, d), ["model"]))


def _newton(steps: int) -> str:
    out = [_L + ", t AS (SELECT model, ln(p / (1 - p)) AS x, CAST(y AS DOUBLE) AS y, sum(w) AS w FROM l GROUP BY 1, 2, 3), s0 AS (SELECT DISTINCT model, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM t)"]
    for i in range(steps):
        out.append(f"z{i} AS (SELECT t.model, a, b, x, w, y, 1 / (1 + exp(-(a + b * x))) AS m FROM t JOIN s{i} USING (model)), g{i} AS (SELECT model, any_value(a) AS a, any_value(b) AS b, sum(w * (y - m)) AS g0, sum(w * (y - m) * x) AS g1, sum(w * m * (1 - m)) AS h00, sum(w * m * (1 - m) * x) AS h01, sum(w * m * (1 - m) * x * x) AS h11 FROM z{i} GROUP BY 1), s{i + 1} AS (SELECT model, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM g{i})")
    return ", ".join(out) + f" SELECT model, round(a, 6) AS intercept, round(b, 6) AS slope FROM s{steps}"


@query("m14_m15_calibration_line", _newton(10))
def _(spark, d):
    return rounded(M.calibration_line(_long(spark, d), ["model"]), 6)


@query("m16_reliability", _L + ", b AS (SELECT model, CAST(greatest(0, least(19, ceil(round(p * 20, 9)) - 1)) AS INT) AS bin, sum(w) AS weight, sum(w * p) / sum(w) AS mean_p, sum(w * y) / sum(w) AS observed FROM l GROUP BY 1, 2) SELECT m.model, CAST(r.bin AS INT) AS bin, weight, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed FROM (SELECT DISTINCT model FROM l) m CROSS JOIN range(20) r(bin) LEFT JOIN b ON b.model = m.model AND b.bin = r.bin")
def _(spark, d):
    return rounded(M.reliability(_long(spark, d), ["model"]))


_ECE = "SELECT model, round(sum(g) / sum(w), 9) AS ece, round(max(g / w), 9) AS max_gap FROM (SELECT model, {bin} AS bin, sum(w) AS w, abs(sum(w * p) - sum(w * y)) AS g FROM l GROUP BY 1, 2) GROUP BY 1"


@query("m16_m17_calibration_error", _L + " SELECT 'left' AS closed, * FROM (" + _ECE.format(bin="least(19, floor(round(p * 20, 9)))") + ") UNION ALL SELECT 'right', * FROM (" + _ECE.format(bin="greatest(0, least(19, ceil(round(p * 20, 9)) - 1))") + ")")
def _(spark, d):
    rows = _long(spark, d)
    parts = [M.calibration_error(rows, ["model"], 20, side).select(F.lit(side).alias("closed"), "*") for side in ("left", "right")]
    return rounded(parts[0].unionByName(parts[1]))


_Z = 1.959963984540054
_WILSON = f"SELECT bin, n, round(mean_p, 9) AS mean_p, CAST(s AS DOUBLE) AS successes, round(s / n, 9) AS observed, round((s / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} / (1 + {_Z * _Z} / n) * sqrt(s / n * (1 - s / n) / n + {_Z * _Z} / (4 * n * n)), 9) AS low, round((s / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} / (1 + {_Z * _Z} / n) * sqrt(s / n * (1 - s / n) / n + {_Z * _Z} / (4 * n * n)), 9) AS high FROM (SELECT {{bin}} AS bin, count(*) AS n, avg(p) AS mean_p, CAST(sum(y) AS DOUBLE) AS s FROM {{rows}} GROUP BY 1)"


@query("m18_reliability_wilson", _L + " " + _WILSON.format(bin="CAST(greatest(0, least(9, ceil(round(p * 10, 9)) - 1)) AS INT)", rows="l WHERE model = 'main'"))
def _(spark, d):
    return rounded(M.reliability_wilson(_long(spark, d).where("model = 'main'"), []))


@query("m18_reliability_wilson_quantile", _L + ", e AS (SELECT list_distinct(quantile_cont(p, [i / 10.0 FOR i IN range(11)])) AS edges FROM l WHERE model = 'main') " + _WILSON.format(bin="CAST(greatest(0, len(list_filter(edges, lambda x: x < p)) - 1) AS INT)", rows="l, e WHERE model = 'main'"))
def _(spark, d):
    return rounded(M.reliability_wilson(_long(spark, d).where("model = 'main'"), [], quantile=True))


@query("m19_m20_model_deltas", _L + _AUC + _AP + ", s AS (SELECT model, sum(-w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w) AS log_loss, sum(w * (p - y) * (p - y)) / sum(w) AS brier FROM l GROUP BY 1), a AS (SELECT * FROM s JOIN auc USING (model) JOIN ap USING (model)) SELECT x.model, round(x.log_loss - r.log_loss, 9) AS log_loss_delta, round(x.brier - r.brier, 9) AS brier_delta, round(x.auc - r.auc, 9) AS auc_delta, round(x.average_precision - r.average_precision, 9) AS average_precision_delta FROM a x, a r WHERE r.model = 'main' AND x.model <> 'main'")
def _(spark, d):
    return rounded(M.deltas(M.all_metrics(_long(spark, d), ["model"]), "model", "main", [], ["log_loss", "brier", "auc", "average_precision"]))


@query("m26_tail_calibration", f"WITH {PASSES}, e AS (SELECT f, quantile_cont(p, 1 - f) AS edge FROM pv, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(f) GROUP BY f)".replace("quantile_cont(p, 1 - f)", "CASE f WHEN 0.05 THEN quantile_cont(p, 0.95) WHEN 0.1 THEN quantile_cont(p, 0.9) ELSE quantile_cont(p, 0.8) END") + ", r AS (SELECT f, won, p, p_other FROM pv, e WHERE p >= edge) SELECT f AS fraction, model, count(*) AS n, round(avg(q), 9) AS mean_p, round(avg(won), 9) AS observed, round(avg(q) - avg(won), 9) AS gap FROM (SELECT f, won, 'main' AS model, p AS q FROM r UNION ALL SELECT f, won, 'other', p_other FROM r) GROUP BY 1, 2")
def _(spark, d):
    return rounded(M.tail_calibration(passes(spark, d), "p", {"main": "p", "other": "p_other"}, y="won"))
