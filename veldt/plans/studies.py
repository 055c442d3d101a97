"""Queries of resampling, models, robustness, matching, and the flagship study."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import aggregates as A
from veldt.operators import models
from veldt.operators import relational as R
from veldt.operators import resample
from veldt.operators import robustness as B

from veldt.plans.frames import PASSES, VALUES, events, passes, rounded, table, values
from veldt.plans.measuring import _long
from veldt.plans.registry import query

REPLICATES, SEED = 1000, 20260723
REPEATS = 30  # of a permutation
_SUMS = "expected_success_value", "expected_failure_cost", "expected_net_value", "execution_residual"
_RATIOS = {f"{c}_per_100": (c, "n", 100.0) for c in _SUMS}


def _weights(source: str, replicates: int = REPLICATES) -> str:
    """CTEs of the hash-driven draws over the matches of ``source``."""
    return f"m AS (SELECT match_id, row_number() OVER (ORDER BY match_id) - 1 AS pos FROM (SELECT DISTINCT match_id FROM {source})), c AS (SELECT count(*) AS m FROM m), w AS (SELECT r AS replicate, match_id, count(*) AS weight FROM (SELECT r.r, CAST(('0x' || substr(sha256('{SEED}|' || r.r || '|' || j.j), 1, 8)) AS BIGINT) % c.m AS pos FROM range({replicates}) r(r), c, (SELECT unnest(range((SELECT m FROM c))) AS j) j) d JOIN m USING (pos) GROUP BY 1, 2)"


def _flagship_sql() -> str:
    point = ", ".join(f"100 * sum({c}) / sum(n) AS {c}" for c in _SUMS)
    reps = ", ".join(f"100 * sum(weight * {c}) / sum(weight * n) AS {c}" for c in _SUMS)
    bounds = ", ".join(f"quantile_cont({c}, 0.025) AS {c}_low, quantile_cont({c}, 0.975) AS {c}_high" for c in _SUMS)
    out = ", ".join(f"round(p.{c}, 9) AS {c}_per_100, round({c}_low, 9) AS {c}_per_100_low, round({c}_high, 9) AS {c}_per_100_high" for c in _SUMS)
    stats = ", ".join(f"sum({c}) AS {c}" for c in _SUMS)
    return f"WITH {VALUES}, s AS (SELECT match_id, team, count(*) AS n, {stats} FROM va GROUP BY 1, 2), {_weights('s')}, p AS (SELECT team, {point} FROM s GROUP BY 1), r AS (SELECT team, replicate, {reps} FROM s JOIN w USING (match_id) GROUP BY 1, 2), b AS (SELECT team, {bounds} FROM r GROUP BY 1) SELECT team, {out} FROM p JOIN b USING (team)"


@query("flagship_value_summary", _flagship_sql())
def _(spark, d):
    """Expected value per 100 passes of each team, with match-cluster intervals."""
    stats = A.match_statistics(values(spark, d), ["match_id", "team"], list(_SUMS))
    return rounded(resample.ratio_intervals(stats, "match_id", _RATIOS, REPLICATES, SEED, ["team"]))


@query("m21_bootstrap_weights", f"WITH {VALUES}, {_weights('va')} SELECT CAST(replicate AS BIGINT) AS replicate, match_id, weight FROM w")
def _(spark, d):
    return resample.bootstrap_weights(values(spark, d), "match_id", REPLICATES, SEED)


@query("m22_full_sample_interval", f"WITH {VALUES}, s AS (SELECT match_id, count(*) AS n, sum(expected_net_value) AS v FROM va GROUP BY 1), {_weights('s')}, r AS (SELECT replicate, 100 * sum(weight * v) / sum(weight * n) AS x FROM s JOIN w USING (match_id) GROUP BY 1) SELECT round((SELECT 100 * sum(v) / sum(n) FROM s), 9) AS net, round(quantile_cont(x, 0.025), 9) AS net_low, round(quantile_cont(x, 0.975), 9) AS net_high FROM r")
def _(spark, d):
    stats = A.match_statistics(values(spark, d), ["match_id"], ["expected_net_value"])
    return rounded(resample.ratio_intervals(stats, "match_id", {"net": ("expected_net_value", "n", 100.0)}, REPLICATES, SEED))


def _contrast(w: str) -> str:
    side = "100 * sum(CASE WHEN pressure = '{s}' THEN {w} * v END) / sum(CASE WHEN pressure = '{s}' THEN {w} * n END)"
    return f"{side.format(s='Under pressure', w=w)} - {side.format(s='Not under pressure', w=w)}"


@query("m23_contrast", f"WITH {VALUES}, s AS (SELECT match_id, pressure, count(*) AS n, sum(expected_net_value) AS v FROM va GROUP BY 1, 2), {_weights('s')}, r AS (SELECT replicate, {_contrast('weight')} AS d FROM s JOIN w USING (match_id) GROUP BY 1), b AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM r) SELECT round((SELECT {_contrast('1')} FROM s), 9) AS estimate, round(lo, 9) AS low, round(hi, 9) AS high, lo > 0 OR hi < 0 AS excludes_zero FROM b")
def _(spark, d):
    stats = A.match_statistics(values(spark, d), ["match_id", "pressure"], ["expected_net_value"])
    return rounded(resample.contrast_intervals(stats, "match_id", "pressure", "Under pressure", "Not under pressure", "expected_net_value", "n", REPLICATES, SEED))


_METRICS = ("auc", "average_precision", "log_loss", "brier")


def _metrics_sql(rows: str, by: str) -> str:
    """CTE ``me`` of the four metrics of rows (by, y, p, w)."""
    return f"""ce AS (SELECT {by}, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b FROM {rows} GROUP BY {by}, p),
ru AS (SELECT *, sum(b) OVER k - b AS below, sum(b) OVER k / sum(a + b) OVER k AS prec FROM ce WINDOW k AS (PARTITION BY {by} ORDER BY p)),
me AS (SELECT {by}, sum(a * (below + b / 2)) / nullif(sum(a) * sum(b), 0) AS auc, sum(prec * b) / nullif(sum(b), 0) AS average_precision, sum(-(a * ln(p) + b * ln(1 - p))) / sum(a + b) AS log_loss, sum(a * (1 - p) * (1 - p) + b * p * p) / sum(a + b) AS brier FROM ru GROUP BY {by})"""


_M24 = f"""WITH {PASSES}, l AS (SELECT 'main' AS model, match_id, won AS y, p FROM pv UNION ALL SELECT 'other', match_id, won, p_other FROM pv), {_weights('l')},
ro AS (SELECT replicate, model, y, p, CAST(weight AS DOUBLE) AS w FROM l JOIN w USING (match_id)), {_metrics_sql('ro', 'replicate, model')},
d AS (SELECT o.model AS comparator, unnest(['auc', 'average_precision', 'log_loss', 'brier']) AS metric, unnest([m.auc - o.auc, m.average_precision - o.average_precision, o.log_loss - m.log_loss, o.brier - m.brier]) AS v FROM me o JOIN me m USING (replicate) WHERE m.model = 'main' AND o.model <> 'main' AND m.auc IS NOT NULL AND o.auc IS NOT NULL)
SELECT comparator, metric, count(*) AS replicates, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(stddev_samp(v), 9) AS sd, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, round(avg(CASE WHEN v > 0 THEN 1 ELSE 0 END), 9) AS share_positive FROM d GROUP BY 1, 2"""


@query("m24_paired_model_bootstrap", _M24)
def _(spark, d):
    reps = resample.metric_replicates(_long(spark, d), "match_id", "model", REPLICATES, SEED)
    long = R.long_form(resample.paired_differences(reps, "main"), ["replicate", "comparator"], list(_METRICS))
    return rounded(A.replicate_summary(long, "value", ["comparator", "metric"]))


def _moved(group: str, columns: tuple[str, ...]) -> str:
    """Rows whose ``columns`` are dealt anew, for all repeats."""
    out = ", ".join(f"b.{c}" if c in columns else f"a.{c}" for c in ("p", "t_start", "t_end"))
    return f"SELECT '{group}' AS feature_group, a.repeat, a.won AS y, {out} FROM (SELECT *, row_number() OVER (PARTITION BY match_id, repeat ORDER BY event_id) AS rn FROM e) a JOIN (SELECT *, row_number() OVER (PARTITION BY match_id, repeat ORDER BY sha256(CAST({SEED} + repeat AS VARCHAR) || '|' || event_id), event_id) AS rn FROM e) b ON a.match_id = b.match_id AND a.repeat = b.repeat AND a.rn = b.rn"


_SCORE = "round(1 / (1 + exp(-(ln(p / (1 - p)) + 3 * (t_end - t_start)))), 9)"
_M25 = f"""WITH {PASSES}, e AS (SELECT pv.*, CAST(r AS INT) AS repeat FROM pv, range({REPEATS}) t(r)), mv AS ({_moved('probability', ('p',))} UNION ALL {_moved('threats', ('t_start', 't_end'))} UNION ALL SELECT 'none', 0, won, p, t_start, t_end FROM pv),
ro AS (SELECT feature_group, repeat, y, {_SCORE} AS p, 1.0::DOUBLE AS w FROM mv), {_metrics_sql('ro', 'feature_group, repeat')}
SELECT m.feature_group, m.repeat, round(m.log_loss - n.log_loss, 6) AS log_loss_delta, round(m.brier - n.brier, 6) AS brier_delta, round(m.auc - n.auc, 6) AS auc_delta, round(m.average_precision - n.average_precision, 6) AS average_precision_delta FROM me m, me n WHERE n.feature_group = 'none' AND m.feature_group <> 'none'"""


@query("m25_permutation_importance", _M25)
def _(spark, d):
    v = passes(spark, d).select("event_id", "match_id", "won", "p", "t_start", "t_end")

    def score():
        return F.round(S.sigmoid(S.logit(F.col("p")) + 3 * (F.col("t_end") - F.col("t_start"))), 9)

    return rounded(resample.permutation_importance(v, score, "match_id", "event_id", {"probability": ["p"], "threats": ["t_start", "t_end"]}, REPEATS, SEED, "won"), 6)


_WEIGHTS = {"x": 1.5, "y": -0.7, "cat=Ground Pass": 0.4, "cat=High Pass": -0.9}


@query("m1_m27_frozen_scoring", f"WITH {VALUES}, z AS (SELECT event_id, -0.2::DOUBLE + 1.5::DOUBLE * t_start - 0.7::DOUBLE * t_end + CASE height WHEN 'Ground Pass' THEN 0.4::DOUBLE WHEN 'High Pass' THEN -0.9::DOUBLE ELSE 0 END AS z FROM va) SELECT event_id, round(1 / (1 + exp(-(0.1 + 1.2 * z))), 9) AS p FROM z")
def _(spark, d):
    features = {"x": F.col("t_start"), "y": F.col("t_end")} | {k.replace("height", "cat"): c for k, c in models.one_hot({"height": ["Ground Pass", "High Pass"]}).items()}
    return rounded(passes(spark, d).select("event_id", models.Linear(-0.2, _WEIGHTS, (0.1, 1.2), features).probability().alias("p")))


def _features(train):
    v = {"p": F.col("p"), "t_start": F.col("t_start"), "t_end": F.col("t_end")}
    return models.standardised(train, v) | models.one_hot(models.freeze_categories(train, ["height", "pressure"]))


@query("m2_m7_cross_fitted_probability")
def _(spark, d):
    v = passes(spark, d)
    roles = models.fold_roles(v.select("match_id", "team"), "match_id", ["team"], 5)
    return rounded(models.cross_fit(v, roles, "match_id", "won", _features, ["event_id", "match_id"], 5, iterations=20), 6)


@query("m9_grouped_split", "SELECT DISTINCT user_id, CAST(('0x' || substr(sha256('7|' || user_id), 1, 8)) AS BIGINT) < CAST(floor(0.3 * 4294967296) AS BIGINT) AS held FROM events")
def _(spark, d):
    e = events(spark, d)
    return e.select("user_id", resample.grouped_split(e, "user_id", 0.3, 7).alias("held")).distinct()


def _players(spark, d):
    """Player values under three specifications."""
    v = values(spark, d)
    specs = [B.specification(v, n, p, "t_start", "t_end", "t_opp", "won", ["match_id", "team", "player"], sample, failure) for n, p, sample, failure in (("main", "p", None, None), ("other", "p_other", None, None), ("pressed", "p", F.col("pressure") == "Under pressure", "t_start"))]
    g = R.union_all(*specs).groupBy("specification", "player").agg(F.count(F.lit(1)).alias("n_passes"), (100 * F.avg("expected_net_value")).alias("net"), (100 * F.avg("execution_residual")).alias("ex"))
    return g.select("specification", "player", "n_passes", F.round("net", 9).alias("net"), F.round("ex", 9).alias("ex"))


_PLAYERS = f"{VALUES}, sp AS (SELECT 'main' AS specification, player, expected_net_value AS v, execution_residual AS x FROM va UNION ALL SELECT 'other', player, p_other * gain - (1 - p_other) * cost, won - p_other FROM va UNION ALL SELECT 'pressed', player, p * gain - (1 - p) * t_start, won - p FROM va WHERE pressure = 'Under pressure'), pl AS (SELECT specification, player, count(*) AS n_passes, round(100 * avg(v), 9) AS net, round(100 * avg(x), 9) AS ex FROM sp GROUP BY 1, 2)"


@query("p25_specifications", f"WITH {_PLAYERS} SELECT * FROM pl")
def _(spark, d):
    return _players(spark, d)


@query("m28_stability", f"""WITH {_PLAYERS}, b AS (SELECT a.specification, a.player, a.net, a.ex, r.net AS rn, r.ex AS rx FROM pl a JOIN pl r USING (player) WHERE r.specification = 'main' AND a.specification <> 'main'),
q AS (SELECT *, row_number() OVER (PARTITION BY specification ORDER BY net DESC, player) AS a1, row_number() OVER (PARTITION BY specification ORDER BY rn DESC, player) AS a2, row_number() OVER (PARTITION BY specification ORDER BY ex DESC, player) AS b1, row_number() OVER (PARTITION BY specification ORDER BY rx DESC, player) AS b2,
 rank() OVER (PARTITION BY specification ORDER BY net) + (count(*) OVER (PARTITION BY specification, net) - 1) / 2.0 AS d1, rank() OVER (PARTITION BY specification ORDER BY rn) + (count(*) OVER (PARTITION BY specification, rn) - 1) / 2.0 AS d2,
 rank() OVER (PARTITION BY specification ORDER BY ex) + (count(*) OVER (PARTITION BY specification, ex) - 1) / 2.0 AS e1, rank() OVER (PARTITION BY specification ORDER BY rx) + (count(*) OVER (PARTITION BY specification, rx) - 1) / 2.0 AS e2 FROM b)
SELECT specification, count(*) AS common_players, round(avg(CASE WHEN (net >= 0) = (rn >= 0) AND (ex >= 0) = (rx >= 0) THEN 1 ELSE 0 END), 9) AS quadrant_agreement, round(count(*) FILTER (a1 <= 10 AND a2 <= 10) / least(10, count(*))::DOUBLE, 9) AS decision_top_overlap, round(count(*) FILTER (b1 <= 10 AND b2 <= 10) / least(10, count(*))::DOUBLE, 9) AS execution_top_overlap, round(corr(d1, d2), 9) AS decision_spearman, round(corr(e1, e2), 9) AS execution_spearman FROM q GROUP BY 1""")
def _(spark, d):
    return rounded(B.compare_players(_players(spark, d), "specification", "main", ["player"], "net", "ex", 10))


_ABLE = "COALESCE(h.n_passes >= 60 AND w.n_passes >= 60, FALSE)"


@query("m29_oriented_pairs", f"WITH {_PLAYERS}, o AS (SELECT CASE WHEN l.net >= r.net THEN l.player ELSE r.player END AS high_player, CASE WHEN l.net >= r.net THEN r.player ELSE l.player END AS low_player FROM pl l JOIN pl r ON l.specification = 'main' AND r.specification = 'main' AND r.player = l.player + 1) SELECT s.specification, o.high_player, o.low_player, {_ABLE} AS estimable, CASE WHEN {_ABLE} THEN round(h.net - w.net, 9) END AS difference, CASE WHEN {_ABLE} THEN h.net > w.net END AS same_direction FROM o CROSS JOIN (SELECT DISTINCT specification FROM pl) s LEFT JOIN pl h ON h.specification = s.specification AND h.player = o.high_player LEFT JOIN pl w ON w.specification = s.specification AND w.player = o.low_player")
def _(spark, d):
    p = _players(spark, d).withColumn("eligible", F.col("n_passes") >= 60)
    pairs = p.where("specification = 'main'").select(F.col("player").alias("left_player"), (F.col("player") + 1).alias("right_player"))
    return rounded(B.oriented_pairs(pairs, p, "specification", "main", "net", "eligible"))


#: The metrics of a cohort's profile: what is summed, over what, and the scale.
_PROFILE = {
    "under_pressure_share": ("CASE WHEN pressure = 'Under pressure' THEN 1 ELSE 0 END", 1), "ground_pass_share": ("CASE WHEN height = 'Ground Pass' THEN 1 ELSE 0 END", 1), "high_pass_share": ("CASE WHEN height = 'High Pass' THEN 1 ELSE 0 END", 1),
    "mean_xpass": ("p", 1), "execution_residual": ("execution_residual", 1), "expected_success_value_per100": ("expected_success_value", 100), "expected_failure_cost_per100": ("expected_failure_cost", 100), "centered_expected_net_value_per100": ("expected_net_value - centre", 100),
}


def _profile_sql() -> str:
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS a{i}" for i, (c, _) in enumerate(_PROFILE.values()))
    each = [f"SELECT cohort, '{m}' AS metric, {k} * {{0}}sum({{1}}a{i}) / sum({{1}}n) AS v" for i, (m, (_, k)) in enumerate(_PROFILE.items())]
    point = " UNION ALL ".join(x.format("", "") + " FROM g GROUP BY cohort" for x in each)
    reps = " UNION ALL ".join(x.format("", "weight * ") + " FROM g JOIN w USING (match_id) GROUP BY cohort, replicate" for x in each)
    return f"WITH {VALUES}, ce AS (SELECT avg(expected_net_value) AS centre FROM va), g AS (SELECT team AS cohort, match_id, {sums}, count(*) AS n FROM va, ce GROUP BY 1, 2), {_weights('g')}, po AS ({point}), re AS ({reps}), b AS (SELECT cohort, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM re GROUP BY 1, 2) SELECT cohort, metric, round(v, 9) AS estimate, round(lo, 9) AS low, round(hi, 9) AS high FROM po JOIN b USING (cohort, metric)"


@query("m30_core_profile", _profile_sql())
def _(spark, d):
    v = values(spark, d).withColumnRenamed("team", "cohort")
    v = v.crossJoin(F.broadcast(v.agg(F.avg("expected_net_value").alias("centre"))))
    return rounded(B.core_profile(v, "cohort", "match_id", {m: (F.expr(c), F.lit(1), k) for m, (c, k) in _PROFILE.items()}, REPLICATES, SEED))


@query("m31_correlations", f"WITH {_PLAYERS}, t AS (SELECT specification AS role, net, 'ex' AS variable, ex AS value FROM pl UNION ALL SELECT specification, net, 'n_passes', n_passes FROM pl), u AS (SELECT * FROM t UNION ALL SELECT 'All roles', net, variable, value FROM t), r AS (SELECT role, variable, value, net, rank() OVER (PARTITION BY role, variable ORDER BY value) + (count(*) OVER (PARTITION BY role, variable, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY role, variable ORDER BY net) + (count(*) OVER (PARTITION BY role, variable, net) - 1) / 2.0 AS b FROM u) SELECT role, variable, count(*) AS n, CASE WHEN count(DISTINCT value) > 1 THEN round(corr(a, b), 9) END AS spearman FROM r GROUP BY 1, 2")
def _(spark, d):
    p = _players(spark, d).select(F.col("specification").alias("role"), "net", "ex", F.col("n_passes").cast("double").alias("n_passes"))
    return rounded(B.correlations(p, "role", ["ex", "n_passes"], "net"))


@query("m32_identity_audit", f"WITH {VALUES}, t AS (SELECT count(*) AS n, sum(expected_net_value) AS v FROM va) SELECT 'n' AS name, CAST(n AS DOUBLE) AS total, TRUE AS ok FROM t UNION ALL SELECT 'expected_net_value', round(v, 6), TRUE FROM t UNION ALL SELECT 'wrong', CAST(n AS DOUBLE), FALSE FROM t")
def _(spark, d):
    """A summary by match against its rows: two columns that hold, one that is wrong in each match, and their totals."""
    v = values(spark, d)
    summary = A.match_statistics(v, ["match_id"], ["expected_net_value"]).withColumn("wrong", F.col("n"))
    found = B.identity_audit(v, summary, ["match_id"], {"n": F.count(F.lit(1)), "expected_net_value": F.sum("expected_net_value"), "wrong": F.count(F.lit(1)) + 1})
    sums = summary.agg(*(F.sum(c).cast("double").alias(c) for c in ("n", "expected_net_value", "wrong"))).unpivot([], ["n", "expected_net_value", "wrong"], "name", "total")
    return rounded(found.join(sums, "name").select("name", "total", "ok"), 6)


_K7 = """WITH RECURSIVE g AS (SELECT s_suppkey, s_nationkey % 5 AS role, s_nationkey AS team, s_acctbal AS v FROM supplier), z AS (SELECT *, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS zv FROM g WINDOW w AS (PARTITION BY role)),
p AS (SELECT l.role, l.s_suppkey AS a, r.s_suppkey AS b, abs(l.v - r.v) AS apart, row_number() OVER (ORDER BY abs(l.v - r.v) DESC, abs(l.zv - r.zv), l.s_suppkey, r.s_suppkey) AS rn FROM z l JOIN z r ON l.role = r.role AND l.s_suppkey < r.s_suppkey AND l.team <> r.team WHERE abs(l.v - r.v) <= 500),
t(rn, roles, parties, n) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), 0 UNION ALL SELECT * FROM (SELECT p.rn, list_append(t.roles, p.role), t.parties || [p.a, p.b], t.n + 1 FROM t JOIN p ON p.rn > t.rn AND NOT list_contains(t.roles, p.role) AND NOT list_contains(t.parties, p.a) AND NOT list_contains(t.parties, p.b) WHERE t.n < 3 ORDER BY p.rn LIMIT 1))
SELECT p.role, a AS left_s_suppkey, b AS right_s_suppkey, round(apart, 6) AS apart, CAST(n AS INT) AS selected_pair FROM t JOIN p USING (rn)"""


@query("k7_greedy_pairs", _K7)
def _(spark, d):
    g = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("role"), F.col("s_nationkey").alias("team"), F.col("s_acctbal").alias("v"))
    got = R.greedy_widest_pairs(g, "role", "team", ["s_suppkey"], ["v"], "v", 500, 3)
    return rounded(got.select("role", "left_s_suppkey", "right_s_suppkey", "apart", "selected_pair"), 6)


@query("w3_f12_eligible_ranks", f"WITH {_PLAYERS} SELECT specification, player, CASE WHEN n_passes >= 60 THEN rank() OVER (PARTITION BY specification ORDER BY CASE WHEN n_passes >= 60 THEN net END DESC NULLS LAST) END AS rank FROM pl")
def _(spark, d):
    p = B.ranked_eligible(_players(spark, d), "net", ["specification"], F.col("n_passes") >= 60, "rank")
    return p.select("specification", "player", F.col("rank").cast("bigint").alias("rank"))
