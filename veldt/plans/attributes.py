"""Queries of attributes, orders, projections, metadata, gates and metrics by subgroup."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import aggregates as A
from veldt.operators import checks as C
from veldt.operators import metrics as M
from veldt.operators import models
from veldt.operators import relational as R
from veldt.plans.frames import VALUES, events, passes, rounded, table, values
from veldt.plans.measuring import _L, _long
from veldt.plans.registry import query
from veldt.sources import tables


@query("a3_first_row_attributes", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(round(value, 6), (ts, event_id)) AS value FROM events GROUP BY 1")
def _(spark, d):
    return rounded(A.first_row(events(spark, d), ["user_id"], ["ts", "event_id"], ["event_type", "value"]), 6)


_BIN = "CAST(greatest(0, least(9, ceil(round(p * 10, 9)) - 1)) AS INT)"


@query("a12_match_by_bin", f"WITH {VALUES}, g AS (SELECT match_id, {_BIN} AS bin, count(*) AS n, sum(won) AS s FROM va GROUP BY 1, 2) SELECT m.match_id, b.bin, COALESCE(n, 0) AS n, CAST(COALESCE(s, 0) AS DOUBLE) AS won FROM (SELECT DISTINCT match_id FROM va) m CROSS JOIN (SELECT DISTINCT bin FROM g) b LEFT JOIN g ON g.match_id = m.match_id AND g.bin = b.bin")
def _(spark, d):
    from veldt.operators import windows

    v = values(spark, d).withColumn("bin", windows.right_closed_bin(F.col("p"), 10))
    return A.zero_filled(v, "match_id", "bin", ["won"])


@query("a4_most_common_first", "SELECT o_orderpriority, n, CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) AS INT) AS place FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    from pyspark.sql.window import Window

    return A.histogram(table(spark, d, "orders"), "o_orderpriority").withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "o_orderpriority")))


@query("k3_order_of_categories", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderstatus, o_orderkey LIMIT 25")
def _(spark, d):
    return R.by_rank(table(spark, d, "orders"), "o_orderstatus", ["P", "F"], F.col("o_orderkey")).select("o_orderkey", "o_orderstatus").limit(25)




@query("c9_audit_bundle", "SELECT count(DISTINCT event_id) = count(*) AS unique_ids, bool_and(value < 50) AS low_values, CASE WHEN count(DISTINCT event_id) < count(*) THEN 'FAIL' WHEN NOT bool_and(value < 50) THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status FROM events")
def _(spark, d):
    e = events(spark, d)
    found = e.agg((F.count_distinct("event_id") == F.count(F.lit(1))).alias("unique_ids"), F.every(F.col("value") < 50).alias("low_values")).first().asDict()
    status = C.audit(found, {"low_values"}).status
    return spark.createDataFrame([(*found.values(), status)], "unique_ids boolean, low_values boolean, status string")


@query("c8_declared_totals", "SELECT 'n' AS name, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS expected, CAST(count(*) AS DOUBLE) AS found, count(*) = (SELECT count(*) FROM orders) AS same FROM lineitem UNION ALL SELECT 'flags', 3.0, CAST(count(DISTINCT l_returnflag) AS DOUBLE), count(DISTINCT l_returnflag) = 3 FROM lineitem")
def _(spark, d):
    expected = table(spark, d, "orders").count()
    return C.totals(table(spark, d, "lineitem"), n=(F.count(F.lit(1)), expected), flags=(F.count_distinct("l_returnflag"), 3))


@query("m32_summary_against_events", f"WITH {VALUES}, s AS (SELECT match_id, sum(expected_net_value) + CASE WHEN match_id = 3 THEN 0.5 ELSE 0 END AS v, count(*) AS n FROM va GROUP BY 1), e AS (SELECT match_id, sum(expected_net_value) AS v, count(*) AS n FROM va GROUP BY 1) SELECT 'n' AS name, CAST(max(abs(s.n - e.n)) AS DOUBLE) AS apart, max(abs(s.n - e.n)) <= 1e-10 AS ok FROM s JOIN e USING (match_id) UNION ALL SELECT 'expected_net_value', round(max(abs(s.v - e.v)), 6), max(abs(s.v - e.v)) <= 1e-10 FROM s JOIN e USING (match_id)")
def _(spark, d):
    """A summary in which one match was tampered with."""
    from veldt.operators import robustness as B

    v = values(spark, d)
    summary = A.match_statistics(v, ["match_id"], ["expected_net_value"]).withColumn("expected_net_value", F.col("expected_net_value") + F.when(F.col("match_id") == 3, 0.5).otherwise(0.0))
    got = B.identity_audit(v, summary, ["match_id"], {"n": F.count(F.lit(1)), "expected_net_value": F.sum("expected_net_value")})
    return rounded(got.select("name", F.col("max_abs_difference").alias("apart"), "ok"), 6)


@query("p30_p31_projection_by_alias", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS DOUBLE) AS price, CAST(NULL AS DATE) AS day FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("price"))
    o = o.withColumnRenamed(R.find_column(o, ["id", "order_key"]), "id")
    return R.fill_columns(o, {"id": "string", "price": "double", "day": "date"})


@query("p38_match_metadata", "SELECT o_orderkey, 11::BIGINT AS competition_id, 90::BIGINT AS season_id, 'League' AS competition_name, '2020/2021' AS season_name, 'League' AS competition, o_orderpriority AS season FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("season"))
    return tables.match_metadata(o, 11, 90, "League", "2020/2021")


@query("f6_own_team", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')")
def _(spark, d):
    aliases = spark.createDataFrame([("F", "1 urgent"), ("F", "2_HIGH"), ("O", "5-Low"), ("X", "3-medium")], "cohort string, alias string")
    return R.own_team(table(spark, d, "orders"), aliases, "o_orderstatus", "o_orderpriority").select("o_orderkey")


@query("p4_strict_truth", "SELECT event_id, event_id % 4 IN (0, 1) AS strict, event_id % 4 IN (0, 1, 2) AS loose FROM events")
def _(spark, d):
    i = F.col("event_id") % 4
    word = F.when(i == 0, " TRUE ").when(i == 1, "1.0").when(i == 2, "yes").otherwise("no")
    return events(spark, d).select("event_id", S.truth(word, S.TRUE_FLAG).alias("strict"), S.truth(word, S.TRUE_FLOAT).alias("loose"))


@query("p19_pass_context", "SELECT event_id, round(CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 100 END / 130.0::DOUBLE, 9) AS f_minute, round((event_id % 60) / 60.0::DOUBLE, 9) AS f_second, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS f_cross FROM events")
def _(spark, d):
    i = F.col("event_id")
    flag = F.when(i % 3 == 0, "yes").when(i % 3 == 1, "0")
    got = S.pass_context(F.when(i % 6 != 0, i % 100), i % 60, {"cross": flag})
    return rounded(events(spark, d).select("event_id", *(c.alias(k) for k, c in got.items())))


@query("p20_all_state_features", """WITH s AS (SELECT event_id, ((event_id * 3) % 131) / 120.0::DOUBLE AS x0, ((event_id * 7) % 91) / 80.0::DOUBLE AS y0, (event_id % 150) / 90.0::DOUBLE AS t0, 1 + event_id % 4 AS period, event_id % 130 AS stage FROM events),
c AS (SELECT event_id, least(x0, 1) AS x, least(y0, 1) AS y, least(t0, 1.5) AS t, period, stage, abs(least(y0, 1) - 0.5) * 2 AS l FROM s)
SELECT event_id, round(x, 9) AS x, round(y, 9) AS y, round(x * x, 9) AS x2, round(x * x * x, 9) AS x3, round(l, 9) AS lateral, round(l * l, 9) AS lateral2, round(1 - l, 9) AS central, round(x * (1 - l), 9) AS x_central, round(sqrt((1 - x) * (1 - x) + pow((y - 0.5) * 80 / 120, 2)), 9) AS goal_distance,
 round(abs(atan2(0.5 + 7.32 / 160 - y, greatest(1 - x, 1e-5)) - atan2(0.5 - 7.32 / 160 - y, greatest(1 - x, 1e-5))), 9) AS goal_angle, round(t, 9) AS time, CASE WHEN period = 2 THEN 1.0::DOUBLE ELSE 0 END AS second_half, CASE WHEN period >= 3 THEN 1.0::DOUBLE ELSE 0 END AS extra_time, round(ln(1 + least(greatest(stage, 1), 100)::DOUBLE) / ln(11.0::DOUBLE), 9) AS stage FROM c""")
def _(spark, d):
    i = F.col("event_id")
    got = S.state_features(((i * 3) % 131) / 120.0, ((i * 7) % 91) / 80.0, (i % 150) / 90.0, 1 + i % 4, i % 130)
    return rounded(events(spark, d).select("event_id", *(c.alias(k) for k, c in got.items())))


@query("p28_quadrant_against_means", f"WITH {VALUES}, g AS (SELECT player, round(avg(expected_net_value), 9) AS d, round(avg(execution_residual), 9) AS e FROM va GROUP BY 1) SELECT player, (CASE WHEN d >= 0.001 THEN 'Above-average decision' ELSE 'Below-average decision' END) || ' / ' || (CASE WHEN e >= 0.3 THEN 'Above-expected execution' ELSE 'Below-expected execution' END) AS quadrant FROM g")
def _(spark, d):
    g = rounded(values(spark, d).groupBy("player").agg(F.avg("expected_net_value").alias("d"), F.avg("execution_residual").alias("e")))
    return g.select("player", S.quadrant(F.col("d"), F.col("e"), 0.001, 0.3, S.PROFILE_WORDS).alias("quadrant"))


_GROUP = "CASE WHEN match_id % 3 = 0 THEN 'male' WHEN match_id % 3 = 1 THEN 'female' END"
_SAME = "x.scope = {0}.scope AND x.model = {0}.model AND x.subgroup IS NOT DISTINCT FROM {0}.subgroup"
_SUB = _L + f""", g AS (SELECT *, 'subgroup' AS scope, {_GROUP} AS subgroup FROM l UNION ALL SELECT *, 'overall', NULL FROM l), x AS (SELECT scope, model, subgroup, sum(-w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w) AS log_loss, sum(w * (p - y) * (p - y)) / sum(w) AS brier, avg(CASE WHEN (p < 0.5) = (y = 0) THEN 1.0 ELSE 0 END) AS accuracy FROM g GROUP BY 1, 2, 3),
t AS (SELECT scope, model, subgroup, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b, sum(w) AS w FROM g GROUP BY 1, 2, 3, 4), u AS (SELECT *, sum(b) OVER k - b AS below, sum(b) OVER k / sum(w) OVER k AS prec FROM t WINDOW k AS (PARTITION BY scope, model, subgroup ORDER BY p)),
r AS (SELECT scope, model, subgroup, sum(a * (below + b / 2)) / (sum(a) * sum(b)) AS auc, sum(prec * b) / sum(b) AS average_precision FROM u GROUP BY 1, 2, 3),
e AS (SELECT scope, model, subgroup, sum(gap) / sum(w) AS ece FROM (SELECT scope, model, subgroup, greatest(0, least(19, ceil(round(p * 20, 9)) - 1)) AS bin, sum(w) AS w, abs(sum(w * p) - sum(w * y)) AS gap FROM g GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT x.scope, x.model, x.subgroup, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, round(accuracy, 9) AS accuracy, round(auc, 9) AS auc, round(average_precision, 9) AS average_precision, round(ece, 9) AS ece FROM x JOIN r ON {_SAME.format('r')} JOIN e ON {_SAME.format('e')}"""


@query("m19_metrics_by_subgroup", _SUB)
def _(spark, d):
    """All models over all rows and in every subgroup, those without one included, from one scan."""
    m = F.col("match_id") % 3
    got = M.metric_table(_long(spark, d).withColumn("subgroup", F.when(m == 0, "male").when(m == 1, "female")))
    return rounded(got.select("scope", "model", "subgroup", "log_loss", "brier", "accuracy", "auc", "average_precision", "ece"))
