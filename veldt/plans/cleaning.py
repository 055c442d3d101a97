"""Queries of scalar functions, filters and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import relational as R
from veldt.plans.frames import EVENTS, PASSES, VALUES, events, passes, rounded, table, values
from veldt.plans.registry import query
from veldt.sources import tables


@query("p1_canonical_id", "SELECT o_orderkey, regexp_replace(trim(' ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END), '^(-?[0-9]+)\\.0$', '\\1') AS id, CAST(o_orderkey AS VARCHAR) || 'a.0' AS kept FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    raw = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))
    return o.select("o_orderkey", S.canonical_id(raw).alias("id"), S.canonical_id(F.concat(F.col("o_orderkey").cast("string"), F.lit("a.0"))).alias("kept"))


@query("p2_p5_canonical_text", "SELECT o_orderkey, trim(regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS category, regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '', 'g') AS bare, CASE WHEN o_orderstatus = 'F' THEN '<MISSING>' ELSE o_orderstatus END AS labelled, regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS digits FROM orders")
def _(spark, d):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", S.canonical_category(p).alias("category"), S.bare_key(p).alias("bare"), S.labelled_category(F.nullif(s, F.lit("F"))).alias("labelled"), S.digits(p).alias("digits"))


@query("p4_truth_sets", "SELECT event_id, event_type IN ('click', 'view') AS flag, event_type IN ('click', 'view', 'signup') AS wide FROM events")
def _(spark, d):
    word = F.when(F.col("event_type") == "click", " TRUE ").when(F.col("event_type") == "view", "1.0").when(F.col("event_type") == "signup", "Y").otherwise("no")
    return events(spark, d).select("event_id", S.truth(word, S.TRUE_FLAG).alias("flag"), S.truth(word).alias("wide"))


@query("p7_p9_points_and_clipping", f"WITH {EVENTS} SELECT event_id, value AS x, CAST(k AS DOUBLE) AS y, FALSE AS malformed, CASE WHEN value > 50 THEN 50.0::DOUBLE WHEN value < 1 THEN 1.0::DOUBLE ELSE value END AS x_clipped, value > 50 OR value < 1 AS x_out FROM ev WHERE k IS NOT NULL")
def _(spark, d):
    e = events(spark, d).where("k is not null")
    point = S.point_strict(F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "), F.col("k").cast("string"), F.lit(", 7]")))
    e = e.select("event_id", point.alias("q"))
    x = F.col("q.x")
    return e.select("event_id", "q.x", "q.y", "q.malformed", S.clip(x, 1.0, 50.0).alias("x_clipped"), S.out_of_range(x, 1.0, 50.0).alias("x_out"))


@query("p10_p11_open_play_and_target", "WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'throw in' WHEN 1 THEN 'free kick' ELSE '' END AS kind, CASE event_id % 4 WHEN 0 THEN 'from corner' WHEN 1 THEN 'regular play' ELSE 'from keeper' END AS play, event_type FROM events) SELECT event_id, kind NOT IN ('throw in', 'free kick') AS primary_open, kind NOT IN ('throw in', 'free kick') AND play <> 'from corner' AS strict_open, CASE WHEN kind <> '' THEN 'pass_type:' || kind ELSE '' END AS primary_reason, CASE WHEN kind <> '' THEN 'pass_type:' || kind WHEN play = 'from corner' THEN 'play_pattern:' || play ELSE '' END AS strict_reason, CAST(event_type = 'view' AS INT) AS success FROM t")
def _(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, " Throw-in ").when(i % 5 == 1, "Free_Kick")
    play = F.when(i % 4 == 0, "From Corner").when(i % 4 == 1, "Regular Play").otherwise("From Keeper")
    e = events(spark, d).select("event_id", S.open_play(kind, play).alias("o"), S.success(F.nullif(F.col("event_type"), F.lit("view"))).cast("int").alias("success"))
    return e.select("event_id", F.col("o.primary").alias("primary_open"), F.col("o.strict").alias("strict_open"), "o.primary_reason", "o.strict_reason", "success")


@query("p12_season_start", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS start_year FROM orders WHERE year(o_orderdate) >= 1995")
def _(spark, d):
    year = F.year("o_orderdate")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(year.cast("string"), F.lit("/"), (year + 1).cast("string"))).otherwise(year.cast("string"))
    return tables.seasons(table(spark, d, "orders").select("o_orderkey", name.alias("season_name")), since=1995).select("o_orderkey", "start_year")


@query("p14_p18_labels", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Ground Pass' WHEN 1 THEN 'Low Pass' WHEN 2 THEN 'High Pass' ELSE 'Unknown' END AS height, CASE s_suppkey % 3 WHEN 0 THEN 'Under pressure' ELSE 'Not under pressure' END AS pressure, CASE s_suppkey % 3 WHEN 0 THEN 'Forward' WHEN 1 THEN 'Central defender' ELSE 'Goalkeeper' END AS role, 'Ana Souza' AS short, s_suppkey % 2 = 0 AS alias FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    height = F.when(k % 4 == 0, "Ground Pass").when(k % 4 == 1, "low-pass").when(k % 4 == 2, "HIGH").otherwise("chip")
    flag = F.when(k % 3 == 0, "True").when(k % 3 == 1, "0")
    place = F.when(k % 3 == 0, "Left Center Forward").when(k % 3 == 1, "Center Back").otherwise("Goalkeeper")
    name = F.when(k % 2 == 0, "Ana Maria da Souza").otherwise("Ana Souza")
    team = F.when(k % 2 == 0, "AS Mona-co").otherwise("Other")
    return table(spark, d, "supplier").select("s_suppkey", S.pass_height(height).alias("height"), S.pressure(flag).alias("pressure"), S.role(place).alias("role"), S.short_name(name).alias("short"), S.matches_alias(team, ["as monaco"]).alias("alias"))


_GEO = {"f_start_x": "x / 120.0", "f_start_y": "y / 80.0", "f_end_x": "y / 120.0", "f_end_y": "x / 80.0", "f_dx": "(y - x) / 120.0", "f_dy": "(x - y) / 80.0", "f_length": "(x + y) / 120.0", "f_sin": "sin(x / 10)", "f_cos": "cos(x / 10)", "f_goal_start": "sqrt((120 - x) * (120 - x) + (40 - y) * (40 - y)) / sqrt(120.0::DOUBLE * 120 + 40 * 40)", "f_goal_end": "sqrt((120 - y) * (120 - y) + (40 - x) * (40 - x)) / sqrt(120.0::DOUBLE * 120 + 40 * 40)"}


@query("p19_pass_geometry", "WITH t AS (SELECT event_id, CAST(event_id % 80 AS DOUBLE) AS x, CAST(event_id % 75 AS DOUBLE) AS y FROM events) SELECT event_id, " + ", ".join(f"round({e}, 9) AS {n}" for n, e in _GEO.items()) + " FROM t")
def _(spark, d):
    x, y = (F.col("event_id") % 80).cast("double"), (F.col("event_id") % 75).cast("double")
    return rounded(events(spark, d).select("event_id", *(c.alias(k) for k, c in S.pass_geometry(x, y, y, x, x + y, x / 10).items())))


@query("p20_p22_state_features", "WITH t AS (SELECT event_id, (event_id % 120) / 119.0::DOUBLE AS x, (event_id % 80) / 79.0::DOUBLE AS y, event_id % 95 AS m, event_id % 60 AS s, event_id % 3 + 1 AS period, event_id % 130 + 1 AS stage FROM events), u AS (SELECT *, abs(y - 0.5) * 2 AS lat, least(1.5, (m + s / 60.0::DOUBLE) / 90) AS tm FROM t) SELECT event_id, round(x * x * x, 9) AS x3, round(lat * lat, 9) AS lateral2, round(x * (1 - lat), 9) AS x_central, round(sqrt((1 - x) * (1 - x) + ((y - 0.5) * 80 / 120) * ((y - 0.5) * 80 / 120)), 9) AS goal_distance, round(abs(atan2(0.5 + 7.32 / 160 - y, greatest(1 - x, 1e-5)) - atan2(0.5 - 7.32 / 160 - y, greatest(1 - x, 1e-5))), 9) AS goal_angle, round(tm, 9) AS time, CAST(period = 2 AS DOUBLE) AS second_half, CAST(period >= 3 AS DOUBLE) AS extra_time, round(ln(1 + least(stage, 100)) / ln(11.0::DOUBLE), 9) AS stage FROM u")
def _(spark, d):
    i = F.col("event_id")
    feats = S.state_features((i % 120) / 119.0, (i % 80) / 79.0, S.clock(i % 95, i % 60), i % 3 + 1, i % 130 + 1)
    names = ("x3", "lateral2", "x_central", "goal_distance", "goal_angle", "time", "second_half", "extra_time", "stage")
    return rounded(events(spark, d).select("event_id", *(feats[n].alias(n) for n in names)))


@query("p21_evaluation_points", "SELECT event_id, (event_id % 90) / 100.0::DOUBLE AS end_x, round(1 - (event_id % 90) / 100.0::DOUBLE, 9) AS opponent_x, round(1 - (event_id % 70) / 100.0::DOUBLE, 9) AS opponent_y, event_id % 9 + 2 AS end_stage, 1 AS opponent_stage FROM events")
def _(spark, d):
    i = F.col("event_id")
    pts = S.evaluation_points(F.lit(0.1), F.lit(0.2), (i % 90) / 100.0, (i % 70) / 100.0, i % 9 + 1)
    return rounded(events(spark, d).select("event_id", pts["end"][0].alias("end_x"), pts["opponent"][0].alias("opponent_x"), pts["opponent"][1].alias("opponent_y"), pts["end"][2].alias("end_stage"), pts["opponent"][2].alias("opponent_stage")))


@query("p23_logit_sigmoid", f"WITH {PASSES} SELECT event_id, round(ln(p / (1 - p)), 9) AS z, round(1 / (1 + exp(-least(35.0, greatest(-35.0, 60.0::DOUBLE * (p - 0.5))))), 9) AS s FROM pv")
def _(spark, d):
    return rounded(passes(spark, d).select("event_id", S.logit(F.col("p")).alias("z"), S.sigmoid(60.0 * (F.col("p") - 0.5)).alias("s")))


@query("p24_pass_value", f"WITH {VALUES} SELECT event_id, round(gain, 9) AS gain, round(cost, 9) AS cost, round(expected_success_value, 9) AS expected_success_value, round(expected_failure_cost, 9) AS expected_failure_cost, round(expected_net_value, 9) AS expected_net_value, round(realized_value, 9) AS realized_value, round(execution_residual, 9) AS execution_residual FROM va")
def _(spark, d):
    return rounded(values(spark, d).select("event_id", "gain", "cost", "expected_success_value", "expected_failure_cost", "expected_net_value", "realized_value", "execution_residual"))


@query("p26_p28_labels_of_values", f"WITH {VALUES}, g AS (SELECT team, player, count(*) AS n, 100 * sum(expected_net_value) / count(*) AS net, 100 * sum(execution_residual) / count(*) AS ex FROM va GROUP BY ALL) SELECT team, player, round(net, 9) AS net, round(ex, 9) AS ex, CASE WHEN net >= 0 THEN 'High decision value' ELSE 'Low decision value' END || ' / ' || CASE WHEN ex >= 0 THEN 'High execution' ELSE 'Low execution' END AS quadrant, CASE WHEN net - 1 > 0 THEN 'Above full-sample baseline' WHEN net + 1 < 0 THEN 'Below full-sample baseline' ELSE 'Includes full-sample baseline' END AS centred, CASE WHEN ex - 5 > 0 THEN 'Above xPass expectation' WHEN ex + 5 < 0 THEN 'Below xPass expectation' ELSE 'Includes zero' END AS execution FROM g")
def _(spark, d):
    g = values(spark, d).groupBy("team", "player").agg(F.count(F.lit(1)).alias("n"), F.sum("expected_net_value").alias("a"), F.sum("execution_residual").alias("b"))
    g = g.select("team", "player", S.per100(F.col("a"), F.col("n")).alias("net"), S.per100(F.col("b"), F.col("n")).alias("ex"))
    net, ex = F.col("net"), F.col("ex")
    return rounded(g.select("*", S.quadrant(net, ex).alias("quadrant"), S.centred_label(net - 1, net + 1).alias("centred"), S.execution_label(ex - 5, ex + 5).alias("execution")))


@query("p29_stability_class", "WITH t AS (SELECT s_suppkey, (s_suppkey % 11) / 10.0 AS d, (s_suppkey % 7) / 6.0 AS e, (s_suppkey % 5) / 4.0 AS q, s_suppkey % 2 = 0 AS o FROM supplier) SELECT s_suppkey, CASE WHEN d >= 0.8 AND e >= 0.8 AND q >= 0.7 AND o THEN 'Stable' WHEN d >= 0.8 AND e >= 0.8 AND o THEN 'Boundary-sensitive' WHEN NOT d >= 0.8 THEN 'Decision-sensitive' ELSE 'Mixed' END AS class FROM t")
def _(spark, d):
    k = F.col("s_suppkey")
    c = S.stability_class(F.lit(False), (k % 11) / 10.0, (k % 7) / 6.0, (k % 5) / 4.0, k % 2 == 0)
    return table(spark, d, "supplier").select("s_suppkey", c["class"].alias("class"))


@query("p32_p33_keys", "SELECT o_orderkey, sha256('20260723|' || o_orderkey) AS h, o_custkey || '|' || CASE WHEN o_orderstatus = 'F' THEN 'UNK' ELSE o_orderstatus END AS k FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.stable_hash(20260723, F.col("o_orderkey")).alias("h"), S.composite_key(F.col("o_custkey"), F.nullif(F.col("o_orderstatus"), F.lit("F"))).alias("k"))


@query("p34_centred_and_flags", f"WITH {VALUES} SELECT event_id, round(1 - p, 9) AS failure_risk, expected_net_value > 0 AS positive, round(expected_net_value - avg(expected_net_value) OVER (), 9) AS centred, CAST(sign(expected_net_value) AS INT) AS sign FROM va")
def _(spark, d):
    v = values(spark, d)
    mean = v.agg(F.avg("expected_net_value").alias("m"))
    net = F.col("expected_net_value")
    return rounded(v.crossJoin(F.broadcast(mean)).select("event_id", (1 - F.col("p")).alias("failure_risk"), (net > 0).alias("positive"), (net - F.col("m")).alias("centred"), F.signum(net).cast("int").alias("sign")))


@query("p35_p37_number_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE printf('%.2f', CAST(o_orderkey AS DOUBLE)) END AS number, printf('%.1f', CAST(o_orderkey % 100 AS DOUBLE)) || '%' AS share, abs(o_orderkey - o_custkey) AS apart FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.number_text(F.when(k % 5 != 0, k.cast("double")), 2).alias("number"), S.percent_text((k % 100) / 100.0).alias("share"), F.abs(k - F.col("o_custkey")).alias("apart"))


@query("f1_f4_simple_filters", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)")
def _(spark, d):
    e = events(spark, d)
    keys = e.where((F.col("event_type") == "signup") & (F.col("value") > 90))
    return tables.rows_of(e.where(F.col("event_type") == "purchase"), keys, ["user_id"]).select("event_id", "value")


@query("f3_exclusions", "SELECT o_orderkey, NOT (o_orderstatus = 'F' AND regexp_matches(lower(o_orderpriority), '^[12]-.*')) AS kept FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    kept, out = R.exclude(o, F.col("o_orderstatus") == "F", F.lower("o_orderpriority").rlike("^[12]-.*"), None)
    return kept.select("o_orderkey", F.lit(True).alias("kept")).unionByName(out.select("o_orderkey", F.lit(False).alias("kept")))


@query("f7_eligibility", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS m FROM orders WHERE o_custkey % 10 <> 0 GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT o_orderpriority) >= 3")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("m"))
    g = g.withColumn("name", F.when(F.col("o_custkey") % 10 == 0, "Unknown").otherwise("x"))
    return g.where(R.eligible(g, "n", "m", "name", 8, 3)).select("o_custkey", "n", "m")


@query("f8_tail", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)")
def _(spark, d):
    return R.tail(table(spark, d, "orders"), "o_totalprice", 0.1).select("o_orderkey")


@query("f9_f10_valid_rows", f"WITH {PASSES} SELECT event_id FROM pv WHERE event_id % 7 <> 0 AND height IN ('Ground Pass', 'High Pass')")
def _(spark, d):
    v = passes(spark, d).withColumn("p", F.when(F.col("event_id") % 7 != 0, F.col("p")).otherwise(F.lit(float("nan"))))
    return v.where(R.finite("p") & F.col("height").isin("Ground Pass", "High Pass")).select("event_id")


@query("s8_role_scan", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'test' ELSE 'train' END AS role FROM events WHERE user_id % 4 <> 1 AND event_type <> 'error'")
def _(spark, d):
    e = events(spark, d).withColumn("ok", F.col("event_type") != "error")
    m = F.col("user_id") % 4
    roles = e.select("user_id").distinct().select("user_id", F.when(m == 0, "test").when(m == 1, "other").otherwise("train").alias("role"))
    return tables.scan_by_role(e, ["event_id", "user_id", "ok"], roles, "user_id", ["train", "test"], "ok").select("event_id", "role")


@query("s5_s12_resume_and_select", "SELECT event_id FROM events WHERE user_id % 2 = 1 AND user_id % 3 = 0")
def _(spark, d):
    e = events(spark, d)
    return tables.rows_of(tables.not_yet(e, e.where("user_id % 2 = 0"), ["user_id"]), e.where("user_id % 3 = 0"), ["user_id"]).select("event_id")
