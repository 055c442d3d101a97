"""Queries of joins, set operations, reshaping, ordering and group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import aggregates as A
from veldt.operators import checks as C
from veldt.operators import relational as R
from veldt.plans.frames import EVENTS, PASSES, VALUES, events, passes, rounded, table, values
from veldt.plans.registry import query


@query("j1_complete_one_to_one", "SELECT e.event_id, e.value, o.k FROM events e JOIN (SELECT event_id, event_id % 7 AS k FROM events) o USING (event_id)")
def _(spark, d):
    e = events(spark, d)
    other = e.select("event_id", (F.col("event_id") % 7).alias("k"))
    return C.joined(e.select("event_id", "value"), other, ["event_id"], validate="1:1", complete=True)


@query("j3_j5_sides", "SELECT COALESCE(a.o_custkey, b.c_custkey) AS custkey, CASE WHEN a.o_custkey IS NULL THEN 'right_only' WHEN b.c_custkey IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 0) a FULL OUTER JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) b ON a.o_custkey = b.c_custkey")
def _(spark, d):
    a = table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("custkey")).distinct()
    b = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("custkey"))
    return R.full_match(a, b, ["custkey"]).withColumnRenamed("_side", "side")


@query("j4_j8_lookup_with_default", "SELECT c_custkey, COALESCE(n_name, 'unknown') AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) n ON c_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return R.lookup_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"], {"name": "unknown"}).select("c_custkey", "name")


@query("j6_j15_group_back_to_rows", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS finished FROM orders")
def _(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey")
    done = F.sum((F.col("o_orderstatus") == "F").cast("int")).over(w)
    return rounded(table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / F.sum("o_totalprice").over(w)).alias("share"), done.alias("finished")))


@query("j7_compare_slices", "WITH g AS (SELECT o_orderstatus AS spec, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY ALL) SELECT g.spec, g.key, g.n, r.n AS n_reference FROM g JOIN g r ON g.key = r.key AND r.spec = 'F' WHERE g.spec <> 'F'")
def _(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("spec"), F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return R.compare_slices(g, "spec", "F", ["key"], ["n"])


@query("j9_theta_join", "SELECT s.tag, o_orderkey FROM orders JOIN (VALUES ('urgent', 'urgent', 2), ('low', 'low', 3)) s(tag, part, m) ON lower(o_orderpriority) LIKE '%' || part || '%' AND o_custkey % m = 0")
def _(spark, d):
    specs = spark.createDataFrame([("urgent", "urgent", 2), ("low", "low", 3)], "tag string, part string, m int")
    hit = F.lower("o_orderpriority").contains(F.col("part")) & (F.col("o_custkey") % F.col("m") == 0)
    return R.select_by_spec(table(spark, d, "orders"), specs, hit).select("tag", "o_orderkey")


@query("j10_pairs_within_group", """WITH g AS (SELECT s_suppkey, s_nationkey % 5 AS role, s_nationkey AS team, s_acctbal AS v, CAST(s_suppkey % 11 AS DOUBLE) AS u FROM supplier),
z AS (SELECT *, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS zv, (u - avg(u) OVER w) / stddev_pop(u) OVER w AS zu FROM g WINDOW w AS (PARTITION BY role))
SELECT l.role, l.s_suppkey AS left_key, r.s_suppkey AS right_key, round(sqrt((l.zv - r.zv) * (l.zv - r.zv) + (l.zu - r.zu) * (l.zu - r.zu)), 5) AS profile_distance, abs(l.v - r.v) <= 500 AS qualifies FROM z l JOIN z r ON l.role = r.role AND l.s_suppkey < r.s_suppkey AND l.team <> r.team""")
def _(spark, d):
    g = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("role"), F.col("s_nationkey").alias("team"), F.col("s_acctbal").alias("v"), (F.col("s_suppkey") % 11).cast("double").alias("u"))
    p = R.pairs_within(g, "role", "team", ["s_suppkey"], ["v", "u"])
    return rounded(p.select("role", F.col("left_s_suppkey").alias("left_key"), F.col("right_s_suppkey").alias("right_key"), "profile_distance", (F.abs(F.col("left_v") - F.col("right_v")) <= 500).alias("qualifies")), 5)


@query("j10_calipered_pairs", """WITH g AS (SELECT c_custkey, c_nationkey % 5 AS role, c_nationkey AS team, c_acctbal AS v, CAST(c_custkey % 97 AS DOUBLE) AS u, 1.0::DOUBLE + c_custkey % 50 AS n FROM customer),
z AS (SELECT *, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS zv, (u - avg(u) OVER w) / stddev_pop(u) OVER w AS zu, (n - avg(n) OVER w) / stddev_pop(n) OVER w AS zn FROM g WINDOW w AS (PARTITION BY role))
SELECT l.role, l.c_custkey AS left_key, r.c_custkey AS right_key, round(sqrt((l.zv - r.zv) * (l.zv - r.zv) + (l.zu - r.zu) * (l.zu - r.zu) + (l.zn - r.zn) * (l.zn - r.zn)), 6) AS profile_distance, round(l.v - r.v, 6) AS difference
FROM z l JOIN z r ON l.role = r.role AND l.c_custkey < r.c_custkey AND l.team <> r.team WHERE abs(l.v - r.v) <= 200 AND abs(l.u - r.u) <= 3 AND abs(l.n - r.n) / ((l.n + r.n) * 0.5) <= 0.2""")
def _(spark, d):
    key = F.col("c_custkey")
    g = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("role"), F.col("c_nationkey").alias("team"), F.col("c_acctbal").alias("v"), (key % 97).cast("double").alias("u"), (1.0 + key % 50).alias("n"))
    p = R.caliper_pairs(g, "role", "team", ["c_custkey"], ["v", "u", "n"], {"v": 200, "u": 3}, {"n": 0.2})
    return rounded(p.select("role", F.col("left_c_custkey").alias("left_key"), F.col("right_c_custkey").alias("right_key"), "profile_distance", (F.col("left_v") - F.col("right_v")).alias("difference")), 6)


@query("j11_u5_same_keys", "SELECT 0::BIGINT AS only_left, CAST(count(*) AS BIGINT) AS only_right FROM events WHERE event_id % 10 = 0")
def _(spark, d):
    e = events(spark, d).select("event_id")
    sides = R.full_match(e.where("event_id % 10 <> 0"), e, ["event_id"])
    return sides.agg(F.count_if(F.col("_side") == "left_only").alias("only_left"), F.count_if(F.col("_side") == "right_only").alias("only_right"))


@query("j14_fold_product", "SELECT o_custkey, CAST(f AS INT) AS fold FROM (SELECT DISTINCT o_custkey FROM orders), range(5) t(f)")
def _(spark, d):
    folds = spark.range(5).select(F.col("id").cast("int").alias("fold"))
    return table(spark, d, "orders").select("o_custkey").distinct().crossJoin(F.broadcast(folds))


@query("u1_u4_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT event_id, value FROM events UNION ALL SELECT event_id, NULL FROM events) UNION ALL SELECT 'except', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE value > 99) UNION ALL SELECT 'intersect', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE value > 99)")
def _(spark, d):
    e = events(spark, d)
    seen, high = e.where("event_type = 'view'").select("user_id"), e.where("value > 99").select("user_id")
    parts = {"union": R.union_all(e.select("event_id", "value"), e.select("event_id")), "except": seen.subtract(high), "intersect": seen.intersect(high)}
    return R.union_all(*(f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, f in parts.items()))


@query("u2_first_of_key", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return R.first_of(events(spark, d), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("r1_pivot", "SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, d):
    e = events(spark, d).where(F.col("event_type").isin("click", "view"))
    return R.wide_form(e, ["user_id"], "event_type", ["click", "view"], F.count(F.lit(1))).na.fill(0)


@query("r2_r5_melt_and_prefix", "SELECT o_orderkey, 'm_price' AS metric, round(o_totalprice, 4) AS value FROM orders UNION ALL SELECT o_orderkey, 'm_day', CAST(day(o_orderdate) AS DOUBLE) FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.day("o_orderdate").cast("double").alias("day"))
    return rounded(R.long_form(R.prefixed(o, "m_", ["price", "day"]), ["o_orderkey"], ["m_price", "m_day"]), 4)


@query("r3_r4_replicate_rows", "SELECT o_orderkey, CAST(r AS BIGINT) AS replicate, 'h3' AS tag FROM orders, range(3) t(r)")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("replicate"), F.lit("h3").alias("tag"))


@query("k1_k5_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def _(spark, d):
    return R.top_k(table(spark, d, "orders"), 3, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("k3_k4_k6_order_and_first", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 1")
def _(spark, d):
    return R.best_row(table(spark, d, "orders"), F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey")


@query("k5_top_list_overlap", "WITH a AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50), b AS (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 70) SELECT count(*) AS common, round(count(*) / 50.0::DOUBLE, 9) AS overlap FROM a JOIN b USING (c_custkey)")
def _(spark, d):
    c = table(spark, d, "customer")
    return rounded(R.top_k_overlap(c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(50), c.orderBy(F.desc("c_custkey")).limit(70), ["c_custkey"], 50))


@query("a1_counts", "SELECT count(*) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (value > 50) AS BIGINT) AS high FROM events")
def _(spark, d):
    return A.conditional_counts(events(spark, d), errors=F.col("event_type") == "error", high=F.col("value") > 50)


@query("a2_a3_match_statistics", f"WITH {VALUES} SELECT match_id, count(*) AS n, CAST(sum(won) AS DOUBLE) AS won, round(sum(expected_net_value), 9) AS expected_net_value FROM va GROUP BY 1")
def _(spark, d):
    return rounded(A.match_statistics(values(spark, d), ["match_id"], ["won", "expected_net_value"]))


@query("a4_a5_histograms", "SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '<NA>' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    return A.histogram(o, "o_orderpriority", "o_orderstatus")


@query("a6_success_table", "SELECT event_type, count(*) AS n, CAST(count(*) FILTER (value > 30) AS BIGINT) AS successes, CAST(count(*) FILTER (NOT value > 30) AS BIGINT) AS failures, round(count(*) FILTER (NOT value > 30) / count(*)::DOUBLE, 9) AS failure_rate FROM events GROUP BY 1")
def _(spark, d):
    return rounded(A.success_table(events(spark, d), ["event_type"], F.col("value") > 30))


@query("a7_missingness", "SELECT 'o_orderstatus' AS \"column\", CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_missing, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 9) AS share FROM orders UNION ALL SELECT 'o_orderkey', 0, 0.0 FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    return rounded(A.missingness(o, ["o_orderstatus", "o_orderkey"]))


_SUMS = ", ".join(f"round(sum({c}), 9) AS total_{c}, round(100 * sum({c}) / count(*), 9) AS {c}_per_100" for c in A.SUMMED)


@query("a8_a9_value_summary", f"WITH {VALUES} SELECT team, player, count(*) AS n_passes, count(DISTINCT match_id) AS n_matches, round(avg(won), 9) AS actual_completion_rate, round(avg(p), 9) AS mean_xpass, {_SUMS} FROM va GROUP BY 1, 2")
def _(spark, d):
    return rounded(A.value_summary(values(spark, d), ["team", "player"]))


@query("a11_a12_zero_filled", f"WITH {VALUES}, g AS (SELECT match_id, height, count(*) AS n, sum(expected_net_value) AS s FROM va GROUP BY 1, 2) SELECT m.match_id, h.height, COALESCE(n, 0) AS n, round(COALESCE(s, 0), 9) AS expected_net_value FROM (SELECT DISTINCT match_id FROM va) m CROSS JOIN (SELECT DISTINCT height FROM va) h LEFT JOIN g ON g.match_id = m.match_id AND g.height = h.height")
def _(spark, d):
    return rounded(A.zero_filled(values(spark, d), "match_id", "height", ["expected_net_value"]))


@query("a13_shares", f"WITH {PASSES} SELECT player, round(avg(CASE WHEN pressure = 'Under pressure' THEN 1 ELSE 0 END), 9) AS pressed, round(avg(CASE WHEN height = 'High Pass' THEN 1 ELSE 0 END), 9) AS high FROM pv GROUP BY 1")
def _(spark, d):
    return rounded(A.shares(passes(spark, d), ["player"], {"pressed": F.col("pressure") == "Under pressure", "high": F.col("height") == "High Pass"}))


@query("a14_describe", "SELECT event_type, count(value) AS n, round(avg(value), 9) AS mean, round(median(value), 9) AS median, round(stddev_samp(value), 9) AS sd, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.75), 9) AS p75, round(quantile_cont(value, 0.95), 9) AS p95, round(min(value), 9) AS min, round(max(value), 9) AS max FROM events GROUP BY 1")
def _(spark, d):
    return rounded(A.describe(events(spark, d), "value", ["event_type"]))


@query("a16_a17_null_keeping_groups", "SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    return rounded(o.groupBy("status").agg(F.count_distinct("o_custkey").alias("customers"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").cast("date").cast("string").alias("first_date"), F.max("o_orderdate").cast("date").cast("string").alias("last_date")), 2)


@query("a18_a19_ordered_values", "SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).select("user_id", "event_type").distinct().groupBy("user_id").agg(A.ordered_text("event_type", ["event_type"], "; ").alias("kinds"))


@query("a20_a23_extremes", "SELECT round(max(abs(o_totalprice - 100000)), 4) AS largest, CAST(bool_and(o_totalprice > 0) AS BOOLEAN) AS every, bool_or(o_totalprice > 400000) AS some, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 9) AS prevalence FROM orders")
def _(spark, d):
    v = F.col("o_totalprice")
    return rounded(table(spark, d, "orders").agg(A.largest_difference(v, F.lit(100000)).alias("largest"), F.every(v > 0).alias("every"), F.some(v > 400000).alias("some"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("prevalence")))


@query("a24_weighted_median", "WITH g AS (SELECT event_type, k, sum(w) AS w FROM (SELECT event_type, k, event_id % 9 AS w FROM ev) WHERE w > 0 GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY k) AS run, sum(w) OVER (PARTITION BY event_type) AS al FROM g) SELECT event_type, CAST(min(k) AS DOUBLE) AS weighted_median FROM r WHERE run >= al / 2 GROUP BY 1".replace("WITH g", f"WITH {EVENTS}, g", 1))
def _(spark, d):
    e = events(spark, d).select("event_type", F.col("k").cast("double").alias("k"), (F.col("event_id") % 9).alias("w"))
    return A.weighted_median(e, "k", "w", ["event_type"])


_RANKED = "WITH {e}, r AS (SELECT event_type, {x} AS x, {y} AS y, rank() OVER (PARTITION BY event_type ORDER BY {x}) + (count(*) OVER (PARTITION BY event_type, {x}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY event_type ORDER BY {y}) + (count(*) OVER (PARTITION BY event_type, {y}) - 1) / 2.0 AS ry FROM ev)"


@query("a25_spearman", _RANKED.format(e=EVENTS, x="k", y="event_id % 17") + " SELECT event_type, count(*) AS n, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY 1")
def _(spark, d):
    return rounded(A.spearman(events(spark, d).withColumn("y", F.col("event_id") % 17), "k", "y", ["event_type"]))


@query("a26_constant_per_group", "SELECT user_id, count(DISTINCT event_type) AS values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def _(spark, d):
    return A.constant_per(events(spark, d), ["user_id"], "event_type")


@query("a27_replicate_summary", "SELECT event_type, count(*) AS replicates, round(avg(value - 50), 9) AS mean, round(median(value - 50), 9) AS median, round(stddev_samp(value - 50), 9) AS sd, round(quantile_cont(value - 50, 0.025), 9) AS low, round(quantile_cont(value - 50, 0.975), 9) AS high, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 9) AS share_positive FROM events GROUP BY 1")
def _(spark, d):
    return rounded(A.replicate_summary(events(spark, d).withColumn("value", F.col("value") - 50), "value", ["event_type"]))


@query("c1_c2_key_checks", "SELECT 'lineitem' AS name, count(*) AS repeated FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'orders', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unmatched', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    parts = {"lineitem": C.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber"), "orders": C.duplicates(table(spark, d, "orders"), "o_orderkey"), "unmatched": C.unmatched(cust, table(spark, d, "orders"), "o_custkey")}
    return R.union_all(*(f.agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(k).alias("name"), "repeated") for k, f in parts.items()))


@query("c4_c6_value_checks", "SELECT CAST(count(*) FILTER (event_id % 9 = 0) AS BIGINT) AS nulls, CAST(count(*) FILTER (value >= 50) AS BIGINT) AS domain, CAST(count(*) FILTER (event_type NOT IN ('view', 'click')) AS BIGINT) AS enumerated FROM events")
def _(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return C.missing(e, "v").withColumnRenamed("v", "nulls").crossJoin(C.violations(e, domain=F.col("value") < 50, enumerated=F.col("event_type").isin("view", "click")))


@query("c8_totals", "SELECT 'n' AS name, max(event_id) - min(event_id) + 1.0::DOUBLE AS expected, CAST(count(*) AS DOUBLE) AS found, count(*) = max(event_id) - min(event_id) + 1 AS same FROM events UNION ALL SELECT 'users', (SELECT CAST(count(DISTINCT user_id % 7) AS DOUBLE) FROM events), CAST(count(DISTINCT user_id) AS DOUBLE), count(DISTINCT user_id) = (SELECT count(DISTINCT user_id % 7) FROM events) FROM events")
def _(spark, d):
    """Counts against what the ids promise, which holds, and against a coarser count, which does not."""
    e = events(spark, d)
    n, users = e.agg(F.max("event_id") - F.min("event_id") + 1, F.count_distinct(F.col("user_id") % 7)).first()
    return C.totals(e, n=(F.count(F.lit(1)), n), users=(F.count_distinct("user_id"), users))
