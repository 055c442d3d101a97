"""Queries of windows: labels, ranks, bins, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import checks as C
from veldt.operators import models
from veldt.operators import windows as W
from veldt.plans.frames import EVENTS, PASSES, events, passes, rounded, table
from veldt.plans.registry import query


@query("w1_w2_forward_label_and_stage", ", ".join(["SELECT event_id, row_number() OVER w AS stage"] + [f"max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) AS h{h}" for h in (1, 3, 5)]) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    hit, order = (F.col("event_type") == "purchase").cast("int"), ["ts", "event_id"]
    return events(spark, d).select("event_id", W.stage(["user_id"], order).cast("bigint").alias("stage"), *(W.forward_label(hit, ["user_id"], order, h).alias(f"h{h}") for h in (1, 3, 5)))


@query("w3_w4_ranks", f"WITH {EVENTS}, g AS (SELECT event_type, user_id, CASE WHEN user_id % 10 <> 0 THEN sum(k) END AS v FROM ev GROUP BY 1, 2) SELECT event_type, user_id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY event_type ORDER BY v DESC NULLS LAST) END AS min_rank, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY event_type ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0::DOUBLE END AS average_rank FROM g")
def _(spark, d):
    g = events(spark, d).groupBy("event_type", "user_id").agg(F.sum("k").alias("s"))
    g = g.withColumn("v", F.when(F.col("user_id") % 10 != 0, F.col("s")))
    return g.select("event_type", "user_id", W.min_rank("v", ["event_type"]).cast("bigint").alias("min_rank"), W.average_rank("v", ["event_type"]).alias("average_rank"))


@query("w5_ordinal_bands", "SELECT o_orderkey, CAST(greatest(0, least(7, floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) / (count(*) OVER (PARTITION BY o_orderpriority))::DOUBLE - 1e-12) * 8))) AS INT) AS band FROM orders")
def _(spark, d):
    o = W.positions(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return o.select("o_orderkey", W.ordinal_band(8).alias("band"))


_SPLIT = """WITH h AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('20260723|' || o_orderkey)) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
c AS (SELECT DISTINCT o_orderpriority, n, floor(n * 0.7 + 1e-9) AS a, floor(n * 0.1 + 1e-9) AS b, round(n * 0.7 - floor(n * 0.7 + 1e-9), 9) AS ra, round(n * 0.1 - floor(n * 0.1 + 1e-9), 9) AS rb FROM h),
q AS (SELECT *, n - a - 3 * b AS over FROM c),
s AS (SELECT *, a + CAST((CASE WHEN rb > ra THEN 3 ELSE 0 END) < over AS INT) AS train, b + CAST((CASE WHEN ra >= rb THEN 1 ELSE 0 END) < over AS INT) AS tune, b + CAST((CASE WHEN ra >= rb THEN 1 ELSE 0 END) + 1 < over AS INT) AS cal FROM q)
SELECT o_orderkey, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + tune THEN 'tune' WHEN rn <= train + tune + cal THEN 'calibrate' ELSE 'test' END AS split FROM h JOIN s USING (o_orderpriority)"""


@query("w6_stratified_split", _SPLIT)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("h", S.stable_hash(20260723, F.col("o_orderkey")))
    return W.stratified_split(o, ["o_orderpriority"], "h", {"train": 0.7, "tune": 0.1, "calibrate": 0.1, "test": 0.1}).select("o_orderkey", "split")


@query("w7_w8_folds_and_calibration", "WITH h AS (SELECT o_orderkey, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY sha256('20260723|' || o_orderkey))) SELECT o_orderkey, CAST((rn - 1) % 5 AS INT) AS fold, CASE WHEN n >= 2 THEN rn <= least(n - 1, greatest(1, round_even(n * 0.125, 0))) ELSE FALSE END AS calibration FROM h")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("h", S.stable_hash(20260723, F.col("o_orderkey")))
    return W.positions(o, ["o_orderpriority"], ["h"]).select("o_orderkey", W.round_robin(5).alias("fold"), W.calibration_pick(0.125).alias("calibration"))


@query("w7_c7_fold_roles", "SELECT CAST(f AS INT) AS outer_fold, CASE WHEN f = own THEN 'holdout' ELSE 'other' END AS role, count(*) AS n FROM (SELECT (row_number() OVER (PARTITION BY p ORDER BY sha256('20260723|' || c)) - 1) % 5 AS own FROM (SELECT c_custkey AS c, c_nationkey AS p FROM customer)), range(5) t(f) GROUP BY ALL")
def _(spark, d):
    roles = models.fold_roles(table(spark, d, "customer"), "c_custkey", ["c_nationkey"], 5)
    bad = C.one_role_per_fold(roles, "outer_fold", "c_custkey", "role", "holdout").where("repeated_roles + not_held_out_once > 0")
    return roles.join(bad, F.lit(True), "left_anti").groupBy("outer_fold", F.when(F.col("role") == "holdout", "holdout").otherwise("other").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("w9_dominant_category", "WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM g) SELECT user_id, CASE WHEN share >= 0.25 THEN event_type ELSE 'Mixed role' END AS event_type, n, round(share, 9) AS share FROM r WHERE rn = 1")
def _(spark, d):
    return rounded(W.dominant(events(spark, d), ["user_id"], "event_type", 0.25))


@query("w10_quantile_bins", f"WITH {EVENTS}, q AS (SELECT list_distinct(quantile_cont(k, [i / 20.0 FOR i IN range(21)])) AS edges FROM ev) SELECT event_id, CAST(greatest(0, len(list_filter(edges, lambda x: x < k)) - 1) AS INT) AS bin FROM ev, q")
def _(spark, d):
    return W.quantile_bins(events(spark, d), "k", 20).select("event_id", "bin")


@query("w11_w12_fixed_bins", f"WITH {PASSES} SELECT event_id, CAST(greatest(0, least(19, ceil(round(p * 20, 9)) - 1)) AS INT) AS right_bin, CAST(least(19, floor(round(p * 20, 9))) AS INT) AS left_bin FROM pv")
def _(spark, d):
    return passes(spark, d).select("event_id", W.right_closed_bin(F.col("p"), 20).alias("right_bin"), W.left_closed_bin(F.col("p"), 20).alias("left_bin"))


@query("w13_permutation", "WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), b AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY sha256('7|' || event_id), event_id) AS rn FROM events) SELECT a.event_id, b.value, b.event_type FROM a JOIN b USING (user_id, rn)")
def _(spark, d):
    return W.permuted(events(spark, d), ["user_id"], "event_id", ["value", "event_type"], 7).select("event_id", "value", "event_type")


@query("w14_zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 9) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def _(spark, d):
    from pyspark.sql.window import Window

    from veldt.operators.relational import zscore

    return rounded(table(spark, d, "customer").select("c_custkey", zscore("c_acctbal", Window.partitionBy("c_nationkey")).alias("z")))
