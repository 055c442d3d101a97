"""Input frames of the queries: the driver's tables read as event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in their properties as ``k``."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def _cases(c: Column, n: int, names: list[str]) -> Column:
    out = F.when(c % n == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        out = out.when(c % n == i, name)
    return out


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as passes: a user is a match, and probability and threats are simple functions of ids."""
    e, i = events(spark, sf_dir), F.col("event_id")
    return e.select(
        "event_id", F.col("user_id").alias("match_id"), (F.col("user_id") % 3).alias("team"), (i % 40).alias("player"),
        _cases(i, 3, ["Ground Pass", "Low Pass", "High Pass"]).alias("height"),
        F.when(i % 4 == 0, "Under pressure").otherwise("Not under pressure").alias("pressure"),
        (0.05 + 0.009 * (i % 101)).alias("p"), (0.04 + 0.0091 * ((i * 7) % 101)).alias("p_other"),
        (F.col("event_type") != "error").cast("int").alias("won"),
        ((i % 50) / 500.0).alias("t_start"), ((i % 70) / 500.0).alias("t_end"), ((i % 30) / 1000.0).alias("t_opp"),
    )


PASSES = """pv AS (SELECT event_id, user_id AS match_id, user_id % 3 AS team, event_id % 40 AS player,
  CASE event_id % 3 WHEN 0 THEN 'Ground Pass' WHEN 1 THEN 'Low Pass' ELSE 'High Pass' END AS height,
  CASE WHEN event_id % 4 = 0 THEN 'Under pressure' ELSE 'Not under pressure' END AS pressure,
  0.05::DOUBLE + 0.009::DOUBLE * (event_id % 101) AS p, 0.04::DOUBLE + 0.0091::DOUBLE * ((event_id * 7) % 101) AS p_other,
  CAST(event_type <> 'error' AS INT) AS won,
  (event_id % 50) / 500.0::DOUBLE AS t_start, (event_id % 70) / 500.0::DOUBLE AS t_end, (event_id % 30) / 1000.0::DOUBLE AS t_opp FROM events)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes with their value decomposition in double precision."""
    from veldt.functions.scalars import pass_value

    v = pass_value(F.col("p"), F.col("t_start"), F.col("t_end"), F.col("t_opp"), F.col("won"), "double")
    return passes(spark, sf_dir).select("*", *(c.alias(k) for k, c in v.items()))


VALUES = (
    PASSES
    + """, va AS (SELECT *, t_end - t_start AS gain, t_start + t_opp AS cost, p * (t_end - t_start) AS expected_success_value,
  (1 - p) * (t_start + t_opp) AS expected_failure_cost, p * (t_end - t_start) - (1 - p) * (t_start + t_opp) AS expected_net_value,
  CASE WHEN won = 1 THEN t_end - t_start ELSE -(t_start + t_opp) END AS realized_value, won - p AS execution_residual FROM pv)"""
)


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Floating columns rounded, so that the order of sums does not show."""
    return df.select(*(F.round(F.col(c).cast("double"), places).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))
