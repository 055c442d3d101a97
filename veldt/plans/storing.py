"""Queries that write the given tables in the library's formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import models
from veldt.plans.frames import PASSES, passes, rounded, table
from veldt.plans.registry import query
from veldt.session import scratch
from veldt.sources import files, matches, tables
from veldt.streaming import ingest

_EVENT = "match_id string, event_id bigint, event_type string, value double, props string"


def _staged(spark, d, packed: bool = False) -> str:
    root = scratch(spark, "staged")
    e = table(spark, d, "events").select("event_id", "event_type", "value", "props", F.col("user_id").alias("match_id"))
    matches.stage(e, root, "match_id", packed)
    return root


@query("s1_s3_staged_events", "SELECT CAST(user_id AS VARCHAR) AS match_id, event_id, round(value, 9) AS value, props FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    """Events staged as one JSON file a match, read back by the data source, which drops other kinds of events."""
    e = matches.read(spark, _staged(spark, d, True), _EVENT, {"event_type": "purchase"})
    return rounded(e.select("match_id", "event_id", "value", "props"))


@query("s2_match_status", "SELECT CAST(user_id AS VARCHAR) AS match_id, 'success' AS status, count(*) AS n_events FROM events GROUP BY 1")
def _(spark, d):
    """A row of status for each staged match."""
    return matches.read(spark, _staged(spark, d), report=True).select("match_id", "status", "n_events")


@query("s5_s16_resumed_ingest", "SELECT user_id AS match_id, count(*) AS n, round(sum(value), 6) AS total, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def _(spark, d):
    """Events staged in two halves, each stored by a run that resumes where the one before it ended."""
    root, e = scratch(spark, "ingest"), table(spark, d, "events").withColumnRenamed("user_id", "match_id")
    schema = e.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for half in (0, 1):
        e.where(F.col("match_id") % 2 == half).write.mode("append").parquet(f"{root}/in")
        ingest.ingest(ingest.staged(spark, f"{root}/in", schema), f"{root}/out", f"{root}/state", "match_id").awaitTermination()
    stored = spark.read.parquet(f"{root}/out")
    return rounded(stored.groupBy(F.col("match_id").cast("bigint").alias("match_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("event_id").alias("first"), F.max("event_id").alias("last")), 6)


_PAGE = "CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN page_id % 5 = 1 THEN 'json list' WHEN page_id % 5 = 2 THEN 'json events' WHEN page_id % 5 = 3 THEN 'table' ELSE 'other' END"


@query("s15_file_inventory", f"SELECT {_PAGE} AS kind, count(*) AS files, count(DISTINCT page_id) AS matches FROM pages GROUP BY 1")
def _(spark, d):
    """Pages written as files of several kinds, one each, and told apart by their first bytes."""
    root, i = scratch(spark, "pages"), F.col("page_id")
    text = F.when(i % 5 == 0, "").when(i % 5 == 1, F.to_json(F.array("url"))).when(i % 5 == 2, F.to_json(F.struct(F.array("url").alias("events")))).when(i % 5 == 3, F.concat(F.lit("a,b\n"), F.col("url"))).otherwise("# no known kind")
    tables.write_files(table(spark, d, "pages").select(F.format_string("page_%d.txt", i).alias("name"), text.alias("body")), root, "name", "body")
    return files.inventory(spark, root).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("match_id").alias("matches"))


@query("s24_hash_manifest", "SELECT 'page_' || page_id || '.html' AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256, 'ok' AS state FROM pages")
def _(spark, d):
    """Hashes of pages written as files, stored as a manifest and verified against a new listing."""
    root = scratch(spark, "hashed")
    tables.write_files(table(spark, d, "pages").select(F.format_string("page_%d.html", "page_id").alias("name"), "html"), f"{root}/data", "name", "html")
    files.write_manifest(files.relative(files.hashes(spark, f"{root}/data"), f"{root}/data"), f"{root}/manifest")
    held = spark.read.parquet(f"{root}/manifest")
    odd = files.verify(held, files.relative(files.hashes(spark, f"{root}/data"), f"{root}/data"))
    return held.join(odd, "path", "left").select("path", "bytes", "sha256", F.coalesce("state", F.lit("ok")).alias("state"))


_ORDERS = "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 6) AS o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))


@query("s16_s17_s25_written_csv", _ORDERS)
def _(spark, d):
    """Orders as packed CSV files of bounded rows, in two appended halves, read back with their missing values."""
    path, o = scratch(spark, "orders") + ".csv.gz", _orders(spark, d)
    tables.write(o.where("o_orderkey % 2 = 0"), path, rows_per_file=5000)
    tables.write(o.where("o_orderkey % 2 = 1"), path, append=True, rows_per_file=5000)
    back = tables.read(spark, path)
    return rounded(back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus"), 6)


@query("s18_s21_written_parquet", _ORDERS)
def _(spark, d):
    """Orders as Parquet, overwritten once, with their number of rows required."""
    path, o = scratch(spark, "orders") + ".parquet", _orders(spark, d)
    tables.write(o.limit(0), path)
    tables.write(o, path, overwrite=True)
    return rounded(tables.require_rows(tables.read(spark, path), o.count()), 6)


_SAVED = {"x": 1.5, "y": -0.7, "height=Ground Pass": 0.4, "height=High Pass": -0.9}


@query("s23_saved_model", f"WITH {PASSES} SELECT event_id, round(1 / (1 + exp(-(0.1 + 1.2 * (-0.2::DOUBLE + 1.5::DOUBLE * (t_start - 0.05) / 0.03 - 0.7::DOUBLE * t_end + CASE height WHEN 'Ground Pass' THEN 0.4::DOUBLE WHEN 'High Pass' THEN -0.9::DOUBLE ELSE 0 END)))), 9) AS p FROM pv")
def _(spark, d):
    """Probabilities of a model that was saved with its categories and scaler, and loaded again."""
    path = scratch(spark, "model")
    tables.save_model(models.Linear(-0.2, _SAVED, (0.1, 1.2)), path, spark, {"height": ["Ground Pass", "High Pass"]}, {"x": (0.05, 0.03)})
    model = tables.load_model(path, spark, {"x": F.col("t_start"), "y": F.col("t_end")})
    return rounded(passes(spark, d).select("event_id", model.probability().alias("p")))
