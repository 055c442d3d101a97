"""Readers and writers: formats by suffix, header checks, selective scans, inventories, manifests."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.operators import checks
from veldt.operators.relational import checks_rows, small
from veldt.session import ship
from veldt.sources.files import system_of

REPORT_ROWS = 10_000  # audits and reports of more rows are an error

#: Texts that count as missing in delimited input.
MISSING = ("", "NA", "N/A", "NaN", "nan", "None", "null", "NULL", "<NA>", "#N/A", "n/a", "-nan", "-NaN", "1.#IND", "1.#QNAN", "#NA", "#N/A N/A", "-1.#IND", "-1.#QNAN")

# The flags and columns of a pass event.
FLAGS = ("under_pressure", "pass_cross", "pass_switch", "pass_through_ball", "pass_backheel", "pass_outswinging", "pass_inswinging", "pass_straight", "pass_cut_back", "pass_shot_assist", "pass_goal_assist", "pass_aerial_won", "pass_deflected", "pass_miscommunication", "pass_recovery")
PASS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "match_id", "competition_id", "season_id")]
    + [T.StructField(c, T.IntegerType()) for c in ("index", "possession", "minute", "second", "period")]
    + [T.StructField(c, T.StringType()) for c in ("team", "player", "position", "possession_team", "pass_recipient", "location", "pass_end_location")]
    + [T.StructField(c, T.DoubleType()) for c in ("pass_length", "pass_angle")]
    + [T.StructField(c, T.StringType()) for c in ("pass_height", "pass_body_part", "pass_type", "pass_technique", "play_pattern", "pass_outcome", *FLAGS, "related_events", "competition_name", "season_name")]
    + [T.StructField("match_date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in ("home_team", "away_team")]
    + [T.StructField(c, T.IntegerType()) for c in ("home_score", "away_score")]
)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, ORC, JSON (one value or lines, also compressed) or CSV, by the path's suffix."""
    name = path.lower().removesuffix(".gz")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if name.endswith((".parquet", ".orc")):
        return reader.format(name.rsplit(".", 1)[1]).load(path)
    if name.endswith((".jsonl", ".ndjson")):
        return reader.json(path)
    if name.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    return clean_missing(reader.option("header", True).option("encoding", "UTF-8").csv(path))


def clean_missing(df: DataFrame, tokens: Iterable[str] = MISSING) -> DataFrame:
    """Missing-value texts become null in every string column; a byte-order mark in the first header goes."""
    out = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿")) if df.columns else df
    return out.select(*(F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in out.dtypes))


def scan(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """Check the header, then project and filter; both reach the file scan."""
    out = checks.require_columns(df, *columns)
    return (out if where is None else out.where(where)).select(*columns)


def scan_by_role(df: DataFrame, columns: list[str], roles: DataFrame, match: str, allowed: list[str], flag: str | None = None, seed: int | None = None) -> DataFrame:
    """Rows of matches with an allowed role; a match without any role is an error; optional hashed order."""
    out = scan(df, columns).join(small(checks.require_unique(roles, match)), match, "left")
    known = F.when(F.col("role").isNotNull(), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("no role for match "), F.col(match).cast("string"))).cast("string"))
    out = out.withColumn("role", known).where(F.col("role").isin(*allowed))
    out = out.where(F.col(flag)) if flag else out
    return out if seed is None else out.orderBy(F.rand(seed))


def with_total(df: DataFrame, value: str, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The rows, and an observation of sum and count over all of them, in one pass."""
    seen = Observation(name)
    return df.observe(seen, F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")), seen


def rows_of(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def not_yet(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not done, for resumed work."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def seasons(df: DataFrame, name: str = "season_name", since: int | None = None) -> DataFrame:
    """Competition-seasons with their start year, from a year on."""
    from veldt.functions.scalars import season_start

    out = df.withColumn("start_year", season_start(F.col(name)))
    return out if since is None else out.where(F.col("start_year") >= since)


def passes(events: DataFrame, matches: DataFrame, match: str = "match_id", kind: str = "type", wanted: str = "Pass") -> DataFrame:
    """Events of one kind with their match's columns, in the fixed projection."""
    from veldt.operators.relational import fill_columns

    own = events.where(F.col(kind) == wanted).join(small(matches.dropDuplicates([match])), match)
    return fill_columns(own, {f.name: f.dataType.simpleString() for f in PASS_SCHEMA})


def match_metadata(matches: DataFrame, competition: int, season: int, competition_name: str = "", season_name: str = "") -> DataFrame:
    """Matches with their competition's ids and names; ``competition`` and ``season`` default to the names."""
    out = matches.withColumns({"competition_id": F.lit(competition).cast("bigint"), "season_id": F.lit(season).cast("bigint"), "competition_name": F.lit(competition_name), "season_name": F.lit(season_name)})
    missing = {c: F.col(f"{c}_name") for c in ("competition", "season") if c not in matches.columns}
    return out.withColumns(missing) if missing else out


def manifest(df: DataFrame, keys: list[str], required: list[str], repeated: str = "error") -> DataFrame:
    """A small table with required columns; repeated keys are an error, or the first stays."""
    checks.require_columns(df, *keys, *required)
    return df.dropDuplicates(keys) if repeated == "first" else checks.require_unique(df, *keys)


def with_retries(call: Callable[[], object], most: int = 5, base: float = 1.0, jitter: float = 0.8, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call again after errors, waiting base * 2^(n-1) plus a random part."""
    for n in range(1, most + 1):
        try:
            return call()
        except Exception:
            if n == most:
                raise
            sleep(base * 2 ** (n - 1) + random.uniform(0, jitter))


def write(df: DataFrame, path: str, overwrite: bool = False, append: bool = False, rows_per_file: int | None = None, order: list[str] | None = None) -> None:
    """Parquet, or CSV with a header, compressed if the path ends so; an existing target is an error.

    ``rows_per_file`` bounds the files' rows (S17). ``order`` makes one file in that order, for small
    results alone (S19).
    """
    out = df if order is None else df.orderBy(*order).coalesce(1)
    writer = out.write.mode("append" if append else "overwrite" if overwrite else "errorifexists")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    name = path.lower()
    if name.endswith((".csv", ".csv.gz")):
        writer.option("header", True).option("compression", "gzip" if name.endswith(".gz") else "none").csv(path)
    else:
        writer.parquet(path)


def write_files(df: DataFrame, root: str, name: str, body: str) -> None:
    """Write each row's text as a file of its own below a folder, from tasks; for tables that leave Spark as files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = system_of(root)
        system.create_dir(top, recursive=True)
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{top}/{file}", compression=None) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    ship(df.sparkSession)
    df.select(name, body).mapInArrow(run, "n bigint").agg(F.sum("n")).first()


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    """An error unless there are exactly so many rows."""
    if (n := df.count()) != expected:
        raise checks.IntegrityError(f"{n} rows, {expected} expected")
    return df


def audit_json(df: DataFrame, name: str) -> str:
    """A small audit table as JSON text; more rows than ``REPORT_ROWS`` are an error."""
    rows = [r.asDict(recursive=True) for r in checks_rows(df, REPORT_ROWS).collect()]
    return json.dumps({name: rows}, default=str, ensure_ascii=False, indent=2)


def save_model(model, path: str, spark: SparkSession, categories: dict[str, list[str]] | None = None, scale: dict[str, tuple[float, float]] | None = None) -> None:
    """A frozen linear model as one row of a table: coefficients, calibration line, category values and scaler."""
    row = (model.intercept, dict(model.weights), list(model.platt), dict(categories or {}), {k: list(v) for k, v in (scale or {}).items()})
    spark.createDataFrame([row], "intercept double, weights map<string,double>, platt array<double>, categories map<string,array<string>>, scale map<string,array<double>>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(path: str, spark: SparkSession, features: dict[str, Column]):
    """The saved model; ``features`` are its numeric columns as they are before scaling."""
    from veldt.operators.models import Linear, one_hot, scaled

    row = spark.read.parquet(path).first()
    own = {n: c for n, c in features.items() if n not in row["scale"]}
    own |= scaled({n: c for n, c in features.items() if n in row["scale"]}, row["scale"]) | one_hot(row["categories"])
    return Linear(row["intercept"], row["weights"], tuple(row["platt"]), own)


def report(df: DataFrame, template: str, columns: list[str], order: list[str]) -> str:
    """Sentences of a small result table; more rows than ``REPORT_ROWS`` are an error."""
    line = F.format_string(template, *columns)
    return "\n".join(r[0] for r in checks_rows(df, REPORT_ROWS).orderBy(*order).select(line).collect())
