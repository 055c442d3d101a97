"""Shared helpers of the training-data operators: tables, shared storage, digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.session import ship

#: Random part of the folder names of one driver process.
_RUN = uuid.uuid4().hex[:12]
#: Paths that this process has handed out and not deleted.
_HELD: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where a session on one machine has none (as in tests) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="veldt-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``discard`` or ``release`` deletes what is written there."""
    path = f"{shared_dir(spark)}/veldt-{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    _HELD.append(path)
    return path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy survives lost executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def in_tasks(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` of a function of this package, which is sent to the workers first; for ``DataFrame.transform``.

    ``mapInArrow`` looks columns up by name, so tables with names that are no plain ones go with
    numbered names; functions take such columns by place.
    """
    ship(df.sparkSession)
    plain = len(set(df.columns)) == len(df.columns) and not any(x in c for c in df.columns for x in "`.")
    return (df if plain else df.toDF(*(f"c{i}" for i in range(len(df.columns))))).mapInArrow(function, schema)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _HELD.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them is written itself."""
    for df in tables:
        _delete(df.sparkSession, [df.written_to])


def held() -> list[str]:
    """The paths that are in use now."""
    return list(_HELD)


def release(spark: SparkSession, but: list[str] = ()) -> None:
    """Delete what this process wrote to the shared folder, except the paths ``but``; for when the results are stored."""
    _delete(spark, [p for p in _HELD if p not in but])


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names from ``stems`` that clash with no column of ``df``, whatever its extra columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)
