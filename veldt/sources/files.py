"""Inventories and hash manifests of folders of files, from listings and bounded reads in tasks.

The driver lists the top of a folder, tasks list the folders below, and no content is loaded, so files of any
size and number are listed, empty ones too. Tasks then open files themselves: an inventory reads their
first bytes, a manifest streams them in chunks. Paths are those of the root's file system.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators import windows
from veldt.session import ship

HEAD = 4096  # bytes that tell a file's kind
CHUNK = 4 << 20  # bytes of a file that are hashed at once
KINDS = ("json list", "json events", "json object", "parquet", "table", "empty", "other", "unreadable")


def system_of(root: str):
    """(file system, path in it) of a folder or a file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of all files below a folder, without their content; names that begin with ``_`` or ``.`` are no data."""
    from pyarrow import fs

    def below(system, path: str, deep: bool) -> list:
        return system.get_file_info(fs.FileSelector(path, recursive=deep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = system_of(root)[0]
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(path, size)] if size is not None else [(x.path, x.size) for x in below(system, path, True) if x.type == fs.FileType.File]
                found = [x for x in found if x[0].rsplit("/", 1)[-1][0] not in "._"]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["path", "bytes"])

    ship(spark)
    system, top = system_of(root)
    rows = [(x.path, x.size if x.type == fs.FileType.File else None) for x in below(system, top, False)]
    parts = max(1, min(len(rows), 1000))
    return spark.createDataFrame(rows, "path string, bytes bigint").repartition(parts).mapInArrow(run, "path string, bytes bigint")


def _spread(files: DataFrame) -> DataFrame:
    """Files dealt over as many tasks as there are shuffle partitions."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def kind_of(head: bytes) -> tuple[str, bool]:
    """(kind, whether it is compressed) of a file, from its first bytes."""
    packed = head[:2] == b"\x1f\x8b"
    if packed:
        head = zlib.decompressobj(31).decompress(head, HEAD)
    if not head:
        return "empty", packed
    if head[:4] == b"PAR1":
        return "parquet", packed
    text = head.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    if text[:1] == "[":
        return "json list", packed
    if text[:1] == "{":
        return "json events" if '"events"' in text else "json object", packed
    return ("table" if "," in text.split("\n", 1)[0] else "other"), packed


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, extension, kind, compressed, match_id, error) of each file below a folder.

    A kind is told by the first bytes, of packed files by the first of what they hold. A file that can not be
    opened or unpacked has the kind ``unreadable`` and the reason. The match is the last number in the name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = system_of(path)[0]
        for batch in batches:
            rows = []
            for own in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(own, compression=None) as f:
                        rows.append((*kind_of(f.read(HEAD)), None))
                except Exception as e:  # one broken file is a row of the inventory, not the end of it
                    rows.append(("unreadable", False, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.string())))], ["path", "bytes", "kind", "compressed", "error"])

    ship(spark)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    found = _spread(listing(spark, path)).mapInArrow(run, "path string, bytes bigint, kind string, compressed boolean, error string")
    extension = F.regexp_extract(name, r"((\.(json|csv))?\.[a-z0-9]+)$", 1)
    number = F.regexp_extract(F.regexp_replace(name, r"\.[a-z0-9.]+$", ""), "([0-9]+)[^0-9]*$", 1)
    return found.select("path", "bytes", extension.alias("extension"), "kind", "compressed", F.when(number != "", number).alias("match_id"), "error")


def summary(files: DataFrame) -> DataFrame:
    """(extension, kind, files, bytes, matches) of an inventory."""
    return files.groupBy("extension", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("match_id").alias("matches"))


def diagnosis(files: DataFrame, expected: DataFrame, match: str = "match_id") -> DataFrame:
    """(match_id, state, files): each expected or found match as ok, missing, repeated, unreadable or unexpected."""
    good = F.count_if(~F.col("kind").isin("unreadable", "empty"))
    found = files.where(F.col("match_id").isNotNull()).groupBy("match_id").agg(F.count(F.lit(1)).alias("files"), good.alias("__good"))
    wanted = expected.select(F.col(match).cast("string").alias("match_id")).where(F.col("match_id").isNotNull()).distinct().withColumn("__wanted", F.lit(True))
    both = found.join(wanted, "match_id", "full")
    state = F.when(F.col("files").isNull(), "missing").when(F.col("__wanted").isNull(), "unexpected").when(F.col("__good") == 0, "unreadable").when(F.col("files") > 1, "repeated").otherwise("ok")
    return both.select("match_id", state.alias("state"), F.coalesce("files", F.lit(0)).alias("files"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, streamed in chunks, so of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = system_of(path)[0]
        for batch in batches:
            for i, own in enumerate(batch.column(0).to_pylist()):
                digest = hashlib.sha256()
                with system.open_input_stream(own, compression=None) as f:
                    while part := f.read(CHUNK):
                        digest.update(part)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([digest.hexdigest()])], ["path", "bytes", "sha256"])

    ship(spark)
    return _spread(listing(spark, path)).mapInArrow(run, "path string, bytes bigint, sha256 string")


def relative(files: DataFrame, root: str) -> DataFrame:
    """Paths below ``root`` instead of whole ones, so that a manifest holds for a copy of the folder."""
    top = system_of(root)[1].rstrip("/") + "/"
    return files.withColumn("path", F.when(F.col("path").startswith(top), F.substring("path", len(top) + 1, 1 << 30)).otherwise(F.col("path")))


def write_manifest(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """The hashes as a table, one row a file, which ``verify`` compares."""
    files.select("path", "bytes", "sha256").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def verify(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state) of every file that is not as the manifest has it: changed, lost or new."""
    old = manifest.select("path", F.col("bytes").alias("__b"), F.col("sha256").alias("__h"), F.lit(True).alias("__old"))
    both = windows.matched(now.select("path", "bytes", "sha256", F.lit(True).alias("__new")), old, ["path"], "left").select("path", "bytes", "sha256", "__b", "__h", "__old")
    here = both.select("path", F.when(F.col("__old").isNull(), "new").when((F.col("bytes") != F.col("__b")) | (F.col("sha256") != F.col("__h")), "changed").alias("state"))
    lost = manifest.join(now.select("path"), "path", "left_anti").select("path", F.lit("lost").alias("state"))
    return here.where("state IS NOT NULL").unionByName(lost)
