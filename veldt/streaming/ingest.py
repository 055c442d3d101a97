"""A resumable sink of staged matches: files are read once each, and a match's rows are stored exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldt.sources.files import system_of


BATCH = "stored_batch"  # the partition column: the query and the number of the batch that stored a row


def store(target: str, match: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What a batch does: it writes a partition of its own and takes its matches out of those of other batches.

    A batch that is repeated after a failure writes the same partition again, so no row is there twice. A
    match that is staged anew replaces what it had: the partitions that hold it, and no others, are written
    anew without it. Partitions are as many as batches, not as matches.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        rows, emptied = batch.repartition(match).withColumn(BATCH, F.lit(name)), []
        if stored := _partitions(target):
            held = spark.read.parquet(target).where(F.col(BATCH) != name)
            keys = batch.select(F.col(match).alias("__match")).distinct()
            met = F.col(match).eqNullSafe(F.col("__match"))
            hit = [r[0] for r in held.join(keys, met, "left_semi").select(BATCH).distinct().collect()]
            if hit:
                rest = held.where(F.col(BATCH).isin(hit)).join(keys, met, "left_anti")
                left = {r[0] for r in rest.select(BATCH).distinct().collect()}
                rows, emptied = rows.unionByName(rest), [stored[h] for h in hit if h not in left]
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(target)
        for path in emptied:  # after the new rows are there; a repeated batch finds what is not deleted yet
            system_of(target)[0].delete_dir(path)
        if after:
            after(number)

    return run


def _partitions(target: str) -> dict[str, str]:
    """The folder of each stored batch."""
    from pyarrow import fs

    system, top = system_of(target)
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    names = {x.path.rsplit("/", 1)[-1]: x.path for x in found if x.type == fs.FileType.Directory}
    return {n.removeprefix(f"{BATCH}="): path for n, path in names.items() if n.startswith(f"{BATCH}=")}


def ingest(stream: DataFrame, target: str, checkpoint: str, match: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Store all files that are staged and not stored yet, then stop; the checkpoint remembers which are."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(store(target, match, after)).start()


def staged(spark: SparkSession, source: str, schema: str, most: int = 1000) -> DataFrame:
    """Parquet files below a folder as a stream, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).option("recursiveFileLookup", True).parquet(source)
