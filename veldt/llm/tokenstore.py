"""A bit-packed token-id store.

Ids are stored in the fewest bits that hold the vocabulary, little-endian, without gaps. The store
is a Parquet table of blocks, so that Spark writes and reads it in any file system. A block holds
whole documents in order and about ``BLOCK_IDS`` ids (one long document alone may exceed that):

    part, block       the place of a block: parts in ascending doc_id order, blocks from 0 in a part
    first_id          ids in the part before the block
    doc_ids, offsets  the block's documents, and where each starts in the block; one more offset ends it
    bits, n_ids       the width of an id, ids in the block
    payload           the packed ids

Because the width is fixed, id i of a block begins at bit i * bits: any range can be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt.llm.common import in_tasks

from veldt.llm import bytebpe

BLOCK_IDS = 1 << 18
BLOCKS = "part int, block int, first_id bigint, doc_ids array<bigint>, offsets array<bigint>, bits int, n_ids bigint, payload binary"


def width(vocabulary: int) -> int:
    """Bits of an id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` bytes exactly, so that every byte is a few shifts of whole columns."""
    n = len(ids)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    rows = np.zeros((-(-n // 8), 8), np.uint64)
    rows.ravel()[:n] = ids
    out = np.zeros((len(rows), bits), np.uint8)
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        value = rows[:, k] << np.uint64(shift)
        for j in range(first, (k * bits + bits - 1) // 8 + 1):
            out[:, j] |= (value >> np.uint64(8 * (j - first))).astype(np.uint8)
    return out.tobytes()[: (n * bits + 7) // 8]


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, from the bytes that hold them only."""
    row, end = start // 8, -(-stop // 8)
    held = np.frombuffer(payload, np.uint8, count=max(0, min(len(payload), end * bits) - row * bits), offset=row * bits if end > row else 0)
    if len(held) < (end - row) * bits:
        held = np.concatenate([held, np.zeros((end - row) * bits - len(held), np.uint8)])
    rows = held.reshape(-1, bits)
    out = np.empty((len(rows), 8), np.uint32)
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        value = np.zeros(len(rows), np.uint64)
        for j in range(first, (k * bits + bits - 1) // 8 + 1):
            value |= rows[:, j].astype(np.uint64) << np.uint64(8 * (j - first))
        out[:, k] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()[start - row * 8 : stop - row * 8]


def encode_blocks(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the store, for all rows of ``docs`` in ascending order of their ids.

    Null texts are empty; every document ends with ``end_id``. Rows with a null id come first;
    rows with equal ids follow each other in the order of their texts. An empty table gives no
    block. Extra columns are not read.
    """
    path = tokenizer or bytebpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bytebpe.encoder(path)
        bits, part = width(max(enc.size, end_id + 1)), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        block, before, names, held, count = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.cumsum([0, *map(len, held)])
            flat = np.concatenate(held)
            values = [part, block, before, names, sizes.tolist(), bits, len(flat), pack(flat, bits)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["part", "block", "first_id", "doc_ids", "offsets", "bits", "n_ids", "payload"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for s, e in bytebpe.batches_of(texts):
                for name, got in zip(ids[s:e], enc.ids(texts[s:e])):
                    names.append(name)
                    held.append(np.concatenate([got, end]))
                    count += len(got) + 1
                    if count >= BLOCK_IDS:
                        yield flush()
                        block, before, names, held, count = block + 1, before + count, [], [], 0
        if names:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return ordered.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text").transform(in_tasks, run, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the store to ``path``; an existing store there is an error."""
    encode_blocks(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks with ``start``: all ids of the store before the block.

    Only the parts' totals, a row for each task of the writer, are added up over the whole store
    and broadcast.
    """
    read = spark.read.schema(BLOCKS).parquet(path)
    sums = read.groupBy("part").agg(F.sum("n_ids").alias("total"))
    base = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return read.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("first_id"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids: array<int>) of every stored document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts = np.array(row["offsets"])
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(cuts[:-1] + row["start"]), lists], ["doc_id", "start", "ids"])

    return blocks(spark, path).select("doc_ids", "offsets", "bits", "n_ids", "payload", "start").transform(in_tasks, run, "doc_id bigint, start bigint, ids array<int>")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from its stored ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts = np.array(row["offsets"])
                ids = memoryview(unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4").tobytes())
                sums = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(cuts[:-1] + row["start"]), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks(spark, path).select("doc_ids", "offsets", "bits", "n_ids", "payload", "start").transform(in_tasks, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def ids_at(spark: SparkSession, path: str, start: int, stop: int) -> list[int]:
    """Ids ``start`` to ``stop`` of the store; only blocks that overlap are unpacked, and only there."""
    found = blocks(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).orderBy("start")
    out: list[int] = []
    for row in found.select("start", "n_ids", "bits", "payload").toLocalIterator():
        s = row["start"]
        out += unpack(bytes(row["payload"]), row["bits"], max(0, start - s), min(row["n_ids"], stop - s)).tolist()
    return out
