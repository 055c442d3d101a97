"""Benchmark decontamination as a prefix-filtered containment join.

Items are cut into windows of words. A document contains a window only if it contains the window's
rarest word, so that word alone is the window's necessary prefix: windows are indexed by it, with
the place it has in them. Rarity is counted over all documents. Windows with a word that no
document has are left out. Where a document has a prefix word, the window's place and length must
fit into the document, and then all words are compared.

Windows, rarity and prefixes are tables that Spark joins. The index, which has a row for each
window, is dealt into blocks by the prefix words. Each block is broadcast, its size is measured
before, and documents pass one after the other, without a shuffle of their texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import fresh, in_tasks, materialize

BLOCK_BYTES = 48 << 20  # bytes of windows and item ids in one broadcast block
COUNTED = 200_000  # words that a task counts before it hands on their numbers
MARK = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, items: array<string>>"
_MARK = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
#: A-Z to lower case; other ASCII characters but letters and digits to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _windows(items: DataFrame, size: int) -> DataFrame:
    """(item, window: its words, joined by a space), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                found = {b" ".join(words[at : at + size]) for at in range(max(1, len(words) - size + 1))} if words else ()
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.string()), pa.array(list(found), pa.binary())], ["item", "window"])

    return items.transform(in_tasks, run, "item string, window binary").distinct()


def frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): in how many documents each word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(set(words_of(text.as_py())))
                if len(seen) > COUNTED:
                    yield flush(seen)
                    seen.clear()
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col)).transform(in_tasks, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def prefix_index(docs: DataFrame, items: DataFrame, window: int, text_col: str = "text") -> DataFrame:
    """(prefix, place, window, items): each window with its rarest word and that word's first place in it."""
    windows = materialize(_windows(items, window), "windows")
    words = F.split(F.col("window").cast("string"), " ")
    held = windows.select("window").distinct().select("window", F.size(words).alias("size"), F.posexplode(words).alias("place", "word"))
    held = held.withColumn("word", F.col("word").cast("binary"))
    asked = held.select("word").distinct()
    known = materialize(frequencies(docs, text_col).join(asked, "word", "left_semi"), "frequencies")
    least = held.join(known, "word").groupBy("window", "size").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "word", "place")).alias("least"))
    least = least.where("known = size").select("window", F.col("least.word").alias("prefix"), F.col("least.place").alias("place"))
    names = windows.groupBy("window").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return materialize(least.join(names, "window").select("prefix", "place", "window", "items"), "index")


def _hits(words: list[bytes], index: dict) -> tuple[bytearray, set[str]]:
    hit, items = bytearray(len(words)), set()
    prefixes = index.keys() & set(words)
    if prefixes:
        for at, word in enumerate(words):
            if word in prefixes:
                for place, size, window, names in index[word]:
                    start, end = at - place, at - place + size
                    if start >= 0 and end <= len(words) and b" ".join(words[start:end]) == window:
                        hit[start:end] = b"\x01" * size
                        items.update(names)
    return hit, items


def _spans(hit: bytearray) -> list[dict]:
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append({"start": at, "end": end})
        at = hit.find(1, end)
    return out


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", name: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column: n_words, spans of words inside occurring windows, item ids.

    Null texts have no words. An item of fewer words than a window, but not none, is one window.
    Items with a null id or text are left out; equal texts of several items count for each item.
    Repeated rows stay; other columns stay as they are, one named ``name`` is replaced. With an
    empty benchmark nothing is hit, and an empty table gives an empty one. Texts of any length are
    read whole.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    rows = prefix_index(docs, items, window, text_col)
    total = rows.agg(F.sum(F.octet_length("window") + F.octet_length("prefix") + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    out = docs.drop(name)
    rest = out.columns
    at = rest.index(text_col)
    kinds = T.StructType([*out.schema.fields, T.StructField(name, T.DataType.fromDDL(MARK))])
    part = F.pmod(F.xxhash64("prefix"), F.lit(parts))
    full = sorted(r[0] for r in rows.select(part).distinct().collect())  # a number a block; empty blocks need no pass
    for k in full or [0]:
        block: dict[bytes, list] = {}
        for r in rows.where(part == k).toLocalIterator():
            held = bytes(r["window"])
            block.setdefault(bytes(r["prefix"]), []).append((r["place"], held.count(b" ") + 1, held, tuple(r["items"])))
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index, first=k == (full or [0])[0]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = []
                before = [None] * batch.num_rows if first else batch.column(len(rest)).to_pylist()
                for text, old in zip(batch.column(at), before):
                    words = words_of(text.as_py())
                    hit, names = _hits(words, index.value)
                    for span in old["spans"] if old else ():
                        hit[span["start"] : span["end"]] = b"\x01" * (span["end"] - span["start"])
                    names.update(old["items"] if old else ())
                    marks.append({"n_words": len(words), "spans": _spans(hit), "items": sorted(names)})
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(marks, _MARK)], [*rest, name])

        out = out.transform(in_tasks, run, kinds)
    return out


def n_hit(name: str = "contamination") -> Column:
    return F.aggregate(F.col(f"{name}.spans"), F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))


def is_contaminated(name: str = "contamination", share: int = 20) -> Column:
    """At least one word, and one in ``share`` words, lies in a benchmark window."""
    hit = n_hit(name)
    return (hit > 0) & (hit * share >= F.col(f"{name}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated; no column is changed."""
    (name,) = fresh(docs, "contamination")
    return mark(docs, benchmark, window, text_col, name=name).where(~is_contaminated(name)).drop(name)
