"""Exact substring deduplication by relative Lempel-Ziv parsing against shared reference blocks.

Every text is cut into blocks: the consecutive windows of ``window`` words that have the same
anchor, the word run with the least hash in them. Equal windows have equal anchors at the same
place in them, so a window can only repeat inside blocks of its anchor. The blocks with an anchor
that stands elsewhere too are the reference, and each of them is parsed:

* a block whose words all equal an earlier block's is one factor, a copy in whole;
* otherwise the earliest block of its anchor is its reference. The two are laid upon each other at
  the anchor, and the factor is extended from there, word by word in both directions, as long as
  the words are equal. A factor of a window or more is a copy;
* windows across a factor's boundary may stand in another block. They alone are compared by hash
  with the windows that other factors left over;
* touching factors join, and every word of a factor is removed.

Blocks are counted with partial sums before their shuffle, so a passage in very many documents
arrives as one row from each task. Whole blocks and left-over windows are equal if their 64-bit
hashes and their 64-bit anchors are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import discard, in_tasks, materialize

ANCHOR_WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SLICE = 1 << 16  # windows whose anchors are searched together
#: A block's place: first window, number of windows (below 2^6), and bits of the text's hash, which tell rows with equal ids apart.
_N_BITS, _TAG_BITS = 6, 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


class Parsed:
    """Hashes of any run of words of one text, and its anchors."""

    def __init__(self, words: list[bytes], window: int):
        self.n, self.window = len(words), window
        hashed = word_hashes(words)
        k = min(ANCHOR_WORDS, window)
        grams = np.zeros(self.n - k + 1, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(0xD1342543DE82EF95) + hashed[j : self.n - k + 1 + j]
        self.grams = _mix(grams)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_mix(hashed) * _powers(_BASE, self.n))])
        self.back = _powers(_INVERSE, self.n + 1)
        wide = window - k + 1
        views = np.lib.stride_tricks.sliding_window_view(self.grams, wide)
        self.anchor_at = np.concatenate([views[i : i + _SLICE].argmin(axis=1) for i in range(0, len(views), _SLICE)]) + np.arange(len(views))

    def hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the ``size`` words from each ``start``."""
        return _mix((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size).astype(np.uint64))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor, content) of each block."""
        first = np.flatnonzero(np.append(True, np.diff(self.anchor_at) != 0))
        n = np.diff(np.append(first, len(self.anchor_at)))
        return first, n, self.grams[self.anchor_at[first]], self.hash(first, n + self.window - 1)


def _again(*keys: np.ndarray) -> np.ndarray:
    """True where the same keys stand earlier."""
    order = np.lexsort(keys[::-1])
    same = np.append(False, np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])) if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order] = same  # lexsort is stable: the first of equal keys is the earliest
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _block_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            count = 0
            for name, tag, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                if len(words) < window:
                    continue
                first, n, anchor, content = Parsed(words, window).blocks()
                place = (first.astype(np.int64) << (_N_BITS + _TAG_BITS)) | (n << _TAG_BITS) | tag
                out.append((np.full(len(first), name), place, anchor, content, _again(anchor, content)))
                count += len(first)
                if count > 200_000:
                    yield flush(out)
                    out, count = [], 0
            if out:
                yield flush(out)

    def flush(out: list[tuple]) -> pa.RecordBatch:
        name, place, anchor, content, again = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(place), _signed(anchor), _signed(content), pa.array(again)], ["id", "place", "anchor", "content", "again"])

    return run


def _reference_rows(window: int):
    """The words of the asked blocks, the place of the anchor in them, and which of their windows stand earlier in the same text (a bit each)."""
    k = min(ANCHOR_WORDS, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, tag, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                parsed = Parsed(words, window)
                places = np.sort(np.array(asked.as_py(), np.int64))  # in the order of the text
                first, n = places >> (_N_BITS + _TAG_BITS), (places >> _TAG_BITS) & ((1 << _N_BITS) - 1)
                starts = np.cumsum(n) - n
                at = np.repeat(first - starts, n) + np.arange(n.sum())
                twice = _again(parsed.grams[parsed.anchor_at[at]], parsed.hash(at, window))
                bits = np.bitwise_or.reduceat(twice.astype(np.int64) << np.repeat(-starts, n) + np.arange(len(at)), starts)
                anchor = parsed.anchor_at[first]
                held = [b" ".join(words[s:e]) for s, e in zip(first.tolist(), (first + n + window - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), name)), pa.array(places), _signed(parsed.grams[anchor]), pa.array(held, pa.binary()), pa.array((anchor - first).astype(np.int32)), pa.array(bits)], _REFERENCE.names)

    _REFERENCE = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("anchor", pa.int64()), ("words", pa.binary()), ("at", pa.int32()), ("twice", pa.int64())])
    return run


def extended(a: list[bytes], at: int, b: list[bytes], bt: int) -> tuple[int, int]:
    """The longest run of ``a`` around its place ``at`` whose words equal those of ``b`` around ``bt``: (start, end)."""
    low, high, shift = at, at, bt - at
    least, most = max(0, -shift), min(len(a), len(b) - shift)
    while low > least and a[low - 1] == b[low - 1 + shift]:
        low -= 1
    while high < most and a[high] == b[high + shift]:
        high += 1
    return low, high


def _factor_rows(window: int):
    """Of each block, its copied windows as places without an anchor, and its left-over windows with anchor and content."""
    mask = (1 << _TAG_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, place, anchor, words, at, twice, ref_id, ref_place, ref_words, ref_at in zip(*(c.to_pylist() for c in batch.columns)):
                tag, n, first = place & mask, place >> _TAG_BITS & (1 << _N_BITS) - 1, place >> _N_BITS + _TAG_BITS
                own, gone = words.split(b" "), twice
                if ref_id < name or (ref_id == name and ref_place & mask == tag and ref_place < place):
                    start, end = extended(own, at, ref_words.split(b" "), ref_at)
                    if end - start >= window:
                        gone |= (1 << end - window + 1) - (1 << start)
                w = 0
                while w < n:
                    run_n = 1
                    if gone >> w & 1:
                        while gone >> w + run_n & 1:
                            run_n += 1
                        key = None, None
                    else:
                        key = anchor, xxhash.xxh64_intdigest(b" ".join(own[w : w + window])) - (1 << 63)
                    out.append((name, (first + w) << _N_BITS + _TAG_BITS | run_n << _TAG_BITS | tag, *key))
                    w += run_n
            names, places, anchors, contents = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(places, pa.int64()), pa.array(anchors, pa.int64()), pa.array(contents, pa.int64())], ["id", "place", "anchor", "content"])

    return run


_ROW = "id bigint, place bigint, anchor bigint, content bigint, again boolean"
_REFERENCE_ROW = "id bigint, place bigint, anchor bigint, words binary, at int, twice bigint"


def _grouped(places: DataFrame, name: str) -> DataFrame:
    """One row for each text: its places in an array, no longer than the text. Repeated rows have the same places once."""
    return places.select("id", F.col("place").bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).cast("int").alias("tag"), "place").groupBy("id", "tag").agg(F.collect_set("place").alias(name))


def deduplicate(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept, spans) for every row of ``docs``.

    Words are separated by ASCII white space. A word goes if it lies in a window whose words, in
    order, also start earlier: in a row with a smaller id, or before it in the same text. ``kept``
    joins the other words by a space; ``spans`` are the removed runs of words (start, end).

    Null texts have no words, texts shorter than a window lose none. Rows with a null id count as
    smaller than all others; of rows with equal ids none is earlier than another. Repeated rows
    come out repeatedly, in time that grows with their number; an empty table gives an empty result.
    Texts of any length are parsed whole. Extra columns are not read. A window has 5 to 63 words.
    """
    if not ANCHOR_WORDS <= window < 1 << _N_BITS:
        raise ValueError(f"a window has {ANCHOR_WORDS} to {(1 << _N_BITS) - 1} words")
    tag = F.xxhash64(text_col).bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).cast("int")
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))
    blocks = materialize(texts.transform(in_tasks, _block_rows(window), _ROW), "blocks")

    anchors = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    # Written first, so that the join below has plain shuffles on both sides and a hot anchor's can be split.
    shared = materialize(anchors.where("n > 1").select("anchor", "low", (F.col("c0") != F.col("c1")).alias("mixed")), "shared-anchors")
    found = materialize(blocks.join(shared, "anchor").where("mixed or again or id > low"), "shared-blocks")
    plain = found.where("not mixed").select("id", "place")
    mixed = found.where("mixed")
    discard(blocks, shared)
    # Written first, for the same reason: one content may be in very many documents.
    firsts = materialize(mixed.where("not again").groupBy("anchor", "content").agg(F.min("id").alias("first")), "first-blocks")
    judged = mixed.join(firsts, ["anchor", "content"])
    copies = judged.where("again or id > first").select("id", "place")
    asked = judged.where("not again and id = first").select("id", "place")
    whole = materialize(plain.union(copies), "copied-blocks")
    asked = materialize(_grouped(asked, "asked"), "asked-blocks")
    discard(found, firsts)

    own = materialize(texts.join(asked, ["id", "tag"]).select("id", "tag", "text", "asked").transform(in_tasks, _reference_rows(window), _REFERENCE_ROW), "reference-blocks")
    earliest = own.groupBy("anchor").agg(F.min_by(F.struct("id", "place", "words", "at"), F.struct("id", "place")).alias("r"))
    earliest = materialize(earliest.select("anchor", *(F.col(f"r.{c}").alias(f"ref_{c}") for c in ("id", "place", "words", "at"))), "earliest-blocks")
    laid = own.join(earliest, "anchor").select("id", "place", "anchor", "words", "at", "twice", "ref_id", "ref_place", "ref_words", "ref_at")
    factors = materialize(laid.transform(in_tasks, _factor_rows(window), "id bigint, place bigint, anchor bigint, content bigint"), "factors")
    discard(asked, own, earliest)
    left = factors.where("anchor is not null")
    starts = materialize(left.groupBy("anchor", "content").agg(F.min("id").alias("first")), "first-windows")
    repeats = left.join(starts, ["anchor", "content"]).where("id > first").select("id", "place")
    spans = _grouped(whole.union(factors.where("anchor is null").select("id", "place")).union(repeats), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                drop = np.zeros(len(words) + 1, np.int64)
                if places.is_valid:
                    at = np.array(places.as_py(), np.int64) >> _TAG_BITS
                    first, n = at >> _N_BITS, at & ((1 << _N_BITS) - 1)
                    np.add.at(drop, first, 1)
                    np.add.at(drop, first + n + window - 1, -1)
                gone = np.cumsum(drop)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words)
                rows.append((len(words), int(gone.sum()), kept.decode(), [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]))
            n_words, removed, kept, spans_ = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "n_words", "n_removed", "kept", "spans"])

    out = texts.join(spans, ["id", "tag"], "left").select("id", "text", "places").transform(in_tasks, cut, "id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: int, end: int>>")
    return out.withColumn("id", F.when(F.col("id") != -(1 << 63), F.col("id")))
