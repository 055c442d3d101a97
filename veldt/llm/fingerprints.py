"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A document is the multiset of its paragraphs. Each paragraph is hashed to a wide vector, and a
document's fingerprint is the sum of these vectors, lane by lane, modulo powers of two: the order
of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its
vector. The lanes are

* four identity lanes modulo 2^62, hashes of the paragraph with four seeds, for equality;
* a word count and 64 likeness lanes modulo 2^32: in how many of the paragraph's words each bit of
  the word's hash is set. Twice a lane less the word count is a sum of random signs, and the mean
  square of the difference of two such sums estimates the squared distance of the word counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt.llm.common import materialize

IDENTITY = 4
PAIRS = 32  # likeness lanes j and j + 32 share one number while they are summed
_IDENTITY_MASK = (1 << 62) - 1
_LANE = (1 << 32) - 1
_LEAST = -(1 << 63)


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def identity_lanes(text: Column) -> list[Column]:
    """Sums over paragraphs; every addend and sum is below 2^62, so nothing overflows."""
    mask = F.lit(_IDENTITY_MASK)

    def lane(seed: int) -> Column:
        return F.aggregate(paragraphs(text), F.lit(0).cast("bigint"), lambda a, p: (a + F.xxhash64(p, F.lit(seed)).bitwiseAND(mask)).bitwiseAND(mask))

    return [lane(seed) for seed in range(IDENTITY)]


def vectors(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` (unique) with ``v``: struct(ids: 4 identity lanes, n: words, lanes: 32 lane pairs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = texts.select(*keys, text.alias("__t"), *(c.alias(f"__i{k}") for k, c in enumerate(identity_lanes(text))))
    ids = [f"__i{k}" for k in range(IDENTITY)]
    words = base.select(*keys, *ids, F.explode(F.split("__t", r"[\x20\x09-\x0D]+")).alias("__w"))
    # An empty text has one empty word, which adds nothing and keeps its row.
    words = words.select(*keys, *ids, F.when(F.col("__w") != "", F.xxhash64("__w")).otherwise(0).alias("__h"), (F.col("__w") != "").cast("bigint").alias("__one"))
    pair = (1 << 32) | 1
    sums = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(F.lit(pair))).alias(f"__l{j}") for j in range(PAIRS)]
    found = words.groupBy(*keys, *ids).agg(F.sum("__one").alias("__n"), *sums)
    return found.select(*keys, F.struct(F.array(*ids).alias("ids"), F.col("__n").alias("n"), F.array(*(f"__l{j}" for j in range(PAIRS))).alias("lanes")).alias("v"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the multiset sum (``sign`` 1) or difference (-1) of two fingerprints."""

    def each(x: Column, y: Column, low: int) -> Column:
        return F.pmod(x + sign * y, F.lit(low + 1)) if low == _LANE else (x + (y if sign > 0 else F.lit(low) - y + 1)).bitwiseAND(F.lit(low))

    def both(x: Column, y: Column) -> Column:
        high = each(F.shiftrightunsigned(x, 32), F.shiftrightunsigned(y, 32), _LANE)
        return F.shiftleft(high, 32).bitwiseOR(each(x.bitwiseAND(F.lit(_LANE)), y.bitwiseAND(F.lit(_LANE)), _LANE))

    return F.struct(
        F.zip_with(a["ids"], b["ids"], lambda x, y: each(x, y, _IDENTITY_MASK)).alias("ids"),
        each(a["n"], b["n"], _LANE).alias("n"),
        F.zip_with(a["lanes"], b["lanes"], both).alias("lanes"),
    )


def as_text(v: Column) -> Column:
    """The fingerprint as lower-case hexadecimal digits."""
    numbers = F.concat(v["ids"], F.array(v["n"]), v["lanes"])
    return F.lower(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _signs(v: Column) -> Column:
    low = F.transform(v["lanes"], lambda x: (2 * x.bitwiseAND(F.lit(_LANE)) - v["n"]).cast("double"))
    high = F.transform(v["lanes"], lambda x: (2 * F.shiftrightunsigned(x, 32) - v["n"]).cast("double"))
    return F.concat(low, high)


def _square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, s: a + s * s)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the estimated squared distance of the word counts over their squared lengths.

    Equal fingerprints have 1, different ones less than 1; two texts without words have 1.
    """
    sa, sb = _signs(a), _signs(b)
    apart = _square(F.zip_with(sa, sb, lambda x, y: x - y))
    length = _square(sa) + _square(sb)
    raw = F.when(length > 0, F.greatest(F.lit(0.0), 1 - apart / length)).otherwise(F.lit(0.0))
    return F.when(a["ids"] == b["ids"], F.lit(1.0)).otherwise(F.least(raw, F.lit(1 - 2.0**-20)))


def next_keys(keys: DataFrame) -> DataFrame:
    """``keys`` (id, tag, ...; distinct) with (next_id, next_tag): the next key in descending order.

    After the last comes the first. Keys are ranged, ordered inside each range, and the ranges are
    tied together by one row each.
    """
    ranged = materialize(keys.repartitionByRange("id", "tag").withColumn("part", F.spark_partition_id()), "ranged")
    edges = ranged.groupBy("part").agg(F.max(F.struct("id", "tag")).alias("top"))
    order = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lag("top").over(order), F.last("top").over(whole)).alias("edge"))
    inside = Window.partitionBy("part").orderBy("id", "tag")
    near = ranged.withColumn("near", F.lag(F.struct("id", "tag")).over(inside))
    near = near.join(F.broadcast(edges), "part").withColumn("near", F.coalesce("near", "edge"))
    return near.select(*keys.columns, F.col("near.id").alias("next_id"), F.col("near.tag").alias("next_tag"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, order): every distinct row's text and edited text, and the table of next keys.

    The edit replaces the last third of a text (rounded down) by as many characters from the start
    of the next document, or all it has. Null texts are empty. Null ids come after all others in
    descending order; rows with equal ids follow the hashes of their texts; exact repeats of a row
    count as one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    order = materialize(next_keys(keyed.select("id", "tag", F.char_length("text").alias("n")).distinct()), "order")
    dealt = keyed.repartition("id", "tag")
    asked = order.select("id", "tag", F.col("next_id").alias("i"), F.col("next_tag").alias("t"), F.floor(F.col("n") / 3).cast("int").alias("cut"))
    head = dealt.join(asked.withColumnsRenamed({"id": "own_id", "tag": "own_tag", "i": "id", "t": "tag"}), ["id", "tag"])
    head = head.groupBy("own_id", "own_tag").agg(F.first(F.substring(F.col("text"), F.lit(1), F.col("cut"))).alias("head")).withColumnsRenamed({"own_id": "id", "own_tag": "tag"})
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("head"))
    return dealt.dropDuplicates(["id", "tag"]).join(head, ["id", "tag"]).select("id", "tag", "text", edited.alias("edited")), order


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``.

    (id, n_chars, edited_sha256, v, edited_v, near_edited, near_next); the last two are the
    likeness of a document's fingerprint to its edited text's and to the next document's.
    """
    texts, order = edits(docs, id_col, text_col)
    both = texts.select("id", "tag", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("t")))).alias("x"))
    flat = both.select("id", "tag", "n_chars", "edited_sha256", F.col("x.k").alias("k"), F.col("x.t").alias("t"))
    found = materialize(vectors(flat, ["id", "tag", "n_chars", "edited_sha256", "k"], "t"), "vectors")
    own = found.where("k = 0").select("id", "tag", "n_chars", "edited_sha256", "v")
    other = found.where("k = 1").select("id", "tag", F.col("v").alias("edited_v"))
    after = found.where("k = 0").select(F.col("id").alias("next_id"), F.col("tag").alias("next_tag"), F.col("v").alias("next_v"))
    joined = own.join(other, ["id", "tag"]).join(order.select("id", "tag", "next_id", "next_tag"), ["id", "tag"]).join(after, ["next_id", "next_tag"])
    out = joined.select("id", "tag", "n_chars", "edited_sha256", "v", "edited_v", likeness(F.col("v"), F.col("edited_v")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
    return rows.join(out, ["id", "tag"]).drop("tag").withColumn("id", F.when(F.col("id") != _LEAST, F.col("id")))
