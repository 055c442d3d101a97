"""Shards of balanced bytes, tokens and rows by vector bin packing.

Rows with equal texts are a group and stay together; only a group that no shard has room for is
split. Groups over 1/FINE of a shard in any dimension are packed one by one. The groups below that
are dealt by the hash of their text into a fixed number of bundles, which are packed like groups.
Groups are placed from the largest down, each where the dot product of its size vector with the
shard's residual capacity is highest among the shards that it fits into. Then single groups move or
change places while that evens out the three dimensions together, and at last the bytes alone.

At most 3 * shards * FINE groups, 3 * shards * (SPLIT + 1) * PIECES pieces, and BUNDLES bundles are
packed, however large the table: what the driver holds depends on the parameters alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt.llm.common import materialize

FINE = 2048
BUNDLES = 4096
SPLIT = 8  # a group over 1/SPLIT of a shard can be split
PIECES = 64  # into so many pieces, or that many for each shard it fills
SLOT_ROWS = 100_000  # rows that one task numbers
_SIZES = ("bytes", "tokens", "rows")


def place(units: np.ndarray, shards: int, groups: np.ndarray | None = None) -> np.ndarray:
    """Shard of each unit; ``units`` has a row of non-negative sizes for each.

    Units with the same number in ``groups`` are the pieces of one group and stay together, unless
    no shard has room for them all.
    """
    total = units.sum(axis=0)
    load = units / np.maximum(total, 1e-9) * shards  # a shard's capacity is 1 in every dimension
    names, group = np.unique(np.arange(len(units)) if groups is None else groups, return_inverse=True)
    pieces = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=len(names)))[:-1]) if len(units) else []
    whole = np.zeros((len(names), units.shape[1]))
    np.add.at(whole, group, load)
    residual, out = np.ones((shards, units.shape[1])), np.zeros(len(units), np.int64)

    def best(size: np.ndarray) -> int | None:
        fits = (residual >= size - 1e-12).all(axis=1)
        return int(np.where(fits, residual @ size, -np.inf).argmax()) if fits.any() else None

    for g in np.argsort(-whole.max(axis=1), kind="stable") if len(units) else []:
        own, spot = pieces[g], best(whole[g])
        if spot is None and len(own) > 1:
            spot = None
            for i in own:  # one shard is filled after another
                if spot is None or (residual[spot] < load[i] - 1e-12).any():
                    spot = best(load[i])
                    spot = int((residual - load[i]).min(axis=1).argmax()) if spot is None else spot
                out[i] = spot
                residual[spot] -= load[i]
            continue
        if spot is None:  # the least overflow in the dimension that overflows most
            spot = int((residual - whole[g]).min(axis=1).argmax())
        out[own] = spot
        residual[spot] -= whole[g]
    for weights in ((64.0, 8.0, 8.0), (1.0, 1e-5, 1e-5)):
        alone = np.array([len(set(out[p].tolist())) > 1 or len(p) == 1 for p in pieces], bool)
        out = _even(load, out, shards, alone[group] if len(units) else alone, np.array(weights[: units.shape[1]]))
    return out


def _even(load: np.ndarray, at: np.ndarray, shards: int, free: np.ndarray, weights: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Move or swap free units between the fullest and emptiest shard of a dimension while the weighted squares of the loads fall."""
    sums = np.stack([np.bincount(at, x, shards) for x in load.T], axis=1)
    stuck: set[int] = set()
    for k in range(rounds):
        d = k % load.shape[1]
        if d in stuck:
            if len(stuck) == load.shape[1]:
                break
            continue
        high, low = int(sums[:, d].argmax()), int(sums[:, d].argmin())
        gap = sums[high] - sums[low]
        a, b = np.flatnonzero((at == high) & free), np.flatnonzero((at == low) & free)
        stuck.add(d)
        if not len(a):
            continue
        b = b[np.argsort(load[b, d], kind="stable")]
        other = np.concatenate([np.zeros((1, load.shape[1])), load[b]])  # the first stands for a move
        near = np.searchsorted(other[:, d], load[a, d] - gap[d] / 2)[:, None] + np.arange(-4, 4)
        near = np.clip(np.concatenate([near, np.zeros((len(a), 1), np.int64)], axis=1), 0, len(b))
        moved = load[a][:, None, :] - other[near]
        change = (weights * moved * (moved - gap)).sum(axis=2)
        i, j = divmod(int(change.argmin()), near.shape[1])
        if change[i, j] >= -1e-18:
            continue
        stuck.clear()
        at[a[i]] = low
        if near[i, j]:
            at[b[near[i, j] - 1]] = high
        sums[high] -= moved[i, j]
        sums[low] += moved[i, j]
    return at


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has no bytes, and null texts are a group
    of their own. Slots count from 0 without gaps in every shard, in no order of meaning. Tokens are
    counted as words between white space. An empty table gives an empty result; rows with equal ids
    and repeated rows are packed one by one like other equal texts; texts of any length count
    whole. Extra columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("bigint").alias("tokens"),
        F.coalesce(F.md5(F.encode(F.col(text_col), "UTF-8")), F.lit("null")).alias("key"),
        F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart, and is fixed once it is written
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = [max(1, x or 0) for x in total]
    share = F.greatest(*(F.col(c) * shards / t for c, t in zip(_SIZES, total)))
    large = groups.withColumn("share", share).where(F.col("share") * FINE > 1)
    large = large.select("key", F.when((F.col("share") * SPLIT > 1) & (F.col("rows") > 1), F.least(F.greatest(F.lit(PIECES), F.ceil(F.col("share") * PIECES)), "rows")).otherwise(1).cast("int").alias("pieces"))
    large = F.broadcast(materialize(large, "large-groups"))  # 3 * shards * FINE rows at most
    bundle = F.pmod(F.xxhash64("key"), F.lit(BUNDLES)).cast("string")
    piece = F.coalesce(F.pmod(F.xxhash64("id", "row"), F.col("pieces").cast("bigint")), F.lit(0)).cast("int")
    named = rows.join(large, "key", "left").select("id", "size", "text_crc32", "tokens", "row", F.when(F.col("pieces").isNull(), bundle).otherwise(F.col("key")).alias("unit"), piece.alias("piece"))
    units = named.groupBy("unit", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy("unit", "piece").toPandas()
    spots = place(units[list(_SIZES)].to_numpy(float).reshape(-1, 3), shards, units["unit"].to_numpy(str))
    plan = [(u, int(p), int(s)) for u, p, s in zip(units["unit"], units["piece"], spots)]
    plan = docs.sparkSession.createDataFrame(plan, "unit string, piece int, shard int")
    placed = named.join(F.broadcast(plan), ["unit", "piece"]).drop("unit", "piece")
    return number(placed, max(1, total[2] // (SLOT_ROWS * shards))).drop("row")


def number(placed: DataFrame, blocks: int) -> DataFrame:
    """Add ``slot``: rows are numbered in blocks of a shard, and blocks begin where others end."""
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)))
    counts = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size", "row")
    out = dealt.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "block"])
    return out.withColumn("slot", F.col("start") + F.col("at")).drop("block", "start", "at")
