"""Cluster bootstrap, grouped permutation and grouped splits, driven by hashes.

Draw j of replicate r takes the cluster whose place, by sorted key, is a hash of (seed, r, j)
modulo the number of clusters: sampling with replacement that any engine repeats exactly. Ratios
resample the clusters' sums. Metrics of ordered scores keep for each cluster an array of its weights,
and add up arrays along the scores. Rows are never copied for each replicate; the weights table has
replicates times clusters rows at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from veldt.functions.scalars import CLIP, clip_p
from veldt.operators import metrics, windows
from veldt.session import ship

CHUNK = 2048  # cells that meet their weights at once
SCORES = 4096  # distinct (model, label, score) whose weights in all replicates a task holds
CLUSTERS = 256  # of one product
LARGEST = 1_000_000  # rows of a cluster that a task holds


def draw(seed: int, replicate: Column, j: Column, clusters: Column) -> Column:
    head = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), j.cast("string")), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % clusters


def numbered(clusters: DataFrame, key: str) -> DataFrame:
    """Keys with their places from 0, in the keys' order, and how many there are.

    The places come from running sums over ranges of keys, so no task orders them all.
    """
    out = clusters.select(key).distinct().where(F.col(key).isNotNull()).withColumn("__one", F.lit(1).cast("bigint"))
    n = out.agg(F.count(F.lit(1)).alias("__m"))
    return windows.running_sums(out, [], key, ["__one"]).select(key, (F.col("__one__run") - 1).alias("__at")).crossJoin(n)


def bootstrap_weights(clusters: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, weight): how often each replicate draws a cluster."""
    places, drawn = _draws(clusters, key, replicates, seed)
    return drawn.join(places.select(key, "__at"), "__at").select("replicate", key, "weight")


def _draws(clusters: DataFrame, key: str, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The clusters' places, and (replicate, __at, weight): how often each replicate draws a place."""
    places = numbered(clusters, key)
    m = clusters.select(key).distinct().where(F.col(key).isNotNull()).count()
    # One row a draw from the start, so that no row holds all draws of a replicate.
    draws = clusters.sparkSession.range(replicates * m).select(F.floor(F.col("id") / max(1, m)).alias("replicate"), (F.col("id") % max(1, m)).alias("j"))
    drawn = draws.select("replicate", draw(seed, F.col("replicate"), F.col("j"), F.lit(m)).alias("__at"))
    return places, drawn.groupBy("replicate", "__at").agg(F.count(F.lit(1)).alias("weight"))


def ratio_replicates(stats: DataFrame, key: str, ratios: dict[str, tuple[str, str, float]], replicates: int, seed: int, by: list[str] = ()) -> DataFrame:
    """(by, replicate, ratios): scaled ratios of resampled sums of cluster statistics."""
    weights = bootstrap_weights(stats, key, replicates, seed)
    sums = stats.join(weights, key).groupBy(*by, "replicate").agg(*(F.try_divide(k * F.sum(F.col("weight") * F.col(a)), F.sum(F.col("weight") * F.col(b))).alias(name) for name, (a, b, k) in ratios.items()))
    return sums


def ratio_intervals(stats: DataFrame, key: str, ratios: dict[str, tuple[str, str, float]], replicates: int = 1000, seed: int = 20260723, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """Estimates of the full data with percentile intervals."""
    edge = (1 - level) / 2
    point = stats.groupBy(*by).agg(*(F.try_divide(k * F.sum(a), F.sum(b)).alias(name) for name, (a, b, k) in ratios.items()))
    reps = ratio_replicates(stats, key, ratios, replicates, seed, by)
    bounds = reps.groupBy(*by).agg(*(F.percentile(n, q).alias(f"{n}_{side}") for n in ratios for side, q in (("low", edge), ("high", 1 - edge))))
    return windows.matched(point, bounds, list(by))


def contrast_intervals(stats: DataFrame, key: str, category: str, a: str, b: str, value: str, n: str, replicates: int = 1000, seed: int = 20260723, scale: float = 100.0) -> DataFrame:
    """(estimate, low, high, excludes_zero) of a - b, both sides under the same draws."""
    weights = bootstrap_weights(stats, key, replicates, seed)

    def ratio(w: Column, side: str) -> Column:
        own = F.col(category) == side
        return F.try_divide(scale * F.sum(F.when(own, w * F.col(value))), F.sum(F.when(own, w * F.col(n))))

    point = stats.agg((ratio(F.lit(1), a) - ratio(F.lit(1), b)).alias("estimate"))
    reps = stats.join(weights, key).groupBy("replicate").agg((ratio(F.col("weight"), a) - ratio(F.col("weight"), b)).alias("d"))
    bounds = reps.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    return point.crossJoin(bounds).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def weight_arrays(clusters: DataFrame, key: str, replicates: int, seed: int, block: int) -> DataFrame:
    """(key, block, at, weight): each cluster's draws in each block of ``block`` replicates, those that draw it alone."""
    places, drawn = _draws(clusters, key, replicates, seed)
    entry = F.struct((F.col("replicate") % block).cast("int").alias("at"), F.col("weight").cast("int").alias("weight"))
    own = drawn.groupBy("__at", F.floor(F.col("replicate") / block).cast("int").alias("block")).agg(F.collect_list(entry).alias("__e"))
    return own.join(places.select(key, "__at"), "__at").select(key, "block", _field("__e", "at").alias("at"), _field("__e", "weight").alias("weight"))


class _Weights:
    """The replicate weights of the clusters of one task, a row each."""

    def __init__(self, size: int):
        self.size, self.place, self.rows, self.matrix = size, {}, [], None

    def add(self, key, at, weight) -> None:
        row = np.zeros(self.size)
        row[at] = weight
        self.place[key] = len(self.rows)
        self.rows.append(row)
        self.matrix = None

    def of(self, keys: list) -> np.ndarray:
        if self.matrix is None:
            self.matrix = np.stack([*self.rows, np.zeros(self.size)])
        return self.matrix[[self.place.get(k, -1) for k in keys]]


class _Scores:
    """Areas and precision sums of all replicates over rows in the order of their scores, a chunk at a time.

    Rows of one score may come in several chunks; ``below`` and ``whole`` are the failures and the
    weights before the score at hand.
    """

    def __init__(self, below: np.ndarray, whole: np.ndarray):
        self.below, self.whole = below.copy(), whole.copy()
        self.area, self.steps = np.zeros(len(below)), np.zeros(len(below))
        self.now, self.up, self.down = None, np.zeros(len(below)), np.zeros(len(below))

    def add(self, p: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        up, down = np.add.reduceat(up, start), np.add.reduceat(down, start)
        if self.now is not None and self.now == p[0]:
            up[0] += self.up
            down[0] += self.down
        elif self.now is not None:
            self._close(self.up[None], self.down[None])
        self._close(up[:-1], down[:-1])
        self.now, self.up, self.down = p[start[-1]], up[-1], down[-1]

    def _close(self, up: np.ndarray, down: np.ndarray) -> None:
        fell, all_ = np.cumsum(down, 0) + self.below, np.cumsum(up + down, 0) + self.whole
        self.area += (up * (fell - down / 2)).sum(0)
        self.steps += (down * fell / np.where(all_ > 0, all_, 1)).sum(0)
        if len(up):
            self.below, self.whole = fell[-1], all_[-1]

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        if self.now is not None:
            self._close(self.up[None], self.down[None])
        return self.area, self.steps


def _in_ranges(of_task, size: int):
    """A function for ``mapInArrow`` over rows of tasks (model, range, block), one after another.

    A task's rows are of three kinds, in this order: what lies before its range, its clusters' weights,
    and its cells by score. ``of_task(before, chunks)`` gives its arrays by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (model, rng, block), rows in groupby(_runs(batches), key=lambda r: r[0]):
            before = (np.zeros(size), np.zeros(size))
            weights, done = _Weights(size), None
            for _, kind, part in rows:
                if kind == 0:
                    before = tuple(np.array(part.column(c)[0].as_py(), float) for c in ("below", "whole"))
                elif kind == 1:
                    for key, at, weight in zip(*(part.column(c).to_pylist() for c in ("key", "at", "weight"))):
                        weights.add(key, at, weight)
                elif weights.rows:
                    for s in range(0, part.num_rows, CHUNK):
                        own = part.slice(s, CHUNK)
                        w = weights.of(own.column("key").to_pylist()) * own.column("n").to_numpy()[:, None]
                        up = own.column("y").to_numpy() == 1
                        done = of_task(done, before, own.column("p").to_numpy(zero_copy_only=False), w * up[:, None], w * ~up[:, None])
            if done is not None:
                a, b = done.end() if isinstance(done, _Scores) else done
                yield pa.RecordBatch.from_arrays([pa.array([model], pa.string()), pa.array([rng], pa.int32()), pa.array([block], pa.int32()), pa.array([a.tolist()], pa.list_(pa.float64())), pa.array([b.tolist()], pa.list_(pa.float64()))], ["model", "range", "block", "a", "b"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(task, kind, rows) of the runs of each batch that have the same task and kind."""
    for batch in batches:
        heads = list(zip(*(batch.column(c).to_pylist() for c in ("model", "range", "block", "kind"))))
        at = 0
        for head, own in groupby(heads):
            n = sum(1 for _ in own)
            yield head[:3], head[3], batch.slice(at, n)
            at += n


def _totals(done, before, p, up, down):
    a, b = (np.zeros(up.shape[1]), np.zeros(up.shape[1])) if done is None else done
    return a + up.sum(0), b + down.sum(0)


def _scored(done, before, p, up, down):
    done = _Scores(*before) if done is None else done
    done.add(p, up, down)
    return done


def _field(entries: str, name: str) -> Column:
    return F.transform(entries, lambda e: e[name])


_TASK = "model string, range int, block int, a array<double>, b array<double>"


def _ordered(cells: DataFrame, weights: DataFrame, before: DataFrame | None, of_task, size: int, blocks: int) -> DataFrame:
    """(model, range, block, a, b): arrays of ``of_task`` over the cells of each range with every block's weights."""
    kinds = {"key": cells.schema["key"].dataType, "p": "double", "y": "int", "n": "double", "at": "array<int>", "weight": "array<int>", "below": "array<double>", "whole": "array<double>"}

    def kind(df: DataFrame, k: int) -> DataFrame:
        return df.select("model", "range", "block", F.lit(k).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))

    held = cells.select("model", "range", "key").distinct().join(weights, "key")
    parts = [kind(held, 1), kind(cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), 2)]
    if before is not None:
        parts.append(kind(before, 0))
    dealt = reduce(DataFrame.unionByName, parts).repartition("model", "range", "block").sortWithinPartitions("model", "range", "block", "kind", "p")
    ship(cells.sparkSession)
    return dealt.mapInArrow(_in_ranges(of_task, size), _TASK)


def metric_replicates(long: DataFrame, key: str, models: str = "model", replicates: int = 1000, seed: int = 20260723, block: int = 250) -> DataFrame:
    """(replicate, model, auc, average_precision, log_loss, brier) under common draws.

    Rows are summed to cells of distinct (cluster, model, label, score), and a cell is never written once for each
    replicate. Where there are few distinct scores, their weights in all replicates are a product of matrices. Else tasks hold the cells of one range of scores, and of each cluster an array of its weights
    in a block of replicates. Losses resample the clusters' own sums. Areas and precisions are running sums of
    arrays along the scores, from what lies in the ranges before; equal scores lie in one range.
    Rows without a cluster, label or score take no part; a replicate with one class alone has no area.
    """
    named = long.where(F.col(key).isNotNull() & F.col("y").isNotNull() & F.col("p").isNotNull()).select(F.col(key).alias("key"), F.col(models).cast("string").alias("model"), F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p"))
    blocks = -(-replicates // block)
    cells = windows.once(named.groupBy("key", "model", "y", "p").agg(F.count(F.lit(1)).cast("double").alias("n")))
    scores = cells.select("model", "y", "p").where("model IS NOT NULL").distinct()
    if scores.limit(SCORES + 1).count() <= SCORES:
        return _few_scores(cells, scores, replicates, seed).withColumnRenamed("model", models)
    weights = windows.once(weight_arrays(cells, "key", replicates, seed, block))
    steps = F.array(*(F.lit(i / windows.RANGES) for i in range(1, windows.RANGES)))
    edges = cells.groupBy("model").agg(F.array_distinct(F.percentile_approx("p", steps, 1000)).alias("__edges"))
    cut = windows.matched(cells, edges, ["model"]).withColumn("range", F.size(F.filter("__edges", lambda e: e < F.col("p")))).drop("__edges")
    sums = cut.groupBy("model", "range", "key", "y").agg(F.sum("n").alias("n")).withColumn("p", F.lit(0.0))
    totals = windows.once(_ordered(sums, weights, None, _totals, block, blocks))
    flat = totals.select("model", "range", "block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x"))
    ahead = Window.partitionBy("model", "block", "at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.select("model", "range", "block", "at", F.coalesce(F.sum("x.b").over(ahead), F.lit(0.0)).alias("below"), F.coalesce(F.sum(F.col("x.a") + F.col("x.b")).over(ahead), F.lit(0.0)).alias("whole"))
    entry = F.array_sort(F.collect_list(F.struct("at", "below", "whole")))
    before = flat.groupBy("model", "range", "block").agg(entry.alias("e")).select("model", "range", "block", *(_field("e", c).alias(c) for c in ("below", "whole")))
    got = _ordered(cut, weights, before, _scored, block, blocks)
    both = totals.join(got.select("model", "range", "block", F.col("a").alias("area"), F.col("b").alias("steps")), ["model", "range", "block"])
    each = both.select("model", (F.col("block") * block).alias("first"), F.posexplode(F.arrays_zip("a", "b", "area", "steps")).alias("at", "x")).withColumn("replicate", (F.col("first") + F.col("at")).cast("bigint"))
    ordered = each.where(F.col("replicate") < replicates).groupBy("replicate", "model").agg(*(F.sum(f"x.{c}").alias(c) for c in ("a", "b", "area", "steps")))
    ordered = ordered.where(F.col("a") + F.col("b") > 0).select("replicate", "model", F.try_divide("area", F.col("a") * F.col("b")).alias("auc"), F.try_divide("steps", "b").alias("average_precision"))
    return ordered.join(_loss_replicates(cells, key, replicates, seed), ["replicate", "model"]).withColumnRenamed("model", models)


def _few_scores(cells: DataFrame, scores: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, model, auc, average_precision, log_loss, brier): the weights of each score, summed over clusters as a product of matrices."""
    spark, found = cells.sparkSession, [tuple(r) for r in scores.collect()]
    place = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "s int, model string, y int, p double"))
    own = cells.join(place, ["model", "y", "p"]).groupBy("key").agg(F.collect_list(F.struct("s", "n")).alias("e")).select("key", _field("e", "s").alias("s"), _field("e", "n").alias("n"))
    ship(spark)
    sums = own.join(weight_arrays(cells, "key", replicates, seed, replicates), "key").select("s", "n", "at", "weight").mapInArrow(_product(len(found), replicates), "s int, w array<double>")
    flat = sums.select("s", F.posexplode("w").alias("replicate", "w")).where("w > 0").groupBy("s", "replicate").agg(F.sum("w").alias("w"))
    rows = flat.join(place, "s").select(F.col("replicate").cast("bigint").alias("replicate"), "model", "y", "p", "w")
    return metrics.all_metrics(rows, ["replicate", "model"]).select("replicate", "model", "auc", "average_precision", "log_loss", "brier")


def _product(scores: int, replicates: int):
    """A function for ``mapInArrow`` over clusters (s, n, at, weight): of each score, its rows' weights in all replicates."""

    def dense(part: pa.RecordBatch, places: str, values: str, width: int) -> np.ndarray:
        out, column = np.zeros((part.num_rows, width)), part.column(places)
        row = np.repeat(np.arange(part.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
        out[row, column.flatten().to_numpy(zero_copy_only=False)] = part.column(values).flatten().to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CLUSTERS):
                part = batch.slice(at, CLUSTERS)
                own = dense(part, "s", "n", scores).T @ dense(part, "at", "weight", replicates)
                total = own if total is None else np.add(total, own, out=total)
        for s in range(0, scores if total is not None else 0, CLUSTERS):
            rows = total[s : s + CLUSTERS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(rows), dtype=np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], ["s", "w"])

    return run


def _loss_replicates(cells: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, model, log_loss, brier) from each cluster's sums."""
    q, y, n = clip_p(F.col("p"), CLIP), F.col("y"), F.col("n")
    stats = cells.groupBy("key", "model").agg(F.sum(n).alias("n"), F.sum(-n * (y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log"), F.sum(n * F.pow(q - y, F.lit(2))).alias("square"))
    return ratio_replicates(stats, "key", {"log_loss": ("log", "n", 1.0), "brier": ("square", "n", 1.0)}, replicates, seed, ["model"])


def paired_differences(reps: DataFrame, full: str, models: str = "model") -> DataFrame:
    """Differences under the same draw, positive where the full model is better.

    Replicates with one class alone, whose area is null, are skipped.
    """
    names = ("auc", "average_precision", "log_loss", "brier")
    ref = reps.where(F.col(models) == full).select("replicate", *(F.col(n).alias(f"__{n}") for n in names))
    both = reps.where(F.col(models) != full).join(ref, "replicate").where(F.col("auc").isNotNull() & F.col("__auc").isNotNull())
    up, down = ((F.col(f"__{n}") - F.col(n)).alias(n) for n in names[:2]), ((F.col(n) - F.col(f"__{n}")).alias(n) for n in names[2:])
    return both.select("replicate", F.col(models).alias("comparator"), *up, *down)


def permutation_importance(df: DataFrame, score, key: str, id_col: str, groups: dict[str, list[str]], repeats: int, seed: int, y: str = "y", largest: int = LARGEST) -> DataFrame:
    """(feature_group, repeat, deltas) when a group's columns are dealt anew together inside a cluster.

    ``score`` makes the probability Column of a frame's columns. Rows meet once, by cluster, and a task deals all
    repeats of its clusters one after another, so no row is shuffled once a repeat, and all groups share a
    repeat's order. Clusters of more than ``largest`` rows are not held by a task: windows order them.
    """
    base = metrics.all_metrics(df.select(F.col(y).alias("y"), score().alias("p"), F.lit(1.0).alias("w")), [])
    big = [r[0] for r in df.groupBy(key).count().where(F.col("count") > largest).select(key).collect()]
    large = reduce(lambda a, b: a | b, (F.col(key).eqNullSafe(F.lit(k)) for k in big), F.lit(False))

    def scored(rows: DataFrame, name: Column) -> DataFrame:
        return rows.select(name.alias("feature_group"), "repeat", F.col(y).alias("y"), score().alias("p"), F.lit(1.0).alias("w"))

    moved = df.where(~large & F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, id_col)
    kinds = StructType([StructField("feature_group", IntegerType()), StructField("repeat", IntegerType()), *df.schema.fields])
    ship(df.sparkSession)
    out = scored(moved.mapInArrow(_dealt(key, id_col, groups, repeats, seed, [f.name for f in df.schema.fields]), kinds), F.col("feature_group"))
    if big:
        every = df.where(large).crossJoin(df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("repeat")))
        for g, columns in enumerate(groups.values()):
            out = out.unionByName(scored(windows.permuted(every, [key, "repeat"], id_col, columns, F.lit(seed) + F.col("repeat")), F.lit(g)))
    got = metrics.all_metrics(out, ["feature_group", "repeat"])
    names = ("log_loss", "brier", "auc", "average_precision")
    base = base.select(*(F.col(n).alias(f"__{n}") for n in names))
    return got.crossJoin(F.broadcast(base)).select(F.array(*map(F.lit, groups))[F.col("feature_group")].alias("feature_group"), "repeat", *((F.col(n) - F.col(f"__{n}")).alias(f"{n}_delta") for n in names))


def _dealt(key: str, id_col: str, groups: dict[str, list[str]], repeats: int, seed: int, names: list[str]):
    """A function for ``mapInArrow`` over rows by (key, id): each group's rows of each repeat, its columns dealt anew in each cluster.

    The order is that of ``windows.permuted``: by the hash of (seed + repeat, id), then by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cluster in _whole_clusters(batches, key):
            ids = [str(i).encode() for i in rows.column(id_col).to_pylist()]
            n = len(ids)
            for r in range(repeats):
                head = hashlib.sha256(f"{seed + r}|".encode())
                digests = []
                for i in ids:
                    h = head.copy()
                    h.update(i)
                    digests.append(h.digest())
                words = np.frombuffer(b"".join(digests), ">u8").reshape(n, 4)
                order = pa.array(np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0], cluster)))
                for g, columns in enumerate(groups.values()):
                    own = [rows.column(c).take(order) if c in columns else rows.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x, np.int32)) for x in (g, r)), *own], ["feature_group", "repeat", *names])

    return run


def _whole_clusters(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole clusters, which come one after another, with each row's cluster as a number."""
    held: list[pa.RecordBatch] = []

    def numbered_rows(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        code = rows.column(key).dictionary_encode().indices
        return rows, code.to_numpy(zero_copy_only=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = len(keys) - 1  # first row of the last cluster
        end = keys[last]
        while last and keys[last - 1] == end:
            last -= 1
        if last:
            yield numbered_rows([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(key)[0] != end:
            yield numbered_rows(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield numbered_rows(held)


def hashed_share(seed: Column, key: Column) -> Column:
    """A number from 0 to 1 that a seed and a key decide."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed.cast("string"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def grouped_split(df: DataFrame, key: str, fraction: float, seed: int) -> Column:
    """Whether a row's whole cluster falls in a hashed fraction of clusters."""
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return head < int(fraction * (1 << 32))
