"""Filters, joins, set operations, reshaping, ordering and selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt.operators import checks, windows
from veldt.session import checkpointed

SMALL_BYTES = 64 << 20  # a side is broadcast only if it is measured to be smaller
PAIR_TASKS = 4000  # of a join of blocks, at most


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A broadcast hint for ``df`` if its rows, as JSON, are few bytes; else ``df`` as it is."""
    bytes_ = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(1)
    sizes = df.select(F.coalesce(bytes_, F.lit(1)).alias("b"))
    return F.broadcast(df) if (sizes.agg(F.sum("b")).first()[0] or 0) <= most else df


def exclude(df: DataFrame, *conditions: Column | None) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): rows that meet all given conditions are excluded; without any, none are."""
    given = [F.coalesce(c, F.lit(False)) for c in conditions if c is not None]
    if not given:
        return df, df.where(F.lit(False))
    every = reduce(lambda a, b: a & b, given)
    return df.where(~every), df.where(every)


def finite(*columns: str) -> Column:
    """No null, NaN or infinity in any column."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in columns))


def tail(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """Rows at or above the column's own (1 - fraction) quantile (F8).

    The exact quantile is one aggregate row, crossed back.
    """
    edge = windows.exact_quantiles(df, column, [1.0 - fraction], name="__edge")
    return df.crossJoin(F.broadcast(edge)).where(F.col(column) >= F.col("__edge")[0]).drop("__edge")


def eligible(df: DataFrame, n: str, matches: str, name: str, min_n: int, min_matches: int) -> Column:
    """Enough rows, enough matches and a known name."""
    return (F.col(n) >= min_n) & (F.col(matches) >= min_matches) & ~F.trim(F.coalesce(F.col(name), F.lit(""))).isin("", "Unknown")


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], defaults: Mapping[str, object] | None = None, required: str | None = None) -> DataFrame:
    """Left join to a small keyed table with defaults; ``required``: an unmatched row is an error."""
    out = df.join(small(checks.require_unique(table, *keys)), keys, "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    if required:
        out = out.withColumn(required, F.when(F.col(required).isNotNull(), F.col(required)).otherwise(F.raise_error(F.lit(f"no {required} for a row")).cast(dict(out.dtypes)[required])))
    return out


def full_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with ``_side``: both, left_only or right_only."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full_outer").withColumn("_side", side).drop("__l", "__r")


def own_team(rows: DataFrame, aliases: DataFrame, cohort: str, team: str) -> DataFrame:
    """Rows whose team is an alias that their own cohort lists; letters and digits are compared alone.

    ``aliases`` has rows (cohort, alias).
    """
    from veldt.functions.scalars import bare_key

    wanted = aliases.select(F.col("cohort").alias("__cohort"), bare_key(F.col("alias")).alias("__alias")).distinct()
    return rows.join(wanted, (rows[cohort] == wanted["__cohort"]) & (bare_key(rows[team]) == wanted["__alias"]), "left_semi")


def compare_slices(df: DataFrame, tag: str, reference: object, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of every other slice beside the reference slice's rows of the same keys."""
    ref = df.where(F.col(tag) == reference).select(*keys, *(F.col(v).alias(f"{v}_reference") for v in values))
    return df.where(F.col(tag) != reference).select(*keys, tag, *values).join(ref, keys)


def select_by_spec(rows: DataFrame, specs: DataFrame, condition: Column) -> DataFrame:
    """Rows by the specifications that they meet; the few specifications are broadcast."""
    return rows.join(F.broadcast(checks_rows(specs, 10_000)), condition)


def checks_rows(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise checks.IntegrityError(f"more than {most} rows")
    return df


def pairs_within(df: DataFrame, group: str, apart: str, order: list[str], zscored: list[str], most: int | None = None, block: int = 2000) -> DataFrame:
    """Unordered pairs of a group's rows that differ in ``apart``, with their profile distance.

    Columns of the two sides begin with ``left_`` and ``right_``; the left row is the earlier in
    ``order``, which is total in a group. Each variable is standardised in its group by the population
    deviation; a constant one counts 0. All pairs of a group are made, the square of its rows: use
    ``caliper_pairs`` where calipers bound them, or have more than ``most`` in all groups be an error. A
    large group is dealt into blocks of about ``block`` rows, and a task joins two blocks of it.
    """
    count = F.count(F.lit(1))
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(count.alias("n"), (count * (count - 1) / 2).alias("pairs"))
    groups, largest, pairs = sizes.agg(count, F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    if most is not None and pairs > most:
        raise checks.IntegrityError(f"{pairs:.0f} pairs, more than {most}")
    left, right = _sides(df, group, zscored)
    blocks = -(-largest // block)
    if blocks <= 1:
        return _paired(left, right, [group], group, apart, order, zscored)
    own = {side: F.pmod(F.xxhash64(*(f"{side}_{c}" for c in order)), F.lit(blocks)) for side in ("left", "right")}
    every, on = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), [group, "__i", "__j"]
    parts = min(groups * blocks * blocks, PAIR_TASKS)
    left = left.withColumn("__i", own["left"]).withColumn("__j", every).repartition(parts, *on)
    right = right.withColumn("__j", own["right"]).withColumn("__i", every).repartition(parts, *on)
    return _paired(left, right, on, group, apart, order, zscored)


def _sides(df: DataFrame, group: str, zscored: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with standardised variables, named for the left and the right side; moments are one row a group."""
    moments = df.groupBy(group).agg(*(f(c).alias(f"__{k}_{c}") for c in zscored for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = df.join(moments, group).select(*df.columns, *(F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0).alias(f"__z_{c}") for c in zscored))
    return tuple(z.select(F.col(group), *(F.col(c).alias(f"{side}_{c}") for c in z.columns if c != group)) for side in ("left", "right"))


def _paired(left: DataFrame, right: DataFrame, on: list[str], group: str, apart: str, order: list[str], zscored: list[str]) -> DataFrame:
    first = F.struct(*(f"left_{c}" for c in order)) < F.struct(*(f"right_{c}" for c in order))
    out = left.join(right, on).where(first & (F.col(f"left_{apart}") != F.col(f"right_{apart}")))
    square = reduce(lambda x, y: x + y, (F.pow(F.col(f"left___z_{c}") - F.col(f"right___z_{c}"), F.lit(2)) for c in zscored))
    return out.withColumn("profile_distance", F.sqrt(square)).drop(*(c for c in out.columns if "___" in c or c.startswith("__")))


def caliper_pairs(df: DataFrame, group: str, apart: str, order: list[str], zscored: list[str], absolute: Mapping[str, float], relative: Mapping[str, float] | None = None) -> DataFrame:
    """The pairs of ``pairs_within`` whose variables are no further apart than their calipers.

    ``absolute`` bounds the difference of a variable, ``relative`` the difference over the mean of the two
    values, which must have a positive mean. Rows are laid on a grid of the calipers, and only rows of the same
    or neighbouring cells meet, so the pairs that are made grow with those that qualify and not with the
    square of a group. Moments are those of the whole group. A null or NaN variable qualifies with
    nothing, nor does a row without a group.
    """
    relative = relative or {}
    if not absolute and not relative:
        raise ValueError("a caliper is needed")
    given = [*absolute, *relative]
    left, right = _sides(df, group, zscored)
    known = {side: reduce(lambda a, b: a & b, (F.col(f"{side}_{c}").isNotNull() & ~F.isnan(F.col(f"{side}_{c}").cast("double")) for c in given)) for side in ("left", "right")}
    cells = [_cell(c, k, False) for c, k in absolute.items()] + [_cell(c, k, True) for c, k in relative.items() if k < 2]
    names = [f"__cell{i}" for i in range(len(cells))]
    left = left.where(known["left"]).withColumns({n: cell("left") for n, cell in zip(names, cells)})
    right = right.where(known["right"])
    for n, cell in zip(names, cells):  # a row of the right side lies in its own cell and in those beside it
        at = cell("right")
        right = right.withColumn(n, F.explode(F.array(at - 1, at, at + 1)))
    out = _paired(left, right, [group, *names], group, apart, order, zscored)
    for c, k in absolute.items():
        out = out.where(F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) <= k)
    for c, k in relative.items():
        mean = (F.col(f"left_{c}") + F.col(f"right_{c}")) * 0.5
        out = out.where((mean > 0) & (F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) / mean <= k))
    return out


#: Cells are wider than their caliper by this share, so that rounding can not put two rows at its end two cells apart.
_WIDER = 1 + 1e-6


def _cell(column: str, caliper: float, relative: bool) -> Callable[[str], Column]:
    """Number of the cell of a side's value; cells of a relative caliper are even in the logarithm.

    Values of 0 or less have no cell: they are 2 apart relatively at least, or have no positive mean.
    """
    if caliper < 0:
        raise ValueError("a caliper is 0 or more")

    def at(side: str) -> Column:
        value = F.col(f"{side}_{column}").cast("double")
        if not relative:
            return F.floor(value / (caliper * _WIDER)) if caliper else F.xxhash64(value + 0.0)
        width = math.log((2 + caliper) / (2 - caliper)) * _WIDER or 1e-9
        return F.when(value > 0, F.floor(F.log(value) / width))

    return at


def zscore(column: str, window) -> Column:
    """Population z-score over a window, 0 where the deviation is 0."""
    sd = F.stddev_pop(column).over(window)
    return F.when(sd > 0, (F.col(column) - F.avg(column).over(window)) / sd).otherwise(0.0)


def greedy_pairs(pairs: DataFrame, most: int, once: str, parties: Iterable[str], order: list[Column]) -> DataFrame:
    """Take pairs in order, each if its ``once`` value and its parties are all unused, ``most`` at most (K7).

    The order must be total. A pair that comes first among all that share its ``once`` value or one of its
    parties is taken by the scan in order, whatever else it takes: so a round takes all such pairs at
    once, removes what they exclude, and the rounds together take exactly what the scan takes. A null
    ``once`` value or party is a value like others.
    """
    names, kept = list(parties), pairs.columns
    entry = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in (("once", once), *(("party", p) for p in names))]
    left = checkpointed(pairs.withColumn("__pair", F.monotonically_increasing_id()).withColumn("__keys", F.array_distinct(F.array(*entry))))
    chosen = left.limit(0)
    while not left.isEmpty():
        each = left.withColumn("__key", F.explode("__keys"))
        first = each.withColumn("__rn", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).where("__rn = 1")
        best = checkpointed(first.groupBy("__pair").agg(F.count(F.lit(1)).alias("__n"), F.first("__keys").alias("__own")).where(F.col("__n") == F.size("__own")).select("__pair", "__own"))
        chosen = checkpointed(chosen.unionByName(left.join(best, "__pair", "left_semi")))
        used = best.select(F.explode("__own").alias("__key")).distinct()
        gone = each.join(used, "__key", "left_semi").select("__pair").distinct()
        left = checkpointed(left.join(gone, "__pair", "left_anti"))
    numbered = chosen.orderBy(*order).limit(most).withColumn("selected_pair", F.row_number().over(Window.orderBy(*order)))
    return numbered.select(*kept, "selected_pair")


def greedy_widest_pairs(df: DataFrame, group: str, apart: str, order: list[str], zscored: list[str], value: str, caliper: float, most: int, band: int = 2_000_000) -> DataFrame:
    """``greedy_pairs`` of the ``caliper_pairs`` of one variable, each group and row once, the pairs furthest ``apart`` in it first (K7).

    Ties go by profile distance, then by the keys of both rows. Pairs are made in bands from the caliper down: all of a
    band come before those of the next, so no more bands are made than the scan takes pairs from. The first is as wide as
    holds about ``band`` pairs of even values, each further one twice as wide as the one before.
    """
    parties, rank = [f"{side}_{c}" for side in ("left", "right") for c in order], [F.desc("apart"), F.col("profile_distance")]
    rank += [F.col(c) for c in parties]
    distance = F.abs(F.col(f"left_{value}") - F.col(f"right_{value}"))
    (n,) = df.groupBy(group).agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("n")).agg(F.sum("n")).first()
    if caliper <= 0 or (n or 0) <= band:
        own = caliper_pairs(df, group, apart, order, zscored, {value: caliper}).withColumn("apart", distance)
        return _greedy_once(own, most, group, order, rank)
    left, right = (side.where(finite(f"{name}_{value}")) for name, side in zip(("left", "right"), _sides(df, group, zscored)))
    high, width, taken, out = float(caliper), caliper * band / n, 0, None
    while high > 0 and taken < most:
        low = max(0.0, high - width)
        inside = distance <= high
        own = _band(left, right, group, apart, order, zscored, value, low, high).withColumn("apart", distance)
        got = checkpointed(_greedy_once(own.where(inside & (distance > low) if low else inside), most - taken, group, order, rank))
        found = got.count()
        if found:
            moved = got.withColumn("selected_pair", (F.col("selected_pair") + F.lit(taken)).cast("int"))
            out, taken = moved if out is None else out.unionByName(moved), taken + found
            used = union_all(*(got.select(*(F.col(f"{side}_{c}").alias(c) for c in order)) for side in ("left", "right")))
            left, right = (_unused(side, name, got, used, group, order) for name, side in (("left", left), ("right", right)))
        high, width = low, 2 * width
    return got if out is None else out


def _greedy_once(pairs: DataFrame, most: int, group: str, order: list[str], rank: list[Column]) -> DataFrame:
    """``greedy_pairs`` whose parties are rows, named by all their keys together."""
    names = {f"__{side}": F.to_json(F.array(*(F.col(f"{side}_{c}").cast("string") for c in order))) for side in ("left", "right")}
    return greedy_pairs(pairs.withColumns(names), most, group, list(names), rank).drop(*names)


def _unused(rows: DataFrame, side: str, chosen: DataFrame, used: DataFrame, group: str, order: list[str]) -> DataFrame:
    rest = rows.join(F.broadcast(chosen.select(group).distinct()), group, "left_anti")
    keys = used.select(*(F.col(c).alias(f"{side}_{c}") for c in order)).distinct()
    return rest.join(F.broadcast(keys), [f"{side}_{c}" for c in order], "left_anti")


def _band(left: DataFrame, right: DataFrame, group: str, apart: str, order: list[str], zscored: list[str], value: str, low: float, high: float) -> DataFrame:
    """Pairs whose values are about ``low`` to ``high`` apart: rows of the left side lie in a cell, those of the right side in the cells that far above and below."""
    width = (high - low) * _WIDER
    v = F.col(f"right_{value}").cast("double")
    starts = [F.floor(x / width) for x in (v + low, v - high)]
    cells = F.array_distinct(F.array(*(s + i for s in starts for i in (-1, 0, 1, 2))))
    left = left.withColumn("__cell", F.floor(F.col(f"left_{value}").cast("double") / width))
    return _paired(left, right.withColumn("__cell", F.explode(cells)), [group, "__cell"], group, apart, order, zscored)


def top_k(df: DataFrame, k: int, group: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group (K5)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def top_k_overlap(a: DataFrame, b: DataFrame, key: list[str], k: int) -> DataFrame:
    """Share of common keys among two top lists, of the shorter list (K5)."""
    common = a.select(*key).join(b.select(*key), key).agg(F.count(F.lit(1)).alias("common"))
    sizes = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    return common.crossJoin(sizes).select("common", F.try_divide("common", F.least(F.lit(k), "na", "nb")).alias("overlap"))


def best_row(df: DataFrame, *order: Column) -> DataFrame:
    """The first row by a lexicographic order (K6)."""
    return df.orderBy(*order).limit(1)


def by_rank(df: DataFrame, column: str, values: list[str], *then: Column) -> DataFrame:
    """Rows in the order of a list of values, others last, and then in another order (K3)."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), column, *then)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by an explicit order."""
    return top_k(df, 1, keys, order)


def fill_columns(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Exactly these columns, in this order; missing ones are null."""
    return df.select(*(F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def find_column(df: DataFrame, aliases: Iterable[str]) -> str:
    """The column that equals an alias, letters and digits compared alone."""
    import re

    def bare(x: str) -> str:
        return re.sub("[^a-z0-9]+", "", x.lower())

    wanted = [bare(a) for a in aliases]
    found = sorted((wanted.index(bare(c)), c) for c in df.columns if bare(c) in wanted)
    if not found:
        raise checks.IntegrityError(f"no column like {list(aliases)}")
    return found[0][1]


def long_form(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Melt (R2)."""
    return df.unpivot(ids, values, name, value)


def wide_form(df: DataFrame, ids: list[str], column: str, values: list, aggregate: Column) -> DataFrame:
    """Pivot with stated values, so that no pass is spent on finding them."""
    return df.groupBy(*ids).pivot(column, values).agg(aggregate)


def prefixed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})
