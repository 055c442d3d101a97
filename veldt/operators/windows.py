"""Labels, ranks, bins and splits over ordered windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt.session import checkpointed


def forward_label(event: Column, group: list[str], order: list[str], horizon: int) -> Column:
    """Whether the event happens in the row or the next ``horizon`` - 1 rows of its group."""
    if horizon < 1:
        raise ValueError("a horizon is 1 or more")
    return F.max(event).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(0, horizon - 1))


def stage(group: list[str], order: list[str]) -> Column:
    """Place of the row in its group, from 1."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


RANGES = 64  # ranges of values that running sums are cut into


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys meet null keys. Without keys ``right`` is one row."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)
    there = right.withColumnsRenamed({c: f"__of_{c}" for c in by})
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by))
    return left.join(there, met, how).drop(*(f"__of_{c}" for c in by))


def once(df: DataFrame) -> DataFrame:
    """``df`` made once, for plans that read it several times."""
    return df if getattr(df, "is_cut", False) else checkpointed(df)


def running_sums(df: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """``df`` with the sums of each column over the rows up to each row's value of ``order``, as ``<column>__run``.

    Values are distinct in a group; null is a group like others. ``df`` is made once. A group is cut at
    approximate quantiles into ranges, each range is summed by itself, and what lies before it, a
    row for each range, is added: no task orders a whole group. The cuts only decide where the work
    is done, so the sums are exact.
    """
    df, by = once(df), list(by)
    steps = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(order, steps, 1000)).alias("__edges"))
    cut = matched(df, edges, by).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col(order)))).drop("__edges")
    totals = cut.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__{c}") for c in sums))
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = matched(cut.select("*", *(F.sum(c).over(inside).alias(f"{c}__run") for c in sums)), totals, [*by, "__range"])
    return own.select(*df.columns, *((F.col(f"{c}__run") + F.col(f"__{c}")).alias(f"{c}__run") for c in sums))


def positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``__place``, each row's place from 1 in the order of its group, and ``__size``, the group's rows.

    The order is total and of any types; null is a group like others. Rows are dealt by ranges of (group,
    order), so a large group lies in many ranges, each is numbered by itself, and the rows before
    it, a count for each range and group, are added.
    """
    by = list(by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(df.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()))
    counts = cut.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__in"))
    whole = Window.partitionBy(*by)
    counts = counts.select(*by, "__range", (F.sum("__in").over(whole.orderBy("__range")) - F.col("__in")).alias("__ahead"), F.sum("__in").over(whole).alias("__size"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    out = matched(cut.withColumn("__rn", inside), counts, [*by, "__range"])
    return out.select(*df.columns, (F.col("__rn") + F.col("__ahead")).alias("__place"), "__size")


ACCURACY = 10_000  # of the sketches that narrow quantiles down


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] = (), name: str = "quantiles") -> DataFrame:
    """(by, array of quantiles): interpolated between the two values around each rank; null and NaN are left out.

    Two passes, whatever the number of shares and of distinct values. The first makes sketches that give, for
    each share, an interval of values in which its ranks must lie; small groups have their whole range.
    The second counts the rows below each interval and the values inside it, and the ranks are found among
    these few. The sketches' error decides the length of the intervals, never the result.
    """
    by, kinds = list(by), dict(df.dtypes)
    known = df.where(F.col(value).isNotNull() & (~F.isnan(value) if kinds[value] in ("float", "double") else F.lit(True))).select(*by, F.col(value).alias("__v"))
    beside = [[min(max(s + side * 3 / ACCURACY, 0.0), 1.0) for s in shares] for side in (-1, 1)]
    at = F.percentile_approx("__v", F.array(*(F.lit(float(q)) for q in beside[0] + beside[1])), ACCURACY)
    first = once(known.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), at.alias("__at")))
    few = F.col("__all") <= 4 * ACCURACY
    ends = [F.struct(F.lit(i).alias("i"), F.when(few, F.col("__min")).otherwise(F.col("__at")[i]).alias("low"), F.when(few, F.col("__max")).otherwise(F.col("__at")[len(shares) + i]).alias("high")) for i in range(len(shares))]
    placed = matched(known, first.select(*by, F.array(*ends).alias("__ends")), by).select(*by, "__v", F.explode("__ends").alias("e"))
    placed = placed.where(F.col("__v") <= F.col("e.high")).groupBy(*by, F.col("e.i").alias("__i"), F.when(F.col("__v") >= F.col("e.low"), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cells = once(placed)
    below = cells.where("__v IS NULL").select(*by, "__i", F.col("__n").alias("__below"))
    inside = cells.where("__v IS NOT NULL")
    inside.is_cut = True
    run = matched(matched(running_sums(inside, [*by, "__i"], "__v", ["__n"]), below, [*by, "__i"], "left"), first.select(*by, "__all"), by)
    share = F.element_at(F.array(*(F.lit(float(q)) for q in shares)), F.col("__i") + 1)
    rank, end = (F.col("__all") - 1) * share, F.coalesce("__below", F.lit(0)) + F.col("__n__run")
    low, high = (F.max(F.when((end - F.col("__n") <= f(rank)) & (f(rank) < end), F.col("__v"))) for f in (F.floor, F.ceil))
    found = run.groupBy(*by, "__i").agg(low.alias("low"), high.alias("high"), F.first(rank).alias("rank"))
    found = found.select(*by, F.struct("__i", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))).alias("q")).alias("x"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias(name)).where(F.size(name) > 0)


def ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``df`` with the average rank of ``value`` in its group, from counts of distinct values; null has none."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    place = running_sums(counts, by, value, ["__n"]).select(*by, value, (F.col("__n__run") - (F.col("__n") - 1) / 2).alias(name))
    return matched(df, place, [*by, value], "left")


def min_rank(value: str, group: list[str]) -> Column:
    """Rank from the highest, equal values share the best rank; null has none."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(w))


def average_rank(value: str, group: list[str] = (), descending: bool = False) -> Column:
    """Rank with ties averaged; null has none."""
    c = F.col(value)
    w = Window.partitionBy(*group).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return F.when(c.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2)


def ordinal_band(q: int, place: str = "__place", size: str = "__size") -> Column:
    """Equal-frequency band of a row's place in a total order (W5), of rows with ``positions``."""
    share = F.col(place) / F.col(size)
    return F.greatest(F.lit(0), F.least(F.lit(q - 1), F.floor((share - 1e-12) * q))).cast("int")


def allocation(n: Column, shares: dict[str, float]) -> Column:
    """map(name, count) with counts that add up to n, the largest remainders rounded up.

    Equal remainders go to the earlier name.
    """
    names = list(shares)
    whole = [F.floor(n * s + 1e-9) for s in shares.values()]
    rest = [F.round(n * s - w, 9) for s, w in zip(shares.values(), whole)]
    over = n - sum(whole[1:], whole[0])
    out = []
    for i, name in enumerate(names):
        ahead = [(r >= rest[i] if j < i else r > rest[i]).cast("int") for j, r in enumerate(rest) if j != i]
        out += [F.lit(name), (whole[i] + (sum(ahead[1:], ahead[0]) < over).cast("int")).cast("bigint")]
    return F.create_map(*out)


def stratified_split(df: DataFrame, stratum: list[str], key: str, shares: dict[str, float], name: str = "split") -> DataFrame:
    """Rows of each stratum, in the order of ``key``, cut at the allocated counts."""
    counts = allocation(F.col("__size"), shares)
    total, case = F.lit(0).cast("bigint"), None
    for s in list(shares)[:-1]:
        total = total + counts[s]
        case = F.when(F.col("__place") <= total, s) if case is None else case.when(F.col("__place") <= total, s)
    return positions(df, stratum, [key]).withColumn(name, case.otherwise(list(shares)[-1])).drop("__place", "__size")


def round_robin(k: int, place: str = "__place") -> Column:
    """Fold of a row: its place in its stratum modulo k (W7), of rows with ``positions``."""
    return ((F.col(place) - 1) % k).cast("int")


def calibration_pick(fraction: float, place: str = "__place", size: str = "__size") -> Column:
    """The first round(n f) rows of a stratum, 1 at least and n - 1 at most, none if n < 2 (W8), of rows with ``positions``."""
    n = F.col(size)
    take = F.when(n >= 2, F.least(n - 1, F.greatest(F.lit(1), F.bround(n * fraction)))).otherwise(0)
    return F.col(place) <= take


def dominant(df: DataFrame, keys: list[str], category: str, minimum_share: float | None = None, mixed: str = "Mixed role") -> DataFrame:
    """(keys, category, n, share) of each key's most frequent category, ties by name.

    Below ``minimum_share`` the category is ``mixed``.
    """
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("__rn", F.row_number().over(w.orderBy(F.desc("n"), category)))
    out = ranked.where("__rn = 1").drop("__rn")
    return out if minimum_share is None else out.withColumn(category, F.when(F.col("share") >= minimum_share, F.col(category)).otherwise(mixed))


def quantile_bins(df: DataFrame, value: str, q: int, name: str = "bin") -> DataFrame:
    """Equal-frequency bins by interpolated quantile edges; ties stay together.

    The edges are one exact aggregate, crossed back; repeated edges fall to one.
    """
    edges = exact_quantiles(df, value, [i / q for i in range(q + 1)], name="__edges").withColumn("__edges", F.array_distinct("__edges"))
    at = F.size(F.filter("__edges", lambda e: e < F.col(value))) - 1
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(F.lit(0), at))).drop("__edges")


def right_closed_bin(p: Column, n: int) -> Column:
    """Bin i holds i/n < p <= (i+1)/n; p is first clipped to [0, 1]."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(F.round(p * n, 9)) - 1)).cast("int")


def left_closed_bin(p: Column, n: int) -> Column:
    """Bin i holds i/n <= p < (i+1)/n; 1 falls in the last."""
    return F.least(F.floor(F.round(p * n, 9)), F.lit(n - 1)).cast("int")


def permuted(df: DataFrame, group: list[str], id_col: str, columns: list[str], seed: int | Column) -> DataFrame:
    """The columns' values are dealt anew together inside each group, by a salted hash."""
    w = Window.partitionBy(*group)
    salt = F.sha2(F.concat_ws("|", F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string"), F.col(id_col).cast("string")), 256)
    left = df.drop(*columns).withColumn("__rn", F.row_number().over(w.orderBy(id_col)))
    right = df.select(*group, *columns, F.row_number().over(w.orderBy(salt, id_col)).alias("__rn"))
    return left.join(right, [*group, "__rn"]).drop("__rn").select(*df.columns)
