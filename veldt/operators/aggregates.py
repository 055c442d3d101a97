"""Summaries of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators import windows
from veldt.operators.relational import small


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: all rows, and those of each condition (A1)."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def histogram(df: DataFrame, *columns: str, missing: str = "<NA>") -> DataFrame:
    """Counts of values or of combinations; null is shown (A4, A5)."""
    return df.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns)).agg(F.count(F.lit(1)).alias("n"))


def success_table(df: DataFrame, by: list[str], success: Column) -> DataFrame:
    """Successes, failures and failure rate."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("successes"))
    return out.withColumn("failures", F.col("n") - F.col("successes")).withColumn("failure_rate", F.col("failures") / F.col("n"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, share): null or blank."""
    sums = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in columns))
    return sums.unpivot("__n", columns, "column", "n_missing").select("column", "n_missing", F.try_divide("n_missing", "__n").alias("share"))


SUMMED = ("expected_success_value", "expected_failure_cost", "expected_net_value", "realized_value", "execution_residual")


def value_summary(df: DataFrame, by: list[str], match: str = "match_id", p: str = "p", won: str = "won") -> DataFrame:
    """Rows, distinct matches, rates, totals and totals per 100."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_passes"), F.count_distinct(match).alias("n_matches"), F.avg(won).alias("actual_completion_rate"), F.avg(p).alias("mean_xpass"),
        *(F.sum(F.col(c).cast("double")).alias(f"total_{c}") for c in SUMMED),
    )
    return out.select("*", *((100 * F.col(f"total_{c}") / F.col("n_passes")).alias(f"{c}_per_100") for c in SUMMED))


def match_statistics(df: DataFrame, match: list[str], sums: list[str]) -> DataFrame:
    """The sufficient statistics of a match: rows, and sums (A2, A10). All resampling starts from them."""
    return df.groupBy(*match).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(c) for c in sums))


def first_row(df: DataFrame, match: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Attributes of the first row of each match, by an explicit order (A3)."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("__first")
    return df.groupBy(*match).agg(first).select(*match, *(F.col(f"__first.{c}").alias(c) for c in columns))


def zero_filled(df: DataFrame, match: str, category: str, sums: list[str]) -> DataFrame:
    """A row for every match and category, zeros where there are no rows."""
    grid = df.select(match).distinct().crossJoin(small(df.select(category).distinct()))
    return grid.join(match_statistics(df, [match, category], sums), [match, category], "left").na.fill(0, ["n", *sums])


def shares(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Share of rows that meet each condition."""
    return df.groupBy(*by).agg(*(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in conditions.items()))


def describe(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, mean, median, sample deviation, quartiles, 95th percentile, extremes; exact."""
    c, by = F.col(value), list(by)
    sums = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"))
    found = windows.exact_quantiles(df, value, [0.5, 0.25, 0.75, 0.95], by, "__q")
    q = {k: F.col("__q")[i].alias(k) for i, k in enumerate(("median", "p25", "p75", "p95"))}
    return windows.matched(sums, found, by, "left").select(*by, "n", "mean", q["median"], "sd", q["p25"], q["p75"], q["p95"], "min", "max")


def ordered_text(value: str, order: list[str], separator: str) -> Column:
    """Values joined in an explicit order."""
    fields = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), F.col(value).alias("v"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(fields)), lambda s: s["v"]), separator)


def largest_difference(a: Column, b: Column) -> Column:
    return F.coalesce(F.max(F.abs(a - b)), F.lit(0.0))


def weighted_median(df: DataFrame, value: str, weight: str, by: list[str] = ()) -> DataFrame:
    """The first value whose running weight reaches half of the total.

    Rows with missing values or weights, and with no positive weight, are left out.
    """
    by = list(by)
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(weight) > 0))
    cells = windows.once(ok.groupBy(*by, value).agg(F.sum(weight).alias("__w")))
    whole = cells.groupBy(*by).agg(F.sum("__w").alias("__all"))
    run = windows.matched(windows.running_sums(cells, by, value, ["__w"]), whole, by)
    return run.where(F.col("__w__run") >= F.col("__all") / 2).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation; null with fewer than three rows or a constant column.

    Both columns are ranked together, from one table of how often each pair of values occurs.
    """
    by, n = list(by), F.col("__n")
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = windows.once(ok.groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__n")))
    both = F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"__{side}").cast("double").alias("value")) for side in "xy"))
    long = cells.select(*by, "__n", F.inline(both)).groupBy(*by, "side", "value").agg(F.sum("__n").alias("__n"))
    place = windows.once(windows.running_sums(long, [*by, "side"], "value", ["__n"]).select(*by, "side", "value", (F.col("__n__run") - (n - 1) / 2).alias("rank")))
    ranked = cells
    for side in "xy":
        own = place.where(F.col("side") == side).select(*by, F.col("value").alias(f"__{side}v"), F.col("rank").alias(f"__r{side}"))
        ranked = windows.matched(ranked.withColumn(f"__{side}v", F.col(f"__{side}").cast("double")), own, [*by, f"__{side}v"])
    rx, ry = F.col("__rx"), F.col("__ry")
    sums = ranked.groupBy(*by).agg(F.sum(n).alias("n"), F.count_distinct("__x").alias("__dx"), F.count_distinct("__y").alias("__dy"), *(F.sum(n * c).alias(k) for k, c in (("sx", rx), ("sy", ry), ("sxx", rx * rx), ("syy", ry * ry), ("sxy", rx * ry))))
    top, below = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")), F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    return sums.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("__dx") > 1) & (F.col("__dy") > 1), F.try_divide(top, below)).alias("spearman"))


def constant_per(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Groups in which the column has several values."""
    return df.groupBy(*group).agg(F.count_distinct(column).alias("values")).where("values > 1")


def replicate_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median, deviation, 95% interval and share above 0 over replicates."""
    c = F.col(value)
    return df.groupBy(*by).agg(
        F.count(c).alias("replicates"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.stddev_samp(c).alias("sd"),
        F.percentile(c, 0.025).alias("low"), F.percentile(c, 0.975).alias("high"), F.avg((c > 0).cast("int")).alias("share_positive"),
    )
