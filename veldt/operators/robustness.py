"""Specifications, their comparison, cohort profiles, and audits across grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldt.functions import scalars as S
from veldt.operators import aggregates, relational, resample, windows


def specification(rows: DataFrame, name: str, p: str, start: str, end: str, opponent: str, won: str, keep: list[str], sample: Column | None = None, failure: str | None = None) -> DataFrame:
    """Values recomputed in double precision for one choice of probability, sample and failure cost (P25)."""
    own = rows if sample is None else rows.where(sample)
    value = S.pass_value(F.col(p), F.col(start), F.col(end), F.col(opponent), F.col(won), "double")
    if failure:
        cost = F.col(failure).cast("double")
        lost = ((1 - F.col(p)) * cost).cast("double")
        value |= {"cost": cost, "expected_failure_cost": lost, "expected_net_value": value["expected_success_value"] - lost, "realized_value": F.when(F.col(won) == 1, value["gain"]).otherwise(-cost)}
    return own.select(F.lit(name).alias("specification"), *keep, F.col(won).alias("won"), F.col(p).alias("p"), *(c.alias(k) for k, c in value.items()))


def compare_players(table: DataFrame, tag: str, reference: str, keys: list[str], decision: str, execution: str, top: int) -> DataFrame:
    """Rank correlations, quadrant agreement and top-list overlaps against the reference.

    Null where fewer than three players are common.
    """
    both = windows.once(relational.compare_slices(table, tag, reference, keys, [decision, execution]))
    w = Window.partitionBy(tag)
    d, e = F.col(decision), F.col(execution)
    rd, re = F.col(f"{decision}_reference"), F.col(f"{execution}_reference")
    same = (S.quadrant(d, e) == S.quadrant(rd, re)).cast("int")
    marked = both.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__same", same)
    for name, c in (("__d", decision), ("__dr", f"{decision}_reference"), ("__e", execution), ("__er", f"{execution}_reference")):
        marked = marked.withColumn(name, F.row_number().over(w.orderBy(F.desc(c), *keys)))
    base = marked.groupBy(tag).agg(
        F.first("__n").alias("common_players"), F.avg("__same").alias("quadrant_agreement"),
        (F.count_if((F.col("__d") <= top) & (F.col("__dr") <= top)) / F.least(F.lit(top), F.first("__n"))).alias("decision_top_overlap"),
        (F.count_if((F.col("__e") <= top) & (F.col("__er") <= top)) / F.least(F.lit(top), F.first("__n"))).alias("execution_top_overlap"),
    )
    for name, c in (("decision_spearman", decision), ("execution_spearman", execution)):
        base = windows.matched(base, aggregates.spearman(both, c, f"{c}_reference", [tag]).select(tag, F.col("spearman").alias(name)), [tag])
    few = F.col("common_players") < 3
    return base.select(tag, "common_players", *(F.when(~few, F.col(c)).alias(c) for c in base.columns if c not in (tag, "common_players")))


def oriented_pairs(pairs: DataFrame, table: DataFrame, tag: str, reference: str, value: str, eligible: str) -> DataFrame:
    """Pairs by specification, the higher player of the reference first.

    A pair is estimable if both players are eligible; the direction is null if it is not.
    """
    ref = table.where(F.col(tag) == reference).select("player", F.col(value).alias("__v"))
    a = pairs.join(ref.withColumnsRenamed({"player": "left_player", "__v": "__a"}), "left_player").join(ref.withColumnsRenamed({"player": "right_player", "__v": "__b"}), "right_player")
    first = F.col("__a") >= F.col("__b")
    turned = a.select(F.when(first, F.col("left_player")).otherwise(F.col("right_player")).alias("high_player"), F.when(first, F.col("right_player")).otherwise(F.col("left_player")).alias("low_player"))
    grid = turned.crossJoin(relational.small(table.select(tag).distinct()))
    for side in ("high", "low"):
        own = table.select(tag, F.col("player").alias(f"{side}_player"), F.col(value).alias(f"{side}_value"), F.col(eligible).alias(f"{side}_eligible"))
        grid = grid.join(own, [tag, f"{side}_player"], "left")
    able = F.coalesce(F.col("high_eligible") & F.col("low_eligible"), F.lit(False))
    return grid.select(tag, "high_player", "low_player", able.alias("estimable"), F.when(able, F.col("high_value") - F.col("low_value")).alias("difference"), F.when(able, F.col("high_value") > F.col("low_value")).alias("same_direction"))


def core_profile(rows: DataFrame, cohort: str, match: str, metrics: dict[str, tuple[Column, Column, float]], replicates: int, seed: int) -> DataFrame:
    """(cohort, metric, estimate, low, high): scaled ratios of sums with match-cluster intervals.

    A share has a condition over 1, a mean its value over 1. All metrics share one pass over the
    rows, one table of match sums and the same draws.
    """
    sums = [f(c.cast("double")).alias(f"{k}{i}") for i, (a, b, _) in enumerate(metrics.values()) for k, c, f in (("a", a, F.sum), ("b", b, F.sum))]
    stats = rows.groupBy(cohort, match).agg(*sums)
    names = {f"v{i}": (f"a{i}", f"b{i}", float(k)) for i, (_, _, k) in enumerate(metrics.values())}
    got = resample.ratio_intervals(stats, match, names, replicates, seed, [cohort])
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"v{i}{s}").alias(n) for s, n in (("", "estimate"), ("_low", "low"), ("_high", "high")))) for i, m in enumerate(metrics)))
    return got.select(cohort, F.inline(cells))


def correlations(table: DataFrame, group: str, variables: list[str], target: str, overall: str = "All roles") -> DataFrame:
    """Rank correlation of each variable with the target, by group and over all."""
    both = table.unionByName(table.withColumn(group, F.lit(overall)))
    long = both.unpivot([group, target], variables, "variable", "value")
    return aggregates.spearman(long, "value", target, [group, "variable"])


def identity_audit(rows: DataFrame, summary: DataFrame, by: list[str], pairs: dict[str, Column], tolerance: float = 1e-10) -> DataFrame:
    """(name, max_abs_difference, ok): a summary against the same figures from its rows."""
    again = rows.groupBy(*by).agg(*(c.alias(f"__{k}") for k, c in pairs.items()))
    both = windows.matched(summary, again, by)
    sums = both.agg(*(aggregates.largest_difference(F.col(k), F.col(f"__{k}")).alias(k) for k in pairs))
    return sums.unpivot([], list(pairs), "name", "max_abs_difference").withColumn("ok", F.col("max_abs_difference") <= tolerance)


def ranked_eligible(table: DataFrame, value: str, group: list[str], eligible: Column, name: str) -> DataFrame:
    """Ranks among eligible rows alone; the others have none."""
    marked = table.withColumn("__v", F.when(eligible, F.col(value)))
    return marked.withColumn(name, windows.min_rank("__v", group)).drop("__v")
