"""Integrity constraints as DataFrames and as gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class IntegrityError(RuntimeError):
    """A declared property of the data does not hold."""


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if duplicates(df, *keys).limit(1).count():
        raise IntegrityError(f"repeated keys in {keys}")
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any data is read."""
    if missing := sorted(set(names) - set(df.columns)):
        raise IntegrityError(f"missing columns: {', '.join(missing)}")
    return df


def unmatched(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def require_complete(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    if unmatched(left, right, *keys).limit(1).count():
        raise IntegrityError(f"rows without a partner by {keys}")
    return left


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "m:m", complete: bool = False) -> DataFrame:
    """A join whose cardinality is declared: ``1:1``, ``1:m``, ``m:1`` or ``m:m``; ``complete``: every left row has a partner.

    The join's own job counts the rows of each key and looks for partners, so there is no other pass over
    either side; what does not hold is an error of that job, before anything is written. The counts are
    made on the partitioning that the join needs.
    """
    one_left, one_right = validate.split(":")
    left, right = (_once_a_key(df, keys, side) if one == "1" else df for df, one, side in ((left, one_left, "left"), (right, one_right, "right")))
    if not complete:
        return left.join(right, keys, how)
    if how not in ("inner", "left"):
        raise ValueError("a complete join is inner or left")
    out = left.join(right.withColumn("__met", F.lit(True)), keys, "left")
    return out.where(_unless(F.col("__met").isNull(), f"rows without a partner by {keys}")).drop("__met")


def _once_a_key(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(_unless(F.col("__n") > 1, f"repeated keys in {keys} on the {side}")).drop("__n")


def _unless(bad: Column, message: str) -> Column:
    """True, or an error of the task; ``rand`` keeps the optimizer from trying it on made-up rows."""
    return F.when(bad & (F.rand(0) >= 0), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)


def missing(df: DataFrame, *columns: str) -> DataFrame:
    """One row: nulls and NaNs of each column (C4)."""
    kinds = dict(df.dtypes)

    def bad(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if kinds[c] in ("float", "double") else F.col(c).isNull()

    return df.agg(*(F.count_if(bad(c)).alias(c) for c in columns))


def violations(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: rows for which each condition is not true."""
    return df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()))


def one_role_per_fold(roles: DataFrame, fold: str, match: str, role: str, holdout: str) -> DataFrame:
    """One row of counts that must all be 0: repeated (fold, match), matches not held out just once."""
    twice = roles.groupBy(fold, match).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") != 1).alias("repeated_roles"))
    held = roles.groupBy(match).agg(F.count_if(F.col(role) == holdout).alias("n")).agg(F.count_if(F.col("n") != 1).alias("not_held_out_once"))
    return twice.crossJoin(held)


def totals(df: DataFrame, **expected: tuple[Column, float]) -> DataFrame:
    """One row a total: (name, expected, found, same)."""
    found = df.agg(*(c.cast("double").alias(k) for k, (c, _) in expected.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("expected"), F.col(k).alias("found"), (F.col(k) == float(v)).alias("same")) for k, (_, v) in expected.items()))
    return found.select(F.inline(rows))


@dataclass(frozen=True)
class Audit:
    status: str
    checks: dict[str, bool]

    def gate(self) -> Audit:
        if self.status == "FAIL":
            raise IntegrityError(f"failed: {', '.join(k for k, v in self.checks.items() if not v)}")
        return self


def audit(checks: dict[str, bool], review: set[str] = frozenset()) -> Audit:
    """PASS, FAIL, or REVIEW_REQUIRED where only checks of the review set fail."""
    failed = {k for k, v in checks.items() if not v}
    status = "PASS" if not failed else "REVIEW_REQUIRED" if failed <= set(review) else "FAIL"
    return Audit(status, dict(checks))
