"""Weighted ranking, loss and calibration metrics as aggregations.

Frames are in long form: a label ``y`` (0 or 1), a probability ``p`` of label 1, a weight ``w``, and
any grouping columns, such as the model, the subgroup and the bootstrap replicate. Every metric is
then one grouped aggregation for all models and replicates at once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.scalars import CLIP, clip_p, logit
from veldt.operators import windows

RIDGE = 1e-4  # of the weight, for lines of labels that the predictor separates
LONGEST = 2.0  # step of such a line



def auc(df: DataFrame, by: list[str], score: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Weighted area under the ROC curve, ties count half; null with one class alone.

    Rows are first summed by score, so the running sum is over distinct scores.
    """
    tied = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("__p"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0.0)).alias("__n"))
    below = F.col("__n__run") - F.col("__n")
    out = windows.running_sums(tied, by, score, ["__n"]).withColumn("__u", F.col("__p") * (below + F.col("__n") / 2))
    return out.groupBy(*by).agg(F.try_divide(F.sum("__u"), F.sum("__p") * F.sum("__n")).alias("auc"))


def average_precision(df: DataFrame, by: list[str], p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Step-sum average precision of the failures, scored by 1 - p."""
    tied = df.groupBy(*by, p).agg(F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0.0)).alias("__f"), F.sum(w).alias("__w"))
    out = windows.running_sums(tied, by, p, ["__f", "__w"]).withColumn("__step", F.try_divide(F.col("__f__run"), F.col("__w__run")) * F.col("__f"))
    return out.groupBy(*by).agg(F.try_divide(F.sum("__step"), F.sum("__f")).alias("average_precision"))


def losses(df: DataFrame, by: list[str], p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Weighted log loss and Brier score of the clipped probability."""
    q, own, weight = clip_p(F.col(p), CLIP), F.col(y), F.col(w)
    log = -(own * F.log(q) + (1 - own) * F.log(1 - q))
    return df.groupBy(*by).agg((F.sum(weight * log) / F.sum(weight)).alias("log_loss"), (F.sum(weight * F.pow(q - own, F.lit(2))) / F.sum(weight)).alias("brier"))


def failure_classification(df: DataFrame, by: list[str], p: str = "p", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy, and precision, recall, F1 of failures, 0 where undefined."""
    said, fact = F.col(p) < threshold, F.col(y) == 0
    n = df.groupBy(*by).agg(F.count_if(said & fact).alias("__tp"), F.count_if(said & ~fact).alias("__fp"), F.count_if(~said & fact).alias("__fn"), F.count_if(~said & ~fact).alias("__tn"))
    return n.select(*by, *_classified(*(F.col(f"__{k}") for k in ("tp", "fp", "fn", "tn"))))


def _classified(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return [
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("failure_precision"), ratio(tp, tp + fn).alias("failure_recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("failure_f1"),
    ]


def calibration_line(df: DataFrame, by: list[str], p: str = "p", y: str = "y", w: str = "w", steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """(by, intercept, slope) of the logistic fit of y on logit(p), by Newton steps.

    Rows of one label and probability are summed once; then one aggregation of five sums a step for all
    groups; the groups' lines, a row each, are joined back. A constant predictor has slope 0 and the prevalence's logit. Where the predictor separates the
    labels, or there is one label alone, no line is best: then, and only then, the fit has a ridge of
    ``RIDGE`` times the weight on both numbers, which gives a finite one. A line that has not settled
    after ``steps`` is an error.
    """
    base = df.select(*by, logit(F.col(p)).alias("__x"), F.col(y).cast("double").alias("__y"), F.col(w).cast("double").alias("__w")).where("__w > 0")
    keyed = by or ["__all"]
    base = (base if by else base.withColumn("__all", F.lit(0))).groupBy(*keyed, "__x", "__y").agg(F.sum("__w").alias("__w")).persist()
    ends = [f(F.when(F.col("__y") == k, F.col("__x"))).alias(f"__{n}{k}") for k in (0, 1) for n, f in (("low", F.min), ("high", F.max))]
    first = base.groupBy(*keyed).agg((F.min("__x") == F.max("__x")).alias("__flat"), (F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")).alias("__mean"), F.sum("__w").alias("__total"), *ends)
    line = {tuple(r[k] for k in keyed): r for r in first.collect()}
    fits = {k: (0.0, 1.0) for k, r in line.items() if not r["__flat"]}
    ridge = {k: RIDGE * line[k]["__total"] if _separated(line[k]) else 0.0 for k in fits}
    kinds = dict(base.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keyed] + ["intercept double", "slope double"])
    spark = df.sparkSession
    done: dict = {}
    for _ in range(steps):
        if not fits:
            break
        now = spark.createDataFrame([(*k, *v) for k, v in fits.items()], schema)
        m = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("__x"))))
        rows = windows.matched(base, now, keyed).withColumn("__m", m).withColumn("__v", F.col("__w") * F.col("__m") * (1 - F.col("__m"))).withColumn("__r", F.col("__w") * (F.col("__y") - F.col("__m")))
        sums = rows.groupBy(*keyed).agg(F.sum("__r").alias("g0"), F.sum(F.col("__r") * F.col("__x")).alias("g1"), F.sum("__v").alias("h00"), F.sum(F.col("__v") * F.col("__x")).alias("h01"), F.sum(F.col("__v") * F.col("__x") * F.col("__x")).alias("h11")).collect()
        for r in sums:
            k = tuple(r[c] for c in keyed)
            (a, b), z = fits[k], ridge[k]
            g0, g1, h00, h11 = r["g0"] - z * a, r["g1"] - z * b, r["h00"] + z, r["h11"] + z
            det = h00 * h11 - r["h01"] ** 2
            if det <= 0:
                done[k] = fits.pop(k)
                continue
            da, db = (h11 * g0 - r["h01"] * g1) / det, (h00 * g1 - r["h01"] * g0) / det
            if z:  # far from the optimum the curvature is too small for whole steps
                short = min(1.0, LONGEST / max(abs(da), abs(db), 1e-300))
                da, db = da * short, db * short
            fits[k] = (a + da, b + db)
            if max(abs(da), abs(db)) < tolerance:
                done[k] = fits.pop(k)
    base.unpersist()
    if fits:
        raise ArithmeticError(f"no convergence in {steps} steps for {sorted(map(str, fits))}")

    for k, r in line.items():
        if r["__flat"]:
            q = min(max(r["__mean"], CLIP), 1 - CLIP)
            done[k] = (math.log(q / (1 - q)), 0.0)
    out = spark.createDataFrame([(*k, *v) for k, v in done.items()], schema)
    return out if by else out.drop("__all")


def _separated(r) -> bool:
    """Whether a threshold divides the labels, or there is one label alone."""
    ends = [r[f"__{n}{k}"] for k in (0, 1) for n in ("low", "high")]
    return None in ends or ends[1] <= ends[2] or ends[3] <= ends[0]


def reliability(df: DataFrame, by: list[str], bins: int = 20, p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Right-closed fixed bins; empty ones keep a row of nulls."""
    cells = df.withColumn("bin", windows.right_closed_bin(F.col(p), bins)).groupBy(*by, "bin").agg(F.sum(w).alias("weight"), F.try_divide(F.sum(F.col(w) * F.col(p)), F.sum(w)).alias("mean_p"), F.try_divide(F.sum(F.col(w) * F.col(y)), F.sum(w)).alias("observed"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = cells.select(*by).distinct().crossJoin(F.broadcast(grid))
    return grid.join(cells, [*by, "bin"], "left")


def calibration_error(df: DataFrame, by: list[str], bins: int = 20, closed: str = "right", p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Expected calibration error and largest gap; empty bins are skipped."""
    at = windows.right_closed_bin(F.col(p), bins) if closed == "right" else windows.left_closed_bin(F.col(p), bins)
    cells = df.groupBy(*by, at.alias("__bin")).agg(F.sum(w).alias("__w"), F.abs(F.sum(F.col(w) * F.col(p)) - F.sum(F.col(w) * F.col(y))).alias("__gap"))
    return cells.where("__w > 0").groupBy(*by).agg((F.sum("__gap") / F.sum("__w")).alias("ece"), F.max(F.col("__gap") / F.col("__w")).alias("max_gap"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a rate."""
    rate = successes / n
    centre = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    return centre - half, centre + half


def reliability_wilson(df: DataFrame, by: list[str], bins: int = 10, p: str = "p", y: str = "y", quantile: bool = False) -> DataFrame:
    """Bins with a Wilson interval of the observed rate; empty bins are dropped."""
    binned = windows.quantile_bins(df, p, bins, "bin") if quantile else df.withColumn("bin", windows.right_closed_bin(F.col(p), bins))
    cells = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.sum(y).cast("double").alias("successes"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return cells.select("*", (F.col("successes") / F.col("n")).alias("observed"), low.alias("low"), high.alias("high"))


METRICS = ("log_loss", "brier", "auc", "average_precision", "accuracy", "balanced_accuracy", "failure_precision", "failure_recall", "failure_f1", "ece", "max_gap")


def all_metrics(df: DataFrame, by: list[str], bins: int = 20, p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """Every metric of M10 to M13 and M16 for every group, from one scan."""
    return _from_cells(_cells(df, [by], p, y, w), by, bins).select(*by, *METRICS)


def metric_table(df: DataFrame, model: str = "model", subgroup: str = "subgroup", bins: int = 20, p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """(scope, subgroup, model, metrics): every metric of every model over all rows and in every subgroup.

    One scan gives both, by grouping sets; scope ``overall`` has a null subgroup, and so has the subgroup of
    the rows that have none, in scope ``subgroup``.
    """
    cells = _cells(df, [[model], [model, subgroup]], p, y, w)
    scope = F.when(F.col("__set") == 0, "overall").otherwise("subgroup")
    return _from_cells(cells, ["__set", model, subgroup], bins).select(scope.alias("scope"), subgroup, model, *METRICS)


def _cells(df: DataFrame, sets: list[list[str]], p: str, y: str, w: str) -> DataFrame:
    """(__set, keys, __p, weights and counts of both labels): what every metric needs of the rows with one score.

    Each set of keys is one grouping set of the same aggregation; ``__set`` tells them apart, as a key may be null itself.
    """
    keys = list(dict.fromkeys(c for own in sets for c in own))
    own, weight = F.col(y), F.col(w).cast("double")
    rows = df.select(*keys, F.col(p).cast("double").alias("__p"), own.alias("__y"), weight.alias("__w"))
    sums = [f.alias(n) for n, f in {f"__{k}{i}": F.sum(F.when(F.col("__y") == i, c).otherwise(zero)) for i in (0, 1) for k, c, zero in (("w", F.col("__w"), 0.0), ("n", F.lit(1), 0))}.items()]
    if len(sets) == 1:
        return windows.once(rows.groupBy(*keys, "__p").agg(F.lit(0).alias("__set"), *sums))
    whole = rows.groupingSets([[F.col(c) for c in (*own, "__p")] for own in sets], *(F.col(c) for c in (*keys, "__p")))
    marks = [F.grouping(c).alias(f"__not_{c}") for c in keys]
    made = windows.once(whole.agg(*marks, *sums))
    place = F.lit(0)
    for i, own in enumerate(sets):
        held = [F.col(f"__not_{c}") == (0 if c in own else 1) for c in keys]
        place = F.when(reduce(lambda a, b: a & b, held), i).otherwise(place)
    out = made.withColumn("__set", place).drop(*(f"__not_{c}" for c in keys))
    out.is_cut = True
    return out


def _from_cells(cells: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Every metric of each group: running sums along the scores, then sums by bin, then by group."""
    p, w0, w1, n0, n1 = (F.col(f"__{k}") for k in ("p", "w0", "w1", "n0", "n1"))
    run = windows.running_sums(_also(cells, (w0 + w1).alias("__w")), by, "__p", ["__w0", "__w"])
    q, said, w = clip_p(p, CLIP), p < 0.5, w0 + w1
    parts = {
        "u": w1 * (F.col("__w0__run") - w0 / 2), "step": F.try_divide(F.col("__w0__run"), F.col("__w__run")) * w0, "p1": w1, "p0": w0,
        "log": -(w1 * F.log(q) + w0 * F.log(1 - q)), "square": w1 * F.pow(q - 1, F.lit(2)) + w0 * F.pow(q, F.lit(2)), "said": w * p,
        "tp": F.when(said, n0).otherwise(0), "fp": F.when(said, n1).otherwise(0), "fn": F.when(~said, n0).otherwise(0), "tn": F.when(~said, n1).otherwise(0),
    }
    cut = run.groupBy(*by, windows.right_closed_bin(p, bins).alias("__bin")).agg(*(F.sum(c).alias(f"__{k}") for k, c in parts.items()))
    own, gap = F.col("__p0") + F.col("__p1"), F.abs(F.col("__said") - F.col("__p1"))
    sums = cut.groupBy(*by).agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in parts), F.sum(F.when(own > 0, gap)).alias("__gap"), F.max(F.when(own > 0, gap / own)).alias("max_gap"))
    total, (tp, fp, fn, tn) = F.col("__p0") + F.col("__p1"), (F.col(f"__{k}") for k in ("tp", "fp", "fn", "tn"))
    return sums.select(
        *by, F.try_divide("__log", total).alias("log_loss"), F.try_divide("__square", total).alias("brier"), F.try_divide("__u", F.col("__p1") * F.col("__p0")).alias("auc"),
        F.try_divide("__step", "__p0").alias("average_precision"), *_classified(tp, fp, fn, tn), F.try_divide("__gap", total).alias("ece"), "max_gap",
    )


def _also(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with more columns; a table that is made once stays so."""
    out = df.select("*", *columns)
    out.is_cut = getattr(df, "is_cut", False)
    return out


def deltas(table: DataFrame, column: str, reference: str, by: list[str], values: list[str]) -> DataFrame:
    """Differences of every other row to the reference row of the same group."""
    table = windows.once(table)
    ref = table.where(F.col(column) == reference).select(*by, *(F.col(v).alias(f"__{v}") for v in values))
    other = table.where(F.col(column) != reference)
    return windows.matched(other, ref, by).select(*by, column, *((F.col(v) - F.col(f"__{v}")).alias(f"{v}_delta") for v in values))


def tail_calibration(df: DataFrame, score: str, models: dict[str, str], fractions: tuple[float, ...] = (0.05, 0.1, 0.2), y: str = "y") -> DataFrame:
    """Mean probability and observed rate of each model in the tails of one score.

    The tail is defined once, by ``score``, and all models share its rows.
    """
    edges = windows.exact_quantiles(df, score, [1 - f for f in fractions], name="__edges")
    per = df.crossJoin(F.broadcast(edges)).withColumn("__t", F.explode(F.arrays_zip(F.array(*(F.lit(f) for f in fractions)).alias("f"), F.col("__edges").alias("e"))))
    rows = per.where(F.col(score) >= F.col("__t.e")).select(F.col("__t.f").alias("fraction"), y, *(F.col(c).alias(m) for m, c in models.items()))
    long = rows.unpivot(["fraction", y], list(models), "model", "p")
    return long.groupBy("fraction", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(y).alias("observed"), (F.avg("p") - F.avg(y)).alias("gap"))
