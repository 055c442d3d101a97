"""Probability models: frozen one-hot categories, elastic-net logistic fits, Platt scaling, cross-fitting.

Fits are Spark ML's converged optimum, not an early-stopped stochastic iterate; the roles of rows,
the features, the calibration and the absence of leaks are what is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.scalars import evaluation_points, labelled_category, logit, sigmoid, stable_hash, state_features
from veldt.operators import checks, metrics, resample, windows
from veldt.operators.relational import finite, small, union_all


FIT_ROWS = 200_000  # rows of a partition that fits read over and over


def freeze_categories(train: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values of each category column in the training rows."""
    seen = train.agg(*(F.array_sort(F.collect_set(labelled_category(F.col(c)))).alias(c) for c in columns)).first() if columns else {}
    return {c: list(seen[c]) for c in columns}


def one_hot(categories: Mapping[str, list[str]]) -> dict[str, Column]:
    """Indicator features of frozen values; an unseen value has zeros everywhere (M1)."""
    return {f"{c}={v}": (labelled_category(F.col(c)) == v).cast("double") for c, values in categories.items() for v in values}


@dataclass(frozen=True)
class Linear:
    """Frozen coefficients of named feature columns and a calibration line on the logit."""

    intercept: float
    weights: dict[str, float]
    platt: tuple[float, float] = (0.0, 1.0)
    features: dict[str, Column] = field(default_factory=dict, compare=False)

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for name, weight in sorted(self.weights.items()):
            if weight:
                out = out + F.lit(weight) * self.features[name]
        return out

    def raw(self) -> Column:
        return sigmoid(self.margin())

    def probability(self) -> Column:
        a, b = self.platt
        return sigmoid(F.lit(a) + F.lit(b) * logit(self.raw()))

    def importance(self) -> list[tuple[str, float]]:
        """Coefficients from the largest magnitude down, ties by name (K8)."""
        return sorted(self.weights.items(), key=lambda x: (-abs(x[1]), x[0]))

    def calibrated(self, rows: DataFrame, label: str) -> Linear:
        """The same model with a Platt line fitted on ``rows`` (M6)."""
        line = metrics.calibration_line(rows.select(self.raw().alias("p"), F.col(label).alias("y"), F.lit(1.0).alias("w")), []).first()
        return Linear(self.intercept, self.weights, (line["intercept"], line["slope"]), self.features)


def fit(train: DataFrame, label: str, features: Mapping[str, Column], alpha: float = 3e-5, l1: float = 0.3, iterations: int = 100) -> Linear:
    """Elastic-net logistic regression (M2)."""
    names = list(features)
    frame = train.select(F.col(label).cast("double").alias("label"), *(features[n].cast("double").alias(f"f{i}") for i, n in enumerate(names)))
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features", handleInvalid="error").transform(frame)
    model = LogisticRegression(regParam=alpha, elasticNetParam=l1, maxIter=iterations, standardization=True, tol=1e-9).fit(vectors.select("label", "features"))
    return Linear(float(model.intercept), dict(zip(names, map(float, model.coefficients))), features=dict(features))


def tune(train: DataFrame, held: DataFrame, label: str, features: Mapping[str, Column], grid: list[tuple[float, float]], iterations: tuple[int, ...] = (10, 30)) -> tuple[Linear, list[dict]]:
    """Fit every configuration and keep the best by log loss, then Brier, then average precision (M3, K6)."""
    train = train.persist()
    results = []
    for alpha, l1 in grid:
        for steps in iterations:
            model = fit(train, label, features, alpha, l1, steps)
            got = metrics.all_metrics(held.select(F.col(label).alias("y"), model.raw().alias("p"), F.lit(1.0).alias("w")), []).first().asDict()
            results.append({"alpha": alpha, "l1": l1, "iterations": steps, "model": model} | got)
    train.unpersist()
    best = min(results, key=lambda r: (r["log_loss"], r["brier"], -r["average_precision"]))
    return best["model"], results


def fold_roles(matches: DataFrame, match: str, stratum: list[str], k: int, calibration: float = 0.125, seed: int = 20260723) -> DataFrame:
    """(outer_fold, match, role): one role of every match in every fold."""
    own = matches.select(match, *stratum).distinct()
    dealt = windows.positions(own.withColumn("__h", stable_hash(seed, F.col(match))), stratum, ["__h"])
    dealt = dealt.select(match, *stratum, windows.round_robin(k).alias("__fold"))
    folds = dealt.crossJoin(F.broadcast(matches.sparkSession.range(k).select(F.col("id").cast("int").alias("outer_fold"))))
    rest = folds.where("outer_fold <> __fold").withColumn("__c", stable_hash(seed, F.concat(F.lit("calibration|"), F.col("outer_fold").cast("string")), F.col(match)))
    rest = windows.positions(rest, ["outer_fold", *stratum], ["__c"]).withColumn("role", F.when(windows.calibration_pick(calibration), "calibration").otherwise("training"))
    return rest.select("outer_fold", match, "role").unionByName(folds.where("outer_fold = __fold").select("outer_fold", match, F.lit("holdout").alias("role")))


def dealt(rows: DataFrame, roles: DataFrame, match: str, k: int) -> DataFrame:
    """``rows`` of matches with a role, and the first letter of their role in each fold in ``__roles`` (``-``: none).

    A match with two roles in a fold is an error, as its rows would be scored by a model that saw them.
    """
    letters = []
    for fold in range(k):
        own = F.when(F.col("outer_fold") == fold, F.substring("role", 1, 1))
        letters.append(F.when(F.min(own) != F.max(own), F.raise_error(F.lit("a match has two roles in a fold")).cast("string")).otherwise(F.coalesce(F.max(own), F.lit("-"))))
    return rows.join(small(roles.groupBy(match).agg(F.concat(*letters).alias("__roles"))), match)


def in_role(role: str, fold: int) -> Column:
    """Whether a row of ``dealt`` has a role in a fold."""
    return F.substring("__roles", fold + 1, 1) == role[0]


def held_out(rows: DataFrame, k: int) -> DataFrame:
    """Rows of ``dealt`` with the fold that holds them out, ``__fold``."""
    folds = F.array(*(F.when(in_role("holdout", f), F.lit(f)) for f in range(k)))
    return rows.withColumn("__fold", F.explode(F.array_compact(folds)))


def fit_folds(scan: DataFrame, label: str, features: Callable[[int, DataFrame], Mapping[str, Column]], k: int, alpha: float, l1: float, iterations: int = 100) -> list[Linear]:
    """A fit of each fold on its training rows in ``scan``, rows of ``dealt`` that should be persisted, and its Platt line.

    The lines of all folds are fitted together, so that a Newton step is one aggregation however many folds there are.
    """
    fits, parallel = [], scan.sparkSession.sparkContext.defaultParallelism
    scan = scan.coalesce(max(parallel, -(-scan.count() // FIT_ROWS)))
    for f in range(k):
        train = scan.where(in_role("training", f))
        fits.append(fit(train, label, features(f, train), alpha, l1, iterations))
    rows = union_all(*(scan.where(in_role("calibration", f)).select(F.lit(f).alias("fold"), m.margin().alias("z"), F.col(label).alias("y"), F.lit(1.0).alias("w")) for f, m in enumerate(fits))).withColumn("p", sigmoid(F.col("z")))
    lines = {r["fold"]: (r["intercept"], r["slope"]) for r in metrics.calibration_line(rows, ["fold"]).collect()}
    if len(lines) < k:
        raise checks.IntegrityError(f"no calibration rows in folds {sorted(set(range(k)) - set(lines))}")
    return [Linear(m.intercept, m.weights, lines[f], m.features) for f, m in enumerate(fits)]


def cross_fit(rows: DataFrame, roles: DataFrame, match: str, label: str, features: Callable[[DataFrame], Mapping[str, Column]], keep: list[str], k: int, alpha: float = 3e-5, l1: float = 0.3, iterations: int = 100) -> DataFrame:
    """Out-of-fold calibrated probabilities ``p``: one row for every row, scored by a model that never saw its match (M7).

    ``features`` makes the feature Columns of a fold from its training rows alone. The rows meet their
    roles once and are kept for the fits of all folds; one more pass scores every row by its own fold.
    """
    own = dealt(rows, roles, match, k)
    scan = own.persist()
    try:
        fits = fit_folds(scan, label, lambda _, train: features(train), k, alpha, l1, iterations)
    finally:
        scan.unpersist()
    margin = F.lit(None).cast("double")
    for f, model in enumerate(fits):
        margin = F.when(F.col("__fold") == f, model.margin()).otherwise(margin)
    got = with_probability(held_out(own, k), "__p", margin, _platt(fits))
    return got.select(*keep, F.col("__fold").alias("outer_fold"), F.col(label).alias("y"), F.col("__p").alias("p"))


def with_probability(rows: DataFrame, name: str, margin: Column, platt: tuple[Column, Column]) -> DataFrame:
    """``rows`` with a calibrated probability; each step is a column of its own, as the formulas name their arguments several times."""
    steps = {"__margin": margin, "__raw": sigmoid(F.col("__margin")), "__line": platt[0] + platt[1] * logit(F.col("__raw")), name: sigmoid(F.col("__line"))}
    for n, c in steps.items():
        rows = rows.withColumn(n, c)
    return rows.drop("__margin", "__raw", "__line")


def _by_fold(values) -> Column:
    """The number of each row's ``__fold``."""
    return F.array(*(F.lit(float(v)) for v in values))[F.col("__fold")]


def _platt(fits: list[Linear]) -> tuple[Column, Column]:
    return tuple(_by_fold(m.platt[i] for m in fits) for i in (0, 1))


def fit_models(train: DataFrame, label: str, models: Mapping[str, Mapping[str, Column]], alpha: float = 3e-5, l1: float = 0.3) -> dict[str, Linear]:
    """Several models on one prepared scan: the rows are read once and hold every model's features (M5)."""
    features = {n: c for own in models.values() for n, c in own.items()}
    place = {n: f"__f{i}" for i, n in enumerate(features)}
    scan = train.select(F.col(label).cast("double").alias("__y"), *(c.cast("double").alias(place[n]) for n, c in features.items())).persist()
    fits = {m: fit(scan, "__y", {n: F.col(place[n]) for n in own}, alpha, l1) for m, own in models.items()}
    scan.unpersist()
    return {m: Linear(f.intercept, f.weights, f.platt, dict(models[m])) for m, f in fits.items()}


def scaler(train: DataFrame, features: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature in the training rows; a deviation of 0 counts as 1."""
    stats = train.agg(*(f(c).alias(f"{n}__{k}") for n, c in features.items() for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {n: (float(stats[f"{n}__m"]), float(stats[f"{n}__s"] or 1.0)) for n in features}


def scaled(features: Mapping[str, Column], scale: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    return {n: (c - scale[n][0]) / scale[n][1] for n, c in features.items()}


POINTS = ("start", "end", "opponent")


def state_points(columns: Mapping[str, Column]) -> dict[str, dict[str, Column]]:
    """State features at the start, at the end a stage later, and mirrored for the opponent at stage 1.

    ``columns`` are x, y, end_x, end_y (0 to 1), time, period and stage.
    """
    at = evaluation_points(columns["x"], columns["y"], columns["end_x"], columns["end_y"], columns["stage"])
    return {k: state_features(x, y, columns["time"], columns["period"], stage) for k, (x, y, stage) in at.items()}


def threats(model: Linear, scale: Mapping[str, tuple[float, float]], columns: Mapping[str, Column]) -> dict[str, Column]:
    """One model's calibrated probability at the three points."""
    return {k: Linear(model.intercept, model.weights, model.platt, scaled(f, scale)).probability() for k, f in state_points(columns).items()}


def threat_roles(rows: DataFrame, match: str, fold: str, k: int, calibration: float, seed: int) -> DataFrame:
    """(outer_fold, match, role): each fold's matches are held out once; a hashed share of the others calibrates."""
    own = rows.select(F.col(match), F.col(fold).alias("__own")).distinct()
    dealt = own.crossJoin(rows.sparkSession.range(k).select(F.col("id").cast("int").alias("outer_fold")))
    share = resample.hashed_share(F.lit(seed) + F.col("outer_fold"), F.col(match))
    role = F.when(F.col("__own") == F.col("outer_fold"), "holdout").when(share < calibration, "calibration").otherwise("training")
    return dealt.select("outer_fold", match, role.alias("role"))


def cross_fitted_threat(rows: DataFrame, match: str, fold: str, label: str, columns: Mapping[str, Column], keep: list[str], k: int, calibration: float = 0.15, alpha: float = 1e-5, seed: int = 20260723, iterations: int = 100) -> DataFrame:
    """(keep, outer_fold, y, threat_start, threat_end, threat_opponent): scored by models that never saw the row's match (M8).

    For each fold whole matches outside it are split into training and calibration. Features at the
    start are standardised on the training rows, a ridge logistic model is fitted on them, and a
    Platt line on the calibration rows. Rows without a start take no part, those without an end are
    not scored. The rows meet their roles once, and one more pass scores them all.
    """
    named = rows.select("*", *(c.alias(f"__{n}") for n, c in columns.items()))
    own = {n: F.col(f"__{n}") for n in columns}
    met = dealt(named.where(finite("__x", "__y")), threat_roles(rows, match, fold, k, calibration, seed), match, k)
    start = state_points(own)["start"]
    scan = met.select(label, *own.values(), "__roles").persist()
    try:
        scales = _scales(scan, start, k)
        fits = fit_folds(scan, label, lambda f, _: scaled(start, scales[f]), k, alpha, 0.0, iterations)
    finally:
        scan.unpersist()
    held = held_out(met.where(finite("__end_x", "__end_y")), k)
    for point, place in state_points(own).items():
        held = with_probability(held, f"__threat_{point}", _margin_of_fold(fits, scales, place), _platt(fits))
    return held.select(*keep, F.col("__fold").alias("outer_fold"), F.col(label).alias("y"), *(F.col(f"__threat_{p}").alias(f"threat_{p}") for p in POINTS))


def _scales(scan: DataFrame, features: Mapping[str, Column], k: int) -> list[dict[str, tuple[float, float]]]:
    """``scaler`` of the training rows of every fold, in one pass."""
    folds = F.array_compact(F.array(*(F.when(in_role("training", f), F.lit(f)) for f in range(k))))
    rows = scan.select(F.explode(folds).alias("__fold"), *(c.alias(n) for n, c in features.items()))
    stats = {r["__fold"]: r for r in rows.groupBy("__fold").agg(*(f(n).alias(f"{n}__{s}") for n in features for s, f in (("m", F.avg), ("s", F.stddev_pop)))).collect()}
    if len(stats) < k:
        raise checks.IntegrityError(f"no training rows in folds {sorted(set(range(k)) - set(stats))}")
    return [{n: (float(stats[f][f"{n}__m"]), float(stats[f][f"{n}__s"] or 1.0)) for n in features} for f in range(k)]


def _margin_of_fold(fits: list[Linear], scales: list[dict[str, tuple[float, float]]], features: Mapping[str, Column]) -> Column:
    """``Linear.margin`` of the scaled features by the fit of each row's ``__fold``.

    As a loop over an array: written out for several points and folds it is more code than the JVM compiles in one method.
    """
    used = sorted(n for n in features if any(m.weights[n] for m in fits))
    own = F.array(*(F.array(*(F.struct(F.lit(m.weights[n]).alias("w"), F.lit(s[n][0]).alias("m"), F.lit(s[n][1]).alias("s")) for n in used)) for m, s in zip(fits, scales)))[F.col("__fold")]
    terms = F.zip_with(F.array(*(features[n] for n in used)), own, lambda c, k: k["w"] * ((c - k["m"]) / k["s"]))
    return F.aggregate(terms, _by_fold(m.intercept for m in fits), lambda total, t: total + t)


def standardised(train: DataFrame, features: Mapping[str, Column]) -> dict[str, Column]:
    """Features less their training mean, over their population deviation (M8)."""
    return scaled(features, scaler(train, features))
