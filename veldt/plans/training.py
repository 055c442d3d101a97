"""Queries of models trained together, each with its passes written out in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veldt.operators import resample, training
from veldt.plans.frames import PASSES, passes, rounded
from veldt.plans.registry import query

#: The configurations of the tuning study: (alpha, l1).
GRID = [(a, b) for a in (1e-5, 3e-5, 1e-4) for b in (0.0, 0.15, 0.3)]
MODELS = {"full": ("p", "t_start", "t_end", "under"), "no_threat": ("p", "under"), "threat": ("t_start", "t_end")}
_NAMES = ("p", "t_start", "t_end", "under")
EPOCHS, SEED, HELD = 6, 7, 0.3
#: Epochs and penalties of the joint fit, as tuning would choose them.
JOINT = {"full": (6, 3e-5, 0.3), "no_threat": (4, 1e-2, 0.5), "threat": (5, 1e-1, 0.9)}


def _candidates() -> list[training.Candidate]:
    return [training.Candidate(f"{m} {a:g} {b:g}", own, a, b, EPOCHS) for m, own in MODELS.items() for a, b in GRID]


def _joint() -> list[training.Candidate]:
    return [training.Candidate(m, MODELS[m], a, b, n) for m, (n, a, b) in JOINT.items()]


def _columns():
    return {n: F.col(n) if n != "under" else (F.col("pressure") == "Under pressure").cast("double") for n in _NAMES}


def _trained(spark, d, candidates, held: bool):
    v = passes(spark, d)
    scan = training.prepare(v, "won", _columns(), resample.grouped_split(v, "match_id", HELD, SEED) if held else None).persist()
    try:
        return training.train(scan, _columns(), candidates, "trace")
    finally:
        scan.unpersist()


def _passes_sql(candidates: list[training.Candidate], held: bool) -> str:
    """CTEs of every pass: ``b0`` to ``b<epochs>`` hold (k, stop, v0 to v4), ``x`` the standardised rows, ``st`` moments."""
    n, f = len(_NAMES), range(1, len(_NAMES) + 1)
    split = f"CAST(('0x' || substr(sha256('{SEED}|' || match_id), 1, 8)) AS BIGINT) < CAST(floor({HELD} * 4294967296) AS BIGINT)" if held else "FALSE"
    out = [PASSES, f"h AS (SELECT CAST(won AS DOUBLE) AS y, {split} AS held, p AS f1, t_start AS f2, t_end AS f3, CASE WHEN pressure = 'Under pressure' THEN 1.0::DOUBLE ELSE 0 END AS f4 FROM pv)"]
    out.append("st AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in f) + " FROM h WHERE NOT held)")
    out.append("x AS MATERIALIZED (SELECT y, held, " + ", ".join(f"(f{i} - m{i}) / s{i} AS x{i}" for i in f) + " FROM h, st)")
    rows = ", ".join(f"('{c.name}', {c.epochs}, {c.alpha!r}::DOUBLE, {c.l1!r}::DOUBLE, {1 / (max(1, len(c.features)) / 4 + c.alpha * (1 - c.l1))!r}::DOUBLE, {', '.join(str(int(i in c.features)) for i in _NAMES)})" for c in candidates)
    out.append(f"ca(k, stop, alpha, l1, step, {', '.join(f'u{i}' for i in f)}) AS (VALUES {rows})")
    zeros = ", ".join(f"0.0::DOUBLE AS v{i}" for i in range(n + 1))
    out += [f"b0 AS (SELECT k, stop, {zeros} FROM ca)", f"z0 AS (SELECT k, {zeros} FROM ca)"]
    pace = 1.0
    for e in range(max(c.epochs for c in candidates)):
        margin = "v0 + " + " + ".join(f"v{i} * x{i}" for i in f)
        rest = f"(1 / (1 + exp(-({margin}))) - y)"
        out.append(f"g{e} AS MATERIALIZED (SELECT k, avg({rest}) AS g0, " + ", ".join(f"avg({rest} * x{i}) AS g{i}" for i in f) + f" FROM x, z{e} WHERE NOT held GROUP BY k)")
        go = "CASE WHEN {e} < ca.stop THEN {new} ELSE b.v{i} END AS v{i}"
        new = [f"(z.v{i} - step * (g{i} + alpha * (1 - l1) * z.v{i}))" for i in f]
        moved = [go.format(e=e, i=0, new="z.v0 - step * g0")] + [go.format(e=e, i=i, new=f"u{i} * sign({m}) * greatest(abs({m}) - step * alpha * l1, 0)") for i, m in zip(f, new)]
        out.append(f"b{e + 1} AS MATERIALIZED (SELECT ca.k, ca.stop, {', '.join(moved)} FROM ca JOIN z{e} z ON z.k = ca.k JOIN g{e} g ON g.k = ca.k JOIN b{e} b ON b.k = ca.k)")
        after = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        out.append(f"z{e + 1} AS MATERIALIZED (SELECT a.k, {', '.join(f'a.v{i} + {(pace - 1) / after!r}::DOUBLE * (a.v{i} - b.v{i}) AS v{i}' for i in range(n + 1))} FROM b{e + 1} a JOIN b{e} b ON a.k = b.k)")
        pace = after
    return ",\n".join(out)


def _losses_sql() -> str:
    q = "least(greatest(1 / (1 + exp(-(v0 + " + " + ".join(f"v{i} * x{i}" for i in range(1, 5)) + "))), 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)"
    each = " UNION ALL ".join(f"SELECT k, {e} AS epoch, y, {q} AS q FROM x, b{e} WHERE held AND {e} <= stop" for e in range(1, EPOCHS + 1))
    return f"lo AS (SELECT k AS candidate, CAST(epoch AS INT) AS epoch, count(*) AS n, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, avg((q - y) * (q - y)) AS brier FROM ({each}) GROUP BY 1, 2)"


@query("m3_tuning_grid", f"WITH {_passes_sql(_candidates(), True)}, {_losses_sql()} SELECT candidate, epoch, alpha, l1, n, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier FROM lo JOIN ca ON ca.k = candidate")
def _(spark, d):
    """Held-out losses of nine configurations of three models after every epoch, from as many passes as epochs."""
    return rounded(_trained(spark, d, _candidates(), True).losses(spark).select("candidate", "epoch", "alpha", "l1", "n", "log_loss", "brier"))


@query("m3_k6_tuning", f"WITH {_passes_sql(_candidates(), True)}, {_losses_sql()} SELECT candidate, epoch, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier FROM lo ORDER BY lo.log_loss, lo.brier LIMIT 1")
def _(spark, d):
    """The configuration and epoch that tuning selects, with its losses."""
    got = _trained(spark, d, _candidates(), True)
    v = passes(spark, d)
    name, epoch = got.best(v.where(resample.grouped_split(v, "match_id", HELD, SEED)), "won")
    losses = got.losses(spark).where((F.col("candidate") == name) & (F.col("epoch") == epoch))
    return rounded(losses.select("candidate", "epoch", "log_loss", "brier"))


def _joint_sql() -> str:
    b = f"b{max(n for n, _, _ in JOINT.values())}"
    weights = ", ".join(f"round({b}.v{i} / s{i}, 9) + 0.0::DOUBLE AS {n}" for i, n in enumerate(_NAMES, 1))
    shift = " - ".join([f"{b}.v0", *(f"{b}.v{i} / s{i} * m{i}" for i in range(1, 5))])
    mean = "(SELECT avg(1 / (1 + exp(-(v0 + " + " + ".join(f"v{i} * x{i}" for i in range(1, 5)) + ")))) FROM x)"
    return f"SELECT {b}.k AS model, CAST(stop AS INT) AS epochs, round({shift}, 9) AS intercept, {weights}, round({mean}, 9) AS mean_p FROM {b}, st"


@query("m5_joint_models", f"WITH {_passes_sql(_joint(), False)} {_joint_sql()}")
def _(spark, d):
    """Coefficients of three models that share every pass and stop after epochs of their own, and their mean probability."""
    got = _trained(spark, d, _joint(), False)
    fits = {c.name: got.linear(c.name) for c in got.candidates}
    frozen = passes(spark, d).withColumns(_columns())
    means = frozen.agg(*(F.avg(m.raw()).alias(k) for k, m in fits.items()))
    rows = [F.struct(F.lit(c.name).alias("model"), F.lit(c.epochs).alias("epochs"), F.lit(fits[c.name].intercept).alias("intercept"), *(F.lit(fits[c.name].weights.get(n, 0.0) + 0.0).alias(n) for n in _NAMES), F.col(c.name).alias("mean_p")) for c in got.candidates]
    return rounded(means.select(F.inline(F.array(*rows))))


def _by_size_sql() -> str:
    b = f"b{max(n for n, _, _ in JOINT.values())}"
    each = " UNION ALL ".join(f"SELECT '{n}' AS name, v{i} / s{i} AS weight FROM {b}, st WHERE k = 'full'" for i, n in enumerate(_NAMES, 1))
    return f"SELECT name, round(weight, 9) + 0.0::DOUBLE AS weight, CAST(row_number() OVER (ORDER BY abs(weight) DESC, name) AS INT) AS place FROM ({each})"


@query("k8_coefficients_by_size", f"WITH {_passes_sql(_joint(), False)} {_by_size_sql()}")
def _(spark, d):
    """The full model's coefficients from the largest magnitude down."""
    rows = [(n, w + 0.0, i) for i, (n, w) in enumerate(_trained(spark, d, _joint(), False).linear("full").importance(), 1)]
    return rounded(spark.createDataFrame(rows, "name string, weight double, place int"))
