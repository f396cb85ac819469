"""Feature scalings and target transforms, fitted on stated training rows by aggregates and applied as projections.

A fitted scaling is a small dict of numbers per column (driver side); applying it is a narrow Catalyst projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled features are clipped to +-CLIP (not for quantile_normal, which is bounded by itself).
CLIP = 10.0
SCALINGS = ["standard", "robust", "log_standard", "yeo_johnson", "quantile_normal"]
QUANTILES = 200


@dataclass
class Scaling:
    name: str
    columns: dict[str, dict]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expression(c) for c in self.columns})

    def expression(self, c: str) -> Column:
        p, v = self.columns[c], F.col(c).cast("double")
        if self.name == "quantile_normal":
            return _to_normal(v, p["grid"])
        if p.get("log"):
            v = F.signum(v) * F.log1p(F.abs(v))
        if "lambda" in p:
            v = yeo_johnson(v, p["lambda"])
        scaled = (v - F.lit(p["centre"])) / F.lit(p["scale"])
        return F.when(scaled.isNotNull(), F.greatest(F.least(scaled, F.lit(CLIP)), F.lit(-CLIP)))


def fit_scaling(train: DataFrame, columns: list[str], name: str, skew_above: float = 1.0) -> Scaling:
    """One of SCALINGS fitted on training rows. Standard deviations are population ones; a constant column is divided by 1.

    standard: mean and sd. robust: median and interquartile range. log_standard: sign(v) log1p |v| where the population
    skewness exceeds skew_above in size, then standard. yeo_johnson: maximum-likelihood power, then standard.
    quantile_normal: rank to normal through at most QUANTILES quantiles. Null and NaN values take no part.
    """
    if name not in SCALINGS:
        raise ValueError(f"scaling must be one of {SCALINGS}")
    clean = train.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    if name == "robust":
        rows = _quantiles(clean, columns, [0.25, 0.5, 0.75])
        return Scaling(name, {c: {"centre": rows[c][1], "scale": _nonzero(rows[c][2] - rows[c][0])} for c in columns})
    if name == "quantile_normal":
        n = clean.count()
        q = min(QUANTILES, max(2, n))
        rows = _quantiles(clean, columns, [k / (q - 1) for k in range(q)])
        return Scaling(name, {c: {"grid": rows[c]} for c in columns})
    found: dict[str, dict] = {c: {} for c in columns}
    if name == "log_standard":
        skews = clean.agg(*[F.skewness(c).alias(c) for c in columns]).first()
        for c in columns:
            found[c]["log"] = skews[c] is not None and not math.isnan(skews[c]) and abs(skews[c]) > skew_above
    if name == "yeo_johnson":
        for c, value in zip(columns, fit_powers(clean, columns)):
            found[c]["lambda"] = value

    def transformed(c: str) -> Column:
        v = F.col(c)
        if found[c].get("log"):
            v = F.signum(v) * F.log1p(F.abs(v))
        if "lambda" in found[c]:
            v = yeo_johnson(v, found[c]["lambda"])
        return v

    rows = clean.agg(*[F.struct(F.avg(transformed(c)).alias("m"), F.stddev_pop(transformed(c)).alias("s")).alias(c) for c in columns]).first()
    for c in columns:
        found[c] |= {"centre": rows[c]["m"], "scale": _nonzero(rows[c]["s"])}
    return Scaling(name, found)


def _quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of every column, from counted and ranged values; a column without values has zeros."""
    from tessera.operators.statistics import ordered_counts, quantiles_of, unpivot

    found = quantiles_of(ordered_counts(unpivot(df, columns), ["column"], "value"), ["column"], "value", shares).collect()
    return {c: [0.0] * len(shares) for c in columns} | {r.column: list(r.q) for r in found}


def _nonzero(s: float | None) -> float:
    return s if s and s > 1e-300 and not math.isnan(s) else 1.0


def yeo_johnson(v: Column, power: float) -> Column:
    """The power transform of any real value; power 0 and 2 are its logarithmic limits."""
    up = F.log1p(v) if abs(power) < 1e-12 else (F.pow(v + 1, F.lit(power)) - 1) / power
    rest = 2 - power
    down = -F.log1p(-v) if abs(rest) < 1e-12 else -(F.pow(1 - v, F.lit(rest)) - 1) / rest
    return F.when(v >= 0, up).otherwise(down)


def fit_powers(df: DataFrame, columns: list[str], rounds: int = 7, points: int = 9) -> list[float]:
    """Maximum-likelihood powers of all columns together: a grid that narrows round by round, one aggregate a round, and a
    parabola through the last three values. Where the best value lies on an edge, the grid moves on instead of narrowing."""
    low, high = np.full(len(columns), -3.0), np.full(len(columns), 5.0)
    best = np.ones(len(columns))
    for _ in range(rounds):
        grids = [np.linspace(a, b, points) for a, b in zip(low, high)]
        cells = []
        for c, grid in zip(columns, grids):
            v = F.col(c)
            jacobian = F.avg(F.signum(v) * F.log1p(F.abs(v)))
            cells.append(F.array(*[-0.5 * F.ln(F.var_pop(yeo_johnson(v, float(p))) + 1e-300) + (float(p) - 1) * jacobian for p in grid]).alias(c))
        rows = df.agg(*cells).first()
        for k, c in enumerate(columns):
            values = np.array([-np.inf if x is None or math.isnan(x) else x for x in rows[c]])
            at = int(values.argmax())
            step = grids[k][1] - grids[k][0]
            best[k] = grids[k][at]
            if 0 < at < points - 1:
                low[k], high[k] = best[k] - step, best[k] + step
                a, b, c_ = values[at - 1 : at + 2]
                if np.isfinite([a, c_]).all() and a - 2 * b + c_ < 0:
                    best[k] += step * (a - c_) / (2 * (a - 2 * b + c_))
            else:
                low[k], high[k] = best[k] - 4 * step, best[k] + 4 * step
    return best.tolist()


def _to_normal(v: Column, grid: list[float]) -> Column:
    """Place of a value among the quantiles (interpolated, the middle of a tie) through the inverse normal distribution."""
    n = len(grid)
    g = F.array(*[F.lit(float(x)) for x in grid])
    below = F.size(F.filter(g, lambda x: x < v))
    upto = F.size(F.filter(g, lambda x: x <= v))
    lower, upper = F.get(g, F.greatest(below - 1, F.lit(0))), F.get(g, F.least(below, F.lit(n - 1)))
    between = (below - 1 + F.coalesce(F.try_divide(v - lower, upper - lower), F.lit(0.0))) / (n - 1)
    tied = (below + upto - 1) / 2 / (n - 1)
    p = F.when(upto > below, tied).otherwise(between)
    return F.when(v.isNotNull(), normal_quantile(F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution: a rational guess, then two Newton steps on the distribution itself."""
    low = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(low))
    # fixed values: coefficients of a published rational approximation (absolute error under 4.5e-4)
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    from tessera.functions.arrays import bind

    for _ in range(2):
        x = bind(x, lambda v: v + (_upper_tail(v) - low) * F.exp(v * v / 2) * math.sqrt(2 * math.pi))
    return F.when(p == 0.5, 0.0).when(p < 0.5, -x).otherwise(x)


def _upper_tail(v: Column) -> Column:
    """Probability above v >= 0: the density's series near 0, its continued fraction beyond."""
    square = v * v
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(v.alias("t"), v.alias("s")), lambda acc, k: F.struct((acc["t"] * square / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * square / (2 * k + 1)).alias("s")), lambda acc: acc["s"])
    near = 0.5 - F.exp(-square / 2) / math.sqrt(2 * math.pi) * series
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), v, lambda acc, k: v + k / acc)
    far = F.exp(-square / 2) / math.sqrt(2 * math.pi) / fraction
    return F.when(v < 3, near).otherwise(far)


# target transforms: forward, inverse


def target_forward(name: str, y: Column) -> Column:
    if name == "standard":
        return y
    if name == "sqrt":
        return F.sqrt(y)
    if name == "log1p":
        return F.log1p(y)
    raise ValueError("target must be standard, sqrt or log1p")


def target_inverse(name: str, z: Column) -> Column:
    """The inverse; sqrt clips at 0 before squaring."""
    if name == "standard":
        return z
    if name == "sqrt":
        return F.pow(F.greatest(z, F.lit(0.0)), F.lit(2.0))
    if name == "log1p":
        return F.expm1(z)
    raise ValueError("target must be standard, sqrt or log1p")


def fit_target(train: DataFrame, y: str, name: str) -> tuple[float, float]:
    """Mean and population sd of the transformed target."""
    z = target_forward(name, F.col(y).cast("double"))
    m, s = train.agg(F.avg(z), F.stddev_pop(z)).first()
    return float(m), _nonzero(s)


def clip_predictions(column: Column) -> Column:
    """Negative values become 0; null and NaN stay."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(0.0)))
