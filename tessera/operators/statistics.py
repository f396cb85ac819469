"""Statistical operators over DataFrames: variance decomposition, errors, ranks, correlations, outliers, redundancy.

All aggregates have a map-side part. Null values of a measured column are left out unless a docstring says otherwise;
empty tables give one row of nulls and zero counts for ungrouped aggregates, no rows for grouped ones.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_variance(df: DataFrame, y: str, group: str, min_count: int = 5) -> DataFrame:
    """One-way decomposition of y by group, groups of at least min_count: n, k, eta2, omega2, total_std, within_std, within_mae.

    Two shuffles of pre-aggregated rows; a hot group is summed map-side, no window gathers it.
    """
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y")).dropna()
    per = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).where(F.col("n") >= min_count)
    dev = rows.join(per.select("g", "m"), "g").groupBy("g").agg(F.sum(F.abs(F.col("y") - F.col("m"))).alias("a"))
    every = per.join(dev, "g")
    sums = every.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))).alias("ss"),
        F.sum("a").alias("a"),
    )
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    between = total - F.col("within")
    free = F.col("n") - F.col("k")
    error = F.try_divide(F.col("within"), free)
    return sums.select(
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.col("k"),
        F.try_divide(between, total).alias("eta2"),
        F.try_divide(between - (F.col("k") - 1) * error, total + error).alias("omega2"),
        F.sqrt(F.try_divide(total, F.col("n") - 1)).alias("total_std"),
        F.sqrt(error).alias("within_std"),
        F.try_divide(F.col("a"), F.col("n")).alias("within_mae"),
    )


def error_by_group(df: DataFrame, y: str, pred: str, group: str) -> DataFrame:
    """n, mae, rmse and bias (prediction minus truth) of each group that occurs; the null group is left out."""
    e = F.col(pred) - F.col(y)
    rows = df.where(F.col(group).isNotNull() & e.isNotNull())
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def scores(df: DataFrame, y: str, pred: str, tail: float = 9.0, by: list[str] | None = None) -> DataFrame:
    """mae, rmse, rmse below the tail (null if no row is), r2 against the population variance, bias, n."""
    e = F.col(pred) - F.col(y)
    rows = df.where(e.isNotNull())
    return rows.groupBy(*(by or [])).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.avg(F.when(F.col(y) < tail, e * e))).alias("rmse_below_tail"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.avg(e).alias("bias"),
        F.count("*").alias("n_eval"),
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; null is no value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def cumulative_share(df: DataFrame, column: str) -> DataFrame:
    """value_share in order of count (ties by value) with rank and running share; the window runs over distinct values."""
    counts = value_share(df, column)
    order = Window.orderBy(F.col("n").desc(), F.col(column))
    return counts.withColumn("place", F.row_number().over(order)).withColumn("cum_share", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def unpivot(df: DataFrame, columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Long form of numeric columns, one pass, as doubles."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("e")).select(f"e.{name}", f"e.{value}")


def ordered_counts(long: DataFrame, keys: list[str], value: str, bins: int = 64) -> DataFrame:
    """(keys, value, count, below): each distinct value of each group, how often it is there and how many values are smaller.

    Values are counted, the counts cut into ranges at approximate quantiles of their group, ranked within each range and
    shifted by the sizes of the ranges before, so that no task ranks a group and none keeps a group's values in memory.
    Null values and null keys take no part.
    """
    counts = long.select(*keys, value).dropna().groupBy(*keys, value).agg(F.count("*").alias("count"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.lit(8 * bins)).alias("_cuts"))
    binned = counts.join(cuts, keys).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = binned.groupBy(*keys, "_bin").agg(F.sum("count").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bin", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.withColumn("_within", F.coalesce(F.sum("count").over(within), F.lit(0))).join(starts, [*keys, "_bin"])
    return ranked.select(*keys, value, "count", (F.col("_start") + F.col("_within")).alias("below"))


def quantiles_of(ordered: DataFrame, keys: list[str], value: str, shares: list[float], sizes: DataFrame | None = None) -> DataFrame:
    """(keys, q ARRAY, distinct): exact quantiles, linear between neighbours, of the groups of ordered_counts, and how many
    different values they have. sizes (keys, n), if they are known, save a pass."""
    n = sizes.select(*keys, F.col("n").alias("_n")) if sizes is not None else ordered.groupBy(*keys).agg(F.sum("count").alias("_n"))
    marked = ordered.join(n, keys)
    at = F.transform(F.array(*[F.lit(float(p)) for p in shares]), lambda p: (F.col("_n") - 1) * p)
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("count"))
    if len(shares) > 12:  # one row a share instead of two columns
        wanted = marked.select(*keys, value, "count", "below", F.posexplode(at).alias("k", "_at"))
        ends = wanted.where(holds(F.floor("_at")) | holds(F.ceil("_at"))).groupBy(*keys, "k").agg(F.min(F.when(holds(F.floor("_at")), F.col(value))).alias("lo"), F.max(F.when(holds(F.ceil("_at")), F.col(value))).alias("hi"), F.first("_at").alias("_at"))
        found = ends.select(*keys, "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_at") - F.floor("_at"))).alias("v"))
        return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("q"))
    cells = [F.count("*").alias("distinct"), F.first("_n").alias("_n")]
    for k, p in enumerate(shares):
        place = (F.col("_n") - 1) * float(p)
        cells += [F.min(F.when(holds(F.floor(place)), F.col(value))).alias(f"_lo{k}"), F.max(F.when(holds(F.ceil(place)), F.col(value))).alias(f"_hi{k}")]
    wide = marked.groupBy(*keys).agg(*cells)
    part = lambda p: (F.col("_n") - 1) * float(p) - F.floor((F.col("_n") - 1) * float(p))
    q = F.array(*[F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * part(p) for k, p in enumerate(shares)])
    return wide.select(*keys, q.alias("q"), "distinct")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, distinct, mean, std, min, p01, p50, p99, max, and bias-corrected skew and kurtosis of each column.

    Corrections: G1 = g1 sqrt(n (n-1)) / (n-2), G2 = (n-1) ((n+1) g2 + 6) / ((n-2)(n-3)); null below 3 and 4 rows.
    """
    v = F.col("value")
    long = unpivot(df, columns).where(v.isNotNull())
    ordered = ordered_counts(long, ["column"], "value")
    agg = long.groupBy("column").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    agg = agg.join(quantiles_of(ordered, ["column"], "value", [0.01, 0.5, 0.99], agg).withColumnRenamed("distinct", "n_distinct"), "column")
    n = F.col("n").cast("double")
    return agg.select(
        "column", "n", "n_distinct", "mean", "std", "min",
        *[F.col("q")[k].alias(name) for k, name in enumerate(["p01", "p50", "p99"])],
        "max",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond three standard deviations, and beyond 1.5 quartile ranges, of each column: counts and shares."""
    long = unpivot(df, columns).where("value is not null")
    ordered = ordered_counts(long, ["column"], "value")
    marks = long.groupBy("column").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    marks = marks.join(quantiles_of(ordered, ["column"], "value", [0.25, 0.75], marks), "column").drop("n", "distinct")
    v, low, high, n = F.col("value"), F.col("q")[0], F.col("q")[1], F.col("count")
    far = F.abs(v - F.col("m")) > 3 * F.col("s")
    fence = (v < low - 1.5 * (high - low)) | (v > high + 1.5 * (high - low))
    # one row per column name; the counted values stand for the rows
    sums = ordered.join(F.broadcast(marks), "column").groupBy("column").agg(F.sum(n).alias("n"), F.sum(F.when(far, n).otherwise(0)).alias("n_z3"), F.sum(F.when(fence, n).otherwise(0)).alias("n_tukey"))
    return sums.select("column", "n", "n_z3", "n_tukey", (F.col("n_z3") / F.col("n")).alias("share_z3"), (F.col("n_tukey") / F.col("n")).alias("share_tukey"))


def rank_table(df: DataFrame, column: str, out: str = "rank", buckets: int = 64) -> DataFrame:
    """(_v, out): the tie-averaged rank of each distinct value that is not null."""
    ordered = ordered_counts(df.select(F.lit(0).alias("_g"), F.col(column).alias("_v")), ["_g"], "_v", buckets)
    return ordered.select("_v", (F.col("below") + (F.col("count") + 1) / 2).alias(out))


def average_rank(df: DataFrame, column: str, out: str = "rank", buckets: int = 64) -> DataFrame:
    """df with the tie-averaged rank of a column (1 .. n); null values get null."""
    return df.join(rank_table(df, column, out, buckets), F.col(column) == F.col("_v"), "left").drop("_v")


def moments_matrix(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariance) of the rows without nulls, from one aggregate; the matrix has len(columns)^2 cells.

    Values are shifted by a first estimate of the mean, so that large offsets do not cancel.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    first = rows.agg(F.count("*"), *[F.avg(c) for c in columns]).first()
    n = int(first[0])
    d = len(columns)
    if not n:
        return 0, np.full(d, np.nan), np.full((d, d), np.nan)
    shift = np.array([float(x) for x in first[1:]])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cells = []
    for start in range(0, len(pairs), 400):  # expressions of one projection stay small enough to compile
        part = pairs[start : start + 400]
        cells += list(rows.agg(*[F.avg((F.col(columns[i]) - float(shift[i])) * (F.col(columns[j]) - float(shift[j]))) for i, j in part]).first())
    cov = np.zeros((d, d))
    for (i, j), v in zip(pairs, cells):
        cov[i, j] = cov[j, i] = float(v)
    return n, shift, cov


def correlation_pairs(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, rho) for the pairs a before b of columns, over rows in which no column is null."""
    rows = df.select(*columns).dropna()
    if method == "spearman":
        # every rank table comes from the rows themselves, so that the plan grows with the columns, not with their powers
        base = rows
        for c in columns:
            ranks = rank_table(base, c, "_rank")
            rows = rows.join(ranks, F.col(c) == F.col("_v")).drop("_v", c).withColumnRenamed("_rank", c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = rows.agg(*[F.corr(a, b).alias(f"{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{k}`").alias("rho")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(cells).alias("e")).select("e.*")


def zero_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column) for columns with at most one distinct value, null counting as a value; an empty table has them all."""
    spread = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(c).alias("n")).alias(c) for c in columns])
    flat = F.array(*[F.struct(F.lit(c).alias("column"), ((F.col(c)["n"] == 0) | ((F.col(c)["nulls"] == 0) & F.col(c)["lo"].eqNullSafe(F.col(c)["hi"]))).alias("constant")) for c in columns])
    return spread.select(F.explode(flat).alias("e")).where("e.constant").select("e.column")


def spearman_of_pairs(long: DataFrame, pair: str, a: str, b: str) -> DataFrame:
    """(pair, n, distinct_a, distinct_b, rho) of rows (pair, a, b): the rank correlation within every pair, in one plan."""
    rank = lambda side: ordered_counts(long, [pair], side).select(pair, side, (F.col("below") + (F.col("count") + 1) / 2).alias(f"_r{side}"))
    ranked = long.join(rank(a), [pair, a]).join(rank(b), [pair, b])
    return ranked.groupBy(pair).agg(F.count("*").alias("n"), F.min(f"_r{a}").alias("_la"), F.max(f"_r{a}").alias("_ha"), F.min(f"_r{b}").alias("_lb"), F.max(f"_r{b}").alias("_hb"), F.corr(f"_r{a}", f"_r{b}").alias("rho")).select(
        pair, "n", (F.col("_la") == F.col("_ha")).alias("constant_a"), (F.col("_lb") == F.col("_hb")).alias("constant_b"), "rho"
    )


def redundant_columns(df: DataFrame, columns: list[str], threshold: float, active_only: bool = True, min_active: int = 30) -> list[dict]:
    """Greedy walk in the order given: a column is dropped if its |Spearman rho| with a kept one reaches the threshold,
    and, with active_only, also on the rows where either is non-zero (if there are at least min_active, and not all).

    Two plans, however many columns: correlations of all pairs, and of the active rows of the pairs above the threshold. The
    walk sees one number per pair of columns.
    """
    rho = {(r.a, r.b): r.rho for r in correlation_pairs(df, columns, "spearman").collect()}
    near = [k for k, v in rho.items() if v is not None and abs(v) >= threshold]
    active: dict[tuple[str, str], float | None] = {}
    if active_only and near:
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
        live = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for k, (a, b) in enumerate(near)]), lambda e: (e["a"] != 0) | (e["b"] != 0))).alias("e")
        every = rows.count()
        for r in spearman_of_pairs(rows.select(live).select("e.*"), "pair", "a", "b").collect():
            if min_active <= r.n < every:
                active[near[r.pair]] = 1.0 if r.constant_a and r.constant_b else None if r.rho is None else abs(r.rho)
    kept: list[str] = []
    dropped = []
    for c in columns:
        for k in kept:
            overall = rho.get((k, c))
            if overall is None or not abs(overall) >= threshold:
                continue
            if (k, c) in active and not (active[k, c] is not None and active[k, c] >= threshold):
                continue
            dropped.append({"dropped": c, "kept": k, "rho": abs(overall), "rho_active": active.get((k, c))})
            break
        else:
            kept.append(c)
    return dropped


def summarize_curves(df: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Mean, sample standard deviation (null for one row) and count over seeds."""
    return df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))


def loglog_slope(df: DataFrame, n: str, err: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope of ln err on ln n; rows that are not positive are left out."""
    rows = df.where((F.col(n) > 0) & (F.col(err) > 0))
    return rows.groupBy(*(by or [])).agg(F.regr_slope(F.ln(err), F.ln(n)).alias("slope"))


# small matrices, on the driver


def participation_ratio(eigenvalues: np.ndarray) -> float:
    """(sum of l)^2 / sum of l^2, negative values counting as 0."""
    l = np.maximum(np.asarray(eigenvalues, float), 0)
    return float(l.sum() ** 2 / (l @ l))


def components_for_share(eigenvalues: np.ndarray, share: float) -> int:
    """The smallest number of largest eigenvalues that hold the share of the total."""
    l = np.sort(np.maximum(np.asarray(eigenvalues, float), 0))[::-1]
    return 1 + int(np.sum(np.cumsum(l) / l.sum() < share - 1e-12))


def condition_number(eigenvalues: np.ndarray, floor: float = 1e-12) -> float:
    l = np.asarray(eigenvalues, float)
    return float(np.sqrt(l.max() / l.min())) if l.min() > floor * l.max() else float("inf")


def variance_inflation(cov: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse correlation matrix; infinite where it is singular or numerically negative."""
    sd = np.sqrt(np.diag(cov))
    with np.errstate(all="ignore"):
        corr = cov / np.outer(sd, sd)
        try:
            diagonal = np.diag(np.linalg.inv(corr))
        except np.linalg.LinAlgError:
            return np.full(len(sd), np.inf)
    return np.where(diagonal < 0, np.inf, diagonal)


def _neighbour_radius(x: np.ndarray, y: np.ndarray, k: int, leaf: int = 64) -> np.ndarray:
    """Chebyshev distance of each point of the plane to its k-th neighbour, exact.

    Points are halved along the longer side of their box down to leaves. A leaf's own points bound its radii; then only
    leaves whose boxes come nearer than the largest bound are looked at.
    """
    parts, leaves = [np.arange(len(x))], []
    while parts:
        part = parts.pop()
        if len(part) <= max(leaf, 2 * k + 2):
            leaves.append(part)
            continue
        side = x[part] if np.ptp(x[part]) >= np.ptp(y[part]) else y[part]
        order = np.argpartition(side, len(part) // 2)
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    box = np.array([(x[p].min(), x[p].max(), y[p].min(), y[p].max()) for p in leaves])
    radius = np.empty(len(x))
    away = lambda p, q: np.maximum(np.abs(x[p, None] - x[None, q]), np.abs(y[p, None] - y[None, q]))
    for p, (x0, x1, y0, y1) in zip(leaves, box):
        best = np.partition(away(p, p), k, axis=1)[:, : k + 1]
        reach = best[:, k].max()
        gap = np.maximum(np.maximum(box[:, 0] - x1, x0 - box[:, 1]), np.maximum(box[:, 2] - y1, y0 - box[:, 3]))
        near = np.flatnonzero(gap < reach)
        near = near[np.argsort(gap[near], kind="stable")]
        for start in range(0, len(near), 256):
            open_ = [leaves[m] for m in near[start : start + 256] if gap[m] < best[:, k].max() and leaves[m] is not p]
            if open_:
                best = np.partition(np.concatenate([best, away(p, np.concatenate(open_))], 1), k, axis=1)[:, : k + 1]
        radius[p] = best[:, k]
    return radius


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate of mutual information (nats) of two continuous columns; never negative.

    Each point's radius is its Chebyshev distance to the k-th neighbour in the plane; the counts of points strictly within
    the radius along either axis enter through the digamma function.
    """
    n = len(x)
    if n <= k or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    radius = _neighbour_radius(x, y, k)
    radius = np.nextafter(radius, 0)

    def near(v: np.ndarray) -> np.ndarray:
        s = np.sort(v)
        return np.searchsorted(s, v + radius, "right") - np.searchsorted(s, v - radius, "left")

    return max(0.0, float(digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - digamma(near(x)).mean() - digamma(near(y)).mean()))


def digamma(v: np.ndarray) -> np.ndarray:
    """Digamma function of positive numbers, by recurrence and asymptotic series."""
    v = np.asarray(v, float).copy()
    out = np.zeros_like(v)
    for _ in range(6):
        small = v < 6
        out[small] -= 1 / v[small]
        v[small] += 1
    i2 = 1 / (v * v)
    return out + np.log(v) - 0.5 / v - i2 * (1 / 12 - i2 * (1 / 120 - i2 / 252))


def rank_features(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(feature, mi, spearman, mi_rank): constant columns left out, ties in the order given.

    Everything uses all rows. Mutual information is the nearest-neighbour estimate, one task a feature, which holds that
    column and y.
    """
    spark = df.sparkSession
    constant = {r.column for r in zero_variance(df, features).collect()}
    live = [f for f in features if f not in constant]
    rows = df.select(*live, y).dropna()

    def estimate(part: pa.Table) -> pa.Table:
        k, a, b = (part.column(c).to_numpy() for c in ("k", "a", "b"))
        order = np.lexsort((b, a))  # sums don't depend on how rows arrive
        return pa.table({"k": k[:1], "mi": [mutual_information(a[order], b[order])]})

    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).cast("double").alias("a"), F.col(y).cast("double").alias("b")) for k, f in enumerate(live)])).alias("e")).select("e.*") if live else None
    mi = {f: 0.0 for f in live} | ({live[r.k]: r.mi for r in long.groupBy("k").applyInArrow(estimate, "k int, mi double").collect()} if live else {})
    rho = {r.a: r.rho for r in correlation_pairs(rows, [*live, y], "spearman").where(F.col("b") == y).collect()} if live else {}
    order = sorted(live, key=lambda f: -mi[f])
    return spark.createDataFrame([(f, mi[f], rho.get(f), k + 1) for k, f in enumerate(order)], "feature string, mi double, spearman double, mi_rank int")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins over [low, high); 0 and bins + 1 hold what lies outside."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, ranges: tuple[float, float, float, float], bins: tuple[int, int]) -> DataFrame:
    """(bin_x, bin_y, n) of equal cells over [x0, x1) x [y0, y1); rows outside or with a null are left out."""
    x0, x1, y0, y1 = ranges
    cell = lambda c, a, b, k: F.width_bucket(F.col(c).cast("double"), F.lit(float(a)), F.lit(float(b)), F.lit(k))
    rows = df.select(cell(x, x0, x1, bins[0]).alias("bin_x"), cell(y, y0, y1, bins[1]).alias("bin_y"))
    return rows.where(F.col("bin_x").between(1, bins[0]) & F.col("bin_y").between(1, bins[1])).groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def shares(df: DataFrame, flags: dict[str, Column], by: list[str]) -> DataFrame:
    """Share of rows for which each flag holds, per group."""
    return df.groupBy(*by).agg(*[F.avg(f.cast("int")).alias(name) for name, f in flags.items()])
