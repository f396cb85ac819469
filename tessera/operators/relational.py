"""Relational operators with the semantics of ordered, labelled tables, on unordered DataFrames.

Order is always a column; ties are broken by stated columns; first means smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingKeys(KeyError):
    """A lookup named keys that the table does not have."""


def exclusion_report(table: DataFrame, rules: DataFrame, ident: str = "id") -> DataFrame:
    """(ord, rule, listed, newly_removed) of ordered rules (ord, rule, ident).

    listed: distinct identifiers the rule names; newly_removed: those in the table that no earlier rule removed.
    """
    named = rules.select("ord", "rule", ident).where(F.col(ident).isNotNull()).distinct()
    first = named.groupBy(ident).agg(F.min("ord").alias("ord"))
    removed = first.join(table.select(ident).distinct(), ident, "left_semi").groupBy("ord").agg(F.count("*").alias("newly_removed"))
    listed = named.groupBy("ord", "rule").agg(F.count("*").alias("listed"))
    return listed.join(removed, "ord", "left").select("ord", "rule", "listed", F.coalesce("newly_removed", F.lit(0)).alias("newly_removed"))


def kept_rows(table: DataFrame, rules: DataFrame, ident: str = "id") -> DataFrame:
    """The rows that no rule names."""
    return table.join(rules.select(ident).where(F.col(ident).isNotNull()), ident, "left_anti")


def duplicate_groups(df: DataFrame, keys: list[str | Column], ident: str = "id") -> DataFrame:
    """(ident, label, size) of the rows whose keys agree with another row's; label is the smallest identifier.

    Null keys agree with each other. Only counts and labels are joined back, groups are never gathered.
    """
    key = F.xxhash64(*keys)
    named = df.select(F.col(ident), key.alias("_h"), F.struct(*keys).alias("_k"))
    groups = named.groupBy("_h", "_k").agg(F.min(ident).alias("label"), F.count("*").alias("size")).where("size > 1")
    return named.alias("a").join(groups.alias("b"), (F.col("a._h") == F.col("b._h")) & F.col("a._k").eqNullSafe(F.col("b._k"))).select(f"a.{ident}", "label", "size")


def duplicate_extras(df: DataFrame, keys: list[str | Column], ident: str = "id") -> DataFrame:
    """Identifiers of all members of duplicate groups but the smallest."""
    return duplicate_groups(df, keys, ident).where(F.col(ident) != F.col("label")).select(ident)


def ordered_lookup(wanted: DataFrame, table: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """wanted (pos, key) joined to the table, in order of pos; raises MissingKeys if a key is not there."""
    missing = wanted.join(table, key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise MissingKeys([r[0] for r in missing])
    return wanted.join(table, key).orderBy(pos)


def latest(df: DataFrame, keys: list[str], order: list[str | Column], descending: bool = False) -> DataFrame:
    """One row per key, the first in the order given (or the last): distinct on a subset, keep first."""
    return top_per_group(df, keys, [F.col(o).desc() if descending else o for o in order], 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; limited map-side before the shuffle, so that a hot group moves k rows a task."""
    n = rank or "_n"
    found = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) <= k)
    return found if rank else found.drop(n)


def argmin_rows(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the smallest value per group, the first in order of `tie` among equals; null values never win."""
    return top_per_group(df.where(F.col(value).isNotNull()), keys, [value, tie], 1)


def bins(column: Column, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Label of the interval of a value: [lo, hi), or (lo, hi] with right; null outside and for null."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        inside = ((column > low) & (column <= high)) if right else ((column >= low) & (column < high))
        case = case.when(inside & ~F.isnan(column.cast("double")), F.lit(label))
    return case


def choose(cases: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(default))
    for condition, value in cases:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def paired_delta(df: DataFrame, pair: list[str], model: str, metric: str, reference: str) -> DataFrame:
    """(model, n, mean_delta, std_delta): differences from the reference model within each pair."""
    base = df.where(F.col(model) == reference).select(*pair, F.col(metric).alias("_base"))
    both = df.where(F.col(model) != reference).join(base, pair)
    d = F.col(metric) - F.col("_base")
    return both.groupBy(model).agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("std_delta"))


def reproduction_gap(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(n, max |a - b| of each metric) over the keys that both tables have."""
    right = b.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    return a.join(right, keys).agg(F.count("*").alias("n"), *[F.max(F.abs(F.col(m) - F.col(f"_{m}"))).alias(f"gap_{m}") for m in metrics])


def cells_won(df: DataFrame, cell: list[str], option: str, metric: str) -> DataFrame:
    """Share of cells in which an option has the smallest metric (ties win together)."""
    best = df.groupBy(*cell).agg(F.min(metric).alias("_best"))
    return df.join(best, cell).groupBy(option).agg(F.avg((F.col(metric) == F.col("_best")).cast("int")).alias("won"))


def pivot(df: DataFrame, rows: list[str], column: str, values: list, metric: Column, fill: object = None) -> DataFrame:
    """Wide table over given values of a column; the values are named, so no extra pass finds them."""
    wide = df.groupBy(*rows).pivot(column, values).agg(metric)
    return wide if fill is None else wide.na.fill(fill)


def pivot_table(df: DataFrame, rows: list[str], column: str, values: list, metrics: dict[str, str], how: str = "avg") -> DataFrame:
    """Wide table of several metrics, columns "<value>_<metric>"; how: avg (the default), sum, min, max or first (by the
    smallest row of a group in order of the metric)."""
    agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "first": F.min}[how]
    return df.groupBy(*rows).pivot(column, values).agg(*[agg(source).alias(name) for name, source in metrics.items()])


def reindex(df: DataFrame, keys: DataFrame, key: str, fill: dict | None = None) -> DataFrame:
    """One row for every key of a list (pos, key), in its order; keys that the table has not get nulls, or the fill values."""
    out = keys.join(df, key, "left")
    return (out.na.fill(fill) if fill else out).orderBy("pos")


def mapped(column: Column, table: dict, default=None) -> Column:
    """Dictionary lookup; values that are not in it get the default, null stays null."""
    found = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[column]
    return F.when(column.isNotNull(), F.coalesce(found, F.lit(default)))


def winners(df: DataFrame, cell: list[str], option: str, metric: str) -> DataFrame:
    """(option, cells, share): how many cells each option wins alone or together, and which share of all; options that win
    nothing have 0."""
    best = df.groupBy(*cell).agg(F.min(metric).alias("_best"))
    marked = df.join(best, cell).groupBy(option).agg(F.count_if(F.col(metric) == F.col("_best")).alias("cells"))
    return marked.join(F.broadcast(best.agg(F.count("*").alias("_n")))).select(option, "cells", F.try_divide("cells", "_n").alias("share"))


def both_ends(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k and the last k rows in an order, each end a top-k without a total sort."""
    last = df.orderBy(*[F.col(o).desc() for o in order]).limit(k)
    return df.orderBy(*order).limit(k).unionByName(last).distinct()


def token_filter(column: Column, separator: str, n: int) -> Column:
    return F.size(F.split(column, separator)) == n


def split_pair(column: Column, separator: str = r"\|", missing: str = "—") -> tuple[Column, Column]:
    """The two halves of "a|b"; a missing half becomes a dash."""
    parts = F.split(column, separator, 2)
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(missing)), F.coalesce(F.get(parts, F.lit(1)), F.lit(missing))


def json_number(column: Column, path: str, default: float | None = None) -> Column:
    """A number at a JSON path, the default where text, path or number is missing."""
    return F.coalesce(F.get_json_object(column, path).try_cast("double"), F.lit(default).cast("double"))


def same_members(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column tables hold the same distinct values."""
    left, right = a.distinct().toDF("k"), b.distinct().toDF("k")
    return left.join(right, "k", "left_anti").isEmpty() and right.join(left, "k", "left_anti").isEmpty()


def disjoint(a: DataFrame, b: DataFrame) -> bool:
    """Leakage guard: no common value."""
    return a.toDF("k").join(b.toDF("k"), "k", "left_semi").isEmpty()


def select_named(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in the given order; ValueError lists those that are not there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def quantile_band(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The rows whose value lies within two exact quantiles of the column, both ends included."""
    from tessera.operators.statistics import ordered_counts, quantiles_of

    values = df.select(F.lit(0).alias("_g"), F.col(column).cast("double").alias("_v"))
    ends = quantiles_of(ordered_counts(values, ["_g"], "_v"), ["_g"], "_v", [low, high]).select("q")  # one row
    return df.join(F.broadcast(ends)).where(F.col(column).between(F.col("q")[0], F.col("q")[1])).drop("q")


def with_group_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the exact median of each row's group; groups are counted in ranges, never gathered. Null keys get null."""
    from tessera.operators.statistics import ordered_counts, quantiles_of

    medians = quantiles_of(ordered_counts(df, keys, value), keys, value, [0.5]).select(*keys, F.col("q")[0].alias(out))
    return df.join(medians, keys, "left")


def by_size(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Rows by falling absolute value."""
    return df.orderBy(F.abs(F.col(column)).desc(), *ties)


def ordinal(column: Column, order: list) -> Column:
    """Place of a value in a stated order, for sorting; values that are not in it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), column), F.lit(0).cast("bigint")), F.lit(len(order) + 1).cast("bigint"))


def cross_section(df: DataFrame, level: str, value) -> DataFrame:
    """The rows of one value of a key, without that key."""
    return df.where(F.col(level) == value).drop(level)


def concat_columns(frames: list[DataFrame], key: str) -> DataFrame:
    """Tables side by side on a key: a row for every key that any of them has."""
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, key, "full")
    return out


def in_groups_of(df: DataFrame, key: str, least: int) -> DataFrame:
    """The rows whose key has at least so many rows."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def plus_minus(mean: Column, spread: Column, digits: int = 3) -> Column:
    """"mean ± spread" with fixed digits; the mean alone where there is no spread."""
    m, s = (F.format_string(f"%.{digits}f", c.cast("double")) for c in (mean, spread))
    return F.when(mean.isNotNull() & spread.isNotNull(), F.concat(m, F.lit(" ± "), s)).when(mean.isNotNull(), m)


def number_after(column: Column, prefix: str) -> Column:
    """The whole number after a prefix ("pls10" is 10); null without the prefix or without a number."""
    return F.when(column.startswith(prefix), F.substr(column, F.lit(len(prefix) + 1)).try_cast("int"))


def finite_check(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(column, rows, nulls, not_finite, keys): what a feature table must show zero of, and how many different keys it has."""
    bad = lambda c: F.count_if(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")))
    cells = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), *[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), bad(c).alias("not_finite")).alias(f"_{k}") for k, c in enumerate(columns)])
    return cells.select("rows", "keys", F.explode(F.array(*[F.col(f"_{k}") for k in range(len(columns))])).alias("e")).select("e.column", "rows", "e.nulls", "e.not_finite", "keys")


def sampled_rules(df: DataFrame, ident: list[str], rules: dict[str, Column], n: int, salt: str) -> DataFrame:
    """(rule, checked, violations) over the n rows first in hashed order: a top-k, no total sort. Null conditions are violations."""
    from tessera.operators.splits import draw

    some = df.orderBy(draw(salt, *ident)).limit(n)
    cells = some.agg(F.count("*").alias("checked"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{k}") for k, ok in enumerate(rules.values())])
    return cells.select("checked", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{k}").alias("violations")) for k, name in enumerate(rules)])).alias("e")).select("e.rule", "checked", "e.violations")


def leaf_order(similarity) -> list[int]:
    """Order of the leaves of an average-linkage tree over 1 - |similarity| of a small matrix (columns of a report)."""
    import numpy as np

    away = 1 - np.abs(np.asarray(similarity, float))
    clusters = {k: [k] for k in range(len(away))}
    while len(clusters) > 1:
        pairs = ((away[np.ix_(a, b)].mean(), i, j) for i, a in clusters.items() for j, b in clusters.items() if i < j)
        _, i, j = min(pairs)
        clusters[i] = clusters[i] + clusters.pop(j)
    return next(iter(clusters.values()), [])


def running_total(df: DataFrame, order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """df with the sum of `value` over all rows of a smaller whole-number `order` (distinct, from 0), in two levels: stretches
    of `width` are summed first, so no task runs over the whole table."""
    from pyspark.sql import Window

    parts = df.withColumn("_s", F.floor(F.col(order) / width))
    sums = parts.groupBy("_s").agg(F.sum(value).alias("_t"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    starts = sums.select("_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, "_s").withColumn(out, F.col("_start") + F.col("_i")).drop("_s", "_i", "_start")
