"""Queries of statistics and relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as rel
from tessera.operators import statistics as st
from tessera.plans.views import M, molecules, rounded, table

S, D = SparkSession, str


def q01_anova(spark: S, d: D) -> DataFrame:
    return rounded(st.group_variance(molecules(spark, d, "mu"), "mu", "f", 5))


def _with_mean(spark: S, d: D) -> DataFrame:
    m = molecules(spark, d, "mu", "n_heavy").where("mu is not null")
    means = m.groupBy("f").agg(F.avg("mu").alias("pred"))
    return m.join(means, "f")


def q02_error_by_group(spark: S, d: D) -> DataFrame:
    return rounded(st.error_by_group(_with_mean(spark, d), "mu", "pred", "n_heavy"))


def q03_scores_tail(spark: S, d: D) -> DataFrame:
    return rounded(st.scores(_with_mean(spark, d), "mu", "pred", 4.0))


def _rules(spark: S, d: D) -> tuple[DataFrame, DataFrame]:
    m = molecules(spark, d, "mu", "freqs", "n_atoms", "gap", "homo", "lumo")
    n, k = F.size("freqs"), F.col("n_atoms")
    rules = [
        (1, "no dipole", F.col("mu").isNull()),
        (2, "frequency list", ~F.coalesce(n.isin(3 * k - 6, 3 * k - 5), F.lit(False))),
        (3, "gap", F.abs(F.col("gap") - (F.col("lumo") - F.col("homo"))) > 1.5e-4),
    ]
    named = F.explode(F.array(*[F.when(c, F.struct(F.lit(o).alias("ord"), F.lit(r).alias("rule"))) for o, r, c in rules]))
    return m.select("id"), m.select("id", named.alias("e")).where("e is not null").select("e.ord", "e.rule", "id")


def q04_exclusion_report(spark: S, d: D) -> DataFrame:
    return rel.exclusion_report(*_rules(spark, d))


def q05_kept_rows(spark: S, d: D) -> DataFrame:
    return rel.kept_rows(*_rules(spark, d))


def q06_duplicate_groups(spark: S, d: D) -> DataFrame:
    return rel.duplicate_groups(table(spark, d, "documents").where("text is not null"), ["text"], "doc_id")


def q07_duplicate_extras(spark: S, d: D) -> DataFrame:
    return rel.duplicate_extras(table(spark, d, "documents").where("text is not null"), ["text"], "doc_id")


def q08_value_share(spark: S, d: D) -> DataFrame:
    return rounded(st.value_share(molecules(spark, d, "n_heavy"), "n_heavy"))


def q09_cumulative_share(spark: S, d: D) -> DataFrame:
    return rounded(st.cumulative_share(molecules(spark, d), "f"))


def q10_group_summary(spark: S, d: D) -> DataFrame:
    return molecules(spark, d, "n_heavy").groupBy("n_heavy").agg(F.count("*").alias("molecules"), F.count_distinct("f").alias("formulas"))


SETS = ["pool", "test_unseen", "test_familiar", "dev", "dev_unseen", "test_unseen_q", "test_familiar_q"]


def q11_pivot(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "split_set").select("build_id", "set_name", "id", "n_heavy").distinct()
    return rel.pivot(rows, ["n_heavy"], "set_name", SETS, F.count(F.lit(1)), 0)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q12_correlation_pairs(spark: S, d: D) -> DataFrame:
    return rounded(st.correlation_pairs(table(spark, d, "lineitem"), NUMBERS))


def q13_bins(spark: S, d: D) -> DataFrame:
    labels = ["low", "middle", "high"]
    binned = molecules(spark, d, "mu").withColumn("band", rel.bins(F.col("mu"), [0.0, 2.0, 4.0, float("inf")], labels)).withColumn("closed", rel.bins(F.col("mu"), [0.0, 2.0, 4.0, float("inf")], labels, right=True))
    return binned.groupBy("band", "closed").agg(F.count("*").alias("n"))


def q14_case_when(spark: S, d: D) -> DataFrame:
    balance = F.col("c_acctbal")
    kind = rel.choose([(balance < 0, "debt"), (F.col("c_mktsegment") == "BUILDING", "building"), (balance > 9000, "rich")], "neither")
    return table(spark, d, "customer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def q15_top_per_group(spark: S, d: D) -> DataFrame:
    rows = rel.top_per_group(molecules(spark, d, "mu").where("mu is not null"), ["f"], [F.col("mu").desc(), "id"], 3, "place")
    return rounded(rows.select("f", "id", "mu", "place"))


def q16_argmin_ties_first(spark: S, d: D) -> DataFrame:
    return rounded(rel.argmin_rows(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", "s_suppkey"))


PROPERTIES = ["mu", "alpha", "homo", "lumo", "gap", "cv"]


def q17_describe(spark: S, d: D) -> DataFrame:
    return rounded(st.describe(molecules(spark, d, *PROPERTIES), PROPERTIES), 7)


def q18_outliers(spark: S, d: D) -> DataFrame:
    return rounded(st.outliers(molecules(spark, d, *PROPERTIES), PROPERTIES))


def q19_histogram(spark: S, d: D) -> DataFrame:
    return st.histogram(molecules(spark, d, "mu"), "mu", 0.0, 10.0, 20)


def q21_spearman(spark: S, d: D) -> DataFrame:
    return rounded(st.correlation_pairs(table(spark, d, "part"), ["p_size", "p_retailprice"], "spearman"))


def q22_average_rank(spark: S, d: D) -> DataFrame:
    return st.average_rank(table(spark, d, "part").select("p_partkey", "p_size"), "p_size")


def q22_redundant_columns(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("twice", F.col("l_quantity") * 2).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    found = st.redundant_columns(rows, [*NUMBERS, "twice", "net"], 0.95)
    return spark.createDataFrame([(r["dropped"], r["kept"], round(r["rho"], 6)) for r in found], "dropped string, kept string, rho double")


def q23_zero_variance(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("double"))
    return st.zero_variance(rows, ["o_orderkey", "o_orderstatus", "one", "none"])


def q44_paired_delta(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return rounded(rel.paired_delta(rows, ["user_id"], "event_type", "v", "click"))


def q45_reproduction_gap(spark: S, d: D) -> DataFrame:
    a = table(spark, d, "molecules").where("mu is not null").groupBy("id").agg(F.max("mu").alias("mu"), F.max("gap").alias("gap"))
    b = table(spark, d, "molecules").where("mu is not null").groupBy("id").agg(F.min("mu").alias("mu"), F.min("gap").alias("gap"))
    return rounded(rel.reproduction_gap(a, b, ["id"], ["mu", "gap"]))


def q46_loglog_slope(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("price"))
    return rounded(st.loglog_slope(rows, "l_quantity", "price"))


def q47_one_se_rule(spark: S, d: D) -> DataFrame:
    from tessera.operators.linear import one_standard_error

    curve = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg("l_extendedprice").alias("mean"), (F.stddev_samp("l_extendedprice") / F.sqrt(F.count("*"))).alias("se"))
    return one_standard_error(curve, "l_linenumber", "mean", "se").select("l_linenumber")


def q48_json_details(spark: S, d: D) -> DataFrame:
    value = rel.json_number(F.col("props"), "$.k", -1.0)
    return rounded(table(spark, d, "events").groupBy("event_type").agg(F.sum(value).alias("total"), F.count_if(value == -1.0).alias("missing")), 3)


def q49_config_hash(spark: S, d: D) -> DataFrame:
    from tessera.operators.provenance import config_hash_column

    return table(spark, d, "events").select("event_id", config_hash_column(F.col("props")).alias("hash"))


def q66_cells_won(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_extendedprice").alias("price"))
    return rounded(rel.cells_won(rows, ["l_suppkey"], "l_returnflag", "price"))


def q67_set_operations(spark: S, d: D) -> DataFrame:
    a = table(spark, d, "split_set").select("id").distinct()
    b = table(spark, d, "atom_environment").select("id").distinct()
    both, only, any_ = a.intersect(b), a.exceptAll(b).distinct(), a.union(b).distinct()
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
    return one(both, "intersect").unionByName(one(only, "except")).unionByName(one(any_, "union"))


def q68_seed_summary(spark: S, d: D) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return rounded(st.summarize_curves(rows, "v", ["event_type"]))


def q69_flag_shares(spark: S, d: D) -> DataFrame:
    return rounded(st.shares(molecules(spark, d, "mu", "n_heavy").where("mu is not null"), {"polar": F.col("mu") > 3, "apolar": F.col("mu") < 0.5}, ["n_heavy"]))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q") and callable(f)}

_LONG = "long AS (SELECT unnest(['mu','alpha','homo','lumo','gap','cv']) AS \"column\", unnest([mu, alpha, homo, lumo, gap, cv]) AS v FROM m)"
_RULES = """rules AS (SELECT 1 AS ord, 'no dipole' AS rule, id FROM m WHERE mu IS NULL
 UNION ALL SELECT 2, 'frequency list', id FROM m WHERE NOT coalesce(len(freqs) IN (3 * n_atoms - 6, 3 * n_atoms - 5), false)
 UNION ALL SELECT 3, 'gap', id FROM m WHERE abs(gap - (lumo - homo)) > 1.5e-4)"""
_GROUPS = "g AS (SELECT md5(text) AS k, min(doc_id) AS label, count(*) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
_PRED = "p AS (SELECT *, avg(mu) OVER (PARTITION BY f) AS pred FROM m WHERE mu IS NOT NULL)"


def _corr(table_: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM {table_}" for a, b in pairs)


SQL = {
    "q01_anova": f"""WITH {M}, r AS (SELECT f, mu, count(*) OVER (PARTITION BY f) c, avg(mu) OVER (PARTITION BY f) gm FROM m WHERE mu IS NOT NULL AND f IS NOT NULL),
 k AS (SELECT * FROM r WHERE c >= 5), o AS (SELECT avg(mu) AS om FROM k),
 s AS (SELECT count(*) n, count(DISTINCT f) k, sum((mu - om) ** 2) t, sum((mu - gm) ** 2) w, avg(abs(mu - gm)) a FROM k, o)
 SELECT n, k, round((t - w) / t, 6) AS eta2, round((t - w - (k - 1) * (w / (n - k))) / (t + w / (n - k)), 6) AS omega2, round(sqrt(t / (n - 1)), 6) AS total_std,
 round(sqrt(w / (n - k)), 6) AS within_std, round(a, 6) AS within_mae FROM s""",
    "q02_error_by_group": f"WITH {M}, {_PRED} SELECT n_heavy, count(*) AS n, round(avg(abs(pred - mu)), 6) AS mae, round(sqrt(avg((pred - mu) ** 2)), 6) AS rmse, round(avg(pred - mu), 6) + 0.0 AS bias FROM p WHERE n_heavy IS NOT NULL GROUP BY n_heavy",
    "q03_scores_tail": f"WITH {M}, {_PRED} SELECT round(avg(abs(pred - mu)), 6) AS mae, round(sqrt(avg((pred - mu) ** 2)), 6) AS rmse, round(sqrt(avg((pred - mu) ** 2) FILTER (mu < 4)), 6) AS rmse_below_tail, round(1 - avg((pred - mu) ** 2) / var_pop(mu), 6) AS r2, round(avg(pred - mu), 6) + 0.0 AS bias, count(*) AS n_eval FROM p",
    "q04_exclusion_report": f"WITH {M}, {_RULES}, first AS (SELECT id, min(ord) AS ord FROM rules GROUP BY id) SELECT r.ord, r.rule, count(DISTINCT r.id) AS listed, count(DISTINCT f.id) AS newly_removed FROM rules r LEFT JOIN first f ON f.id = r.id AND f.ord = r.ord GROUP BY 1, 2",
    "q05_kept_rows": f"WITH {M}, {_RULES} SELECT id FROM m WHERE id NOT IN (SELECT id FROM rules)",
    "q06_duplicate_groups": f"WITH {_GROUPS} SELECT doc_id, label, size FROM documents JOIN g ON md5(text) = k",
    "q07_duplicate_extras": f"WITH {_GROUPS} SELECT doc_id FROM documents JOIN g ON md5(text) = k WHERE doc_id <> label",
    "q08_value_share": f"WITH {M} SELECT n_heavy, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m WHERE n_heavy IS NOT NULL GROUP BY n_heavy",
    "q09_cumulative_share": f"WITH {M}, c AS (SELECT f, count(*) AS n FROM m WHERE f IS NOT NULL GROUP BY f) SELECT f, n, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, f) AS place, round(sum(n) OVER (ORDER BY n DESC, f ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share FROM c",
    "q10_group_summary": f"WITH {M} SELECT n_heavy, count(*) AS molecules, count(DISTINCT f) AS formulas FROM m GROUP BY n_heavy",
    "q11_pivot": "WITH r AS (SELECT DISTINCT build_id, set_name, id, n_heavy FROM split_set) SELECT n_heavy, " + ", ".join(f"count(*) FILTER (set_name = '{s}') AS {s}" for s in SETS) + " FROM r GROUP BY n_heavy",
    "q12_correlation_pairs": _corr("lineitem", NUMBERS),
    "q13_bins": f"""WITH {M} SELECT CASE WHEN mu >= 0 AND mu < 2 THEN 'low' WHEN mu >= 2 AND mu < 4 THEN 'middle' WHEN mu >= 4 THEN 'high' END AS band,
 CASE WHEN mu > 0 AND mu <= 2 THEN 'low' WHEN mu > 2 AND mu <= 4 THEN 'middle' WHEN mu > 4 THEN 'high' END AS closed, count(*) AS n FROM m GROUP BY 1, 2""",
    "q14_case_when": "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'building' WHEN c_acctbal > 9000 THEN 'rich' ELSE 'neither' END AS kind, count(*) AS n FROM customer GROUP BY 1",
    "q15_top_per_group": f"WITH {M} SELECT f, id, round(mu, 6) AS mu, row_number() OVER (PARTITION BY f ORDER BY mu DESC, id) AS place FROM m WHERE mu IS NOT NULL QUALIFY place <= 3",
    "q16_argmin_ties_first": "SELECT s_nationkey, s_suppkey, round(s_acctbal, 6) AS s_acctbal FROM supplier WHERE s_acctbal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) = 1",
    "q17_describe": f"""WITH {M}, {_LONG} SELECT "column", count(*) AS n, count(DISTINCT v) AS n_distinct, round(avg(v), 7) AS mean, round(stddev_samp(v), 7) AS std, round(min(v), 7) AS "min",
 round(quantile_cont(v, 0.01), 7) AS p01, round(quantile_cont(v, 0.5), 7) AS p50, round(quantile_cont(v, 0.99), 7) AS p99, round(max(v), 7) AS "max", round(skewness(v), 7) AS skew, round(kurtosis(v), 7) AS kurtosis FROM long WHERE v IS NOT NULL GROUP BY 1""",
    "q18_outliers": f"""WITH {M}, {_LONG}, s AS (SELECT "column", avg(v) a, stddev_samp(v) sd, quantile_cont(v, 0.25) lo, quantile_cont(v, 0.75) hi FROM long WHERE v IS NOT NULL GROUP BY 1),
 b AS (SELECT long."column", abs(v - a) > 3 * sd AS z, v < lo - 1.5 * (hi - lo) OR v > hi + 1.5 * (hi - lo) AS t FROM long JOIN s ON s."column" = long."column" WHERE v IS NOT NULL)
 SELECT "column", count(*) AS n, count(*) FILTER (z) AS n_z3, count(*) FILTER (t) AS n_tukey, round(avg(z::INT), 6) AS share_z3, round(avg(t::INT), 6) AS share_tukey FROM b GROUP BY 1""",
    "q19_histogram": f"WITH {M} SELECT CASE WHEN mu < 0 THEN 0 WHEN mu >= 10 THEN 21 ELSE floor(mu * 2)::BIGINT + 1 END AS bin, count(*) AS n FROM m WHERE mu IS NOT NULL GROUP BY 1",
    "q21_spearman": "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(r.a, r.b), 6) AS rho FROM r",
    "q22_average_rank": "SELECT p_partkey, p_size, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)::DOUBLE AS rank FROM part",
    "q23_zero_variance": "SELECT 'one' AS \"column\" UNION ALL SELECT 'none'",
    "q44_paired_delta": "WITH r AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, v AS base FROM r WHERE event_type = 'click') SELECT event_type, count(v - base) AS n, round(avg(v - base), 6) AS mean_delta, round(stddev_samp(v - base), 6) AS std_delta FROM r JOIN b USING (user_id) WHERE event_type <> 'click' GROUP BY 1",
    "q45_reproduction_gap": "WITH r AS (SELECT id, max(mu) - min(mu) AS a, max(gap) - min(gap) AS b FROM molecules WHERE mu IS NOT NULL AND id IS NOT NULL GROUP BY id) SELECT count(*) AS n, round(max(a), 6) AS gap_mu, round(max(b), 6) AS gap_gap FROM r",
    "q46_loglog_slope": "WITH r AS (SELECT l_quantity, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1) SELECT round(regr_slope(ln(price), ln(l_quantity)), 6) AS slope FROM r WHERE price > 0 AND l_quantity > 0",
    "q47_one_se_rule": "WITH c AS (SELECT l_linenumber, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1), b AS (SELECT mean + se AS bar FROM c ORDER BY mean, l_linenumber LIMIT 1) SELECT min(l_linenumber) AS l_linenumber FROM c, b WHERE mean <= bar",
    "q48_json_details": "SELECT event_type, round(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1)), 3) AS total, count(*) FILTER (coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) = -1) AS missing FROM events GROUP BY 1",
    "q49_config_hash": "SELECT event_id, substr(sha256(props), 1, 12) AS hash FROM events",
    "q66_cells_won": "WITH r AS (SELECT l_suppkey, l_returnflag, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2), b AS (SELECT *, min(price) OVER (PARTITION BY l_suppkey) AS best FROM r) SELECT l_returnflag, round(avg((price = best)::INT), 6) AS won FROM b GROUP BY 1",
    "q67_set_operations": "SELECT 'intersect' AS operation, count(*) AS n FROM (SELECT id FROM split_set INTERSECT SELECT id FROM atom_environment) UNION ALL SELECT 'except', count(*) FROM (SELECT id FROM split_set EXCEPT SELECT id FROM atom_environment) UNION ALL SELECT 'union', count(*) FROM (SELECT id FROM split_set UNION SELECT id FROM atom_environment)",
    "q68_seed_summary": "WITH r AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS n FROM r GROUP BY 1",
    "q69_flag_shares": f"WITH {M} SELECT n_heavy, round(avg((mu > 3)::INT), 6) AS polar, round(avg((mu < 0.5)::INT), 6) AS apolar FROM m WHERE mu IS NOT NULL GROUP BY 1",
}
