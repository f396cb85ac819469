"""Per-document text quality statistics, their distributions by language, and the documents in the tails.

Method: mergeable quantile sketches of each statistic per language; values become robust z-scores, and distribution tails
are flagged. It is used twice. Of segments, the statistic is how much its words speak for a sentence, with weights counted
over the whole corpus; a segment in the lower tail of its language's sure sentences is no sentence. Of documents, the
statistics are those of STATISTICS and the share of text in sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.prose import BUCKETS, FIRST, FIRST_WORD, OPEN, SURE, describe
from tessera.llm.prose import STATISTICS as LAYOUT
from tessera.llm.tables import read
from tessera.plans.lineage import cut

STATISTICS = [*LAYOUT, "common_ratio", "prose_ratio"]
#: Size parameter of the sketches (rank error about 1 %), and the robust z-score beyond which a value is in a tail.
SKETCH_K, TAIL_Z = 400, 3.0
#: A language's own quantiles count with its number of values, those of all languages together with this number.
SHRINK = 200.0
#: A document with less of its characters in running sentences is not prose.
PROSE = 0.5
#: Sentences' scores spread by at least this part of their median, however alike a language's sentences are.
LEAST_SPREAD = 1 / 6
#: Occurrences that speak for neither side, added to each word's counts.
NEUTRAL = 1.0
#: A word is common if at least this share of all words is the same.
COMMON = 0.002
#: Copies of a language's row that a join with its documents is spread over: one language may hold most of them.
SALT = 32


def text_segments(docs: DataFrame, ident: str, text: str, lang: str) -> DataFrame:
    """(ident, lang, LAYOUT..., buckets, counts, chars_of, kinds): one row per document; one narrow stage over whole texts.

    Null, empty and blank texts have null statistics and arrays. lang is lower-cased and trimmed, null or empty becomes 'und'.
    """
    language = F.coalesce(F.nullif(F.lower(F.trim(F.col(lang).cast("string"))), F.lit("")), F.lit("und"))
    kind = docs.schema[ident].dataType.simpleString()
    arrays = ["buckets", "counts", "chars_of", "kinds"]
    schema = f"`{ident}` {kind}, lang string, " + ", ".join(f"{s} double" for s in LAYOUT) + ", " + ", ".join(f"{a} array<int>" for a in arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = ((None,) * len(LAYOUT), [], [], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [describe(t) if t and not t.isspace() else none for t in batch.column(2).to_pylist()]
            values, *lists = zip(*rows)
            missing = np.array([v[0] is None for v in values])
            columns = [pa.array(c, pa.float64()) for c in zip(*values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *[_ragged(a, missing) for a in lists]], [ident, "lang", *LAYOUT, *arrays])

    return docs.select(ident, language.alias("lang"), text).mapInArrow(run, schema)


def _ragged(lists: tuple[list[int], ...], missing: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, offsets[-1])), mask=pa.array(missing))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, words of each segment, kind of each segment) of the columns buckets, counts, kinds."""
    words, counts, kinds = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "counts", "kinds"))
    return words, counts.astype(np.int64), kinds


def word_counts(segments: DataFrame) -> DataFrame:
    """(bucket, sure, open, seen): occurrences of words in sure sentences, in segments without a stop, and in all, over all documents.

    Repeated segments of a document count once. Each task adds up its documents; at most BUCKETS rows a task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            words, counts, kinds = _flat(batch)
            for row, bit in enumerate((SURE, OPEN, 0)):
                mask = np.repeat((kinds & FIRST > 0) & ((kinds & bit > 0) | (bit == 0)), counts)
                total[row] += np.bincount(words[mask], minlength=BUCKETS)
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at]) for t in total]], ["bucket", "sure", "open", "seen"])

    parts = segments.select("buckets", "counts", "kinds").mapInArrow(run, "bucket bigint, sure bigint, open bigint, seen bigint")
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("sure", "open", "seen")])


def word_weights(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weights, common) of the buckets: how many times likelier (as a logarithm) a word is in sure sentences than in open
    segments, 0 for words never seen, and whether it is among the common ones. BUCKETS numbers, whatever the data."""
    sure, open_, seen = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    found = counts.toArrow()  # at most BUCKETS rows
    at = found.column("bucket").to_numpy()
    sure[at], open_[at], seen[at] = (found.column(c).to_numpy() for c in ("sure", "open", "seen"))
    rest = max(1.0, sure.sum() + open_.sum())
    a, b = max(sure.sum(), 1.0) / rest, max(open_.sum(), 1.0) / rest
    weights = np.log((sure + NEUTRAL * a) / (open_ + NEUTRAL * b)) - np.log(a / b)
    often = seen >= COMMON * max(1.0, seen.sum())
    often[:FIRST_WORD] = False
    return weights.astype(np.float32), often


def segment_scores(segments: DataFrame, ident: str, weights: np.ndarray, common: np.ndarray) -> DataFrame:
    """(ident, lang, LAYOUT..., common_ratio, scores, chars_of, kinds): the mean weight of each segment's words."""
    shared = segments.sparkSession.sparkContext.broadcast((weights, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, often = shared.value
        for batch in batches:
            words, counts, _ = _flat(batch)
            owner = np.repeat(np.arange(len(counts)), counts)
            scores = np.bincount(owner, weight[words], len(counts)) / np.maximum(counts, 1)
            scores[counts == 0] = float(weight.min())
            lists = batch.column(batch.schema.get_field_index("counts"))
            offsets = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
            n = batch.column(batch.schema.get_field_index("buckets")).value_lengths().fill_null(0).to_numpy()
            share = np.bincount(np.repeat(np.arange(len(n)), n), often[words], len(n)) / np.maximum(n, 1)
            missing = lists.is_null().to_numpy(zero_copy_only=False)
            score = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(scores), mask=pa.array(missing))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in (ident, "lang", *LAYOUT)]
            last = [batch.column(batch.schema.get_field_index(c)) for c in ("chars_of", "kinds")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.where(missing, np.nan, share), from_pandas=True), score, *last], [ident, "lang", *LAYOUT, "common_ratio", "scores", "chars_of", "kinds"])

    kind = segments.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, lang string, " + ", ".join(f"{s} double" for s in [*LAYOUT, "common_ratio"]) + ", scores array<double>, chars_of array<int>, kinds array<int>"
    return segments.mapInArrow(run, schema)


def _quartiles(sketch: str) -> Column:
    return F.expr(f"array(kll_sketch_get_quantile_double({sketch}, 0.25D), kll_sketch_get_quantile_double({sketch}, 0.5D), kll_sketch_get_quantile_double({sketch}, 0.75D))")


def language_quartiles(rows: DataFrame, values: list[str]) -> DataFrame:
    """(lang, q_<value> ARRAY of three): quartiles of each value per language by mergeable sketches.

    A language's own quartiles are drawn towards those of all rows: n of its own rows against SHRINK, so that a language with
    few rows is judged mostly by all and one with many by itself, without a border between them. Null values take no part.
    """
    sketches = [F.expr(f"kll_sketch_agg_double({v}, {SKETCH_K})").alias(v) for v in values]
    by_lang = rows.groupBy("lang").agg(F.count(values[0]).alias("n"), *sketches)
    merged = [F.expr(f"kll_merge_agg_double({v})").alias(v) for v in values]
    # one row, from the sketches of the languages
    every = by_lang.where("n > 0").agg(F.sum("n").alias("n"), *merged).where("n > 0").select(*[_quartiles(v).alias(f"p_{v}") for v in values])
    own = by_lang.where("n > 0").select("lang", "n", *[_quartiles(v).alias(f"o_{v}") for v in values])
    both = by_lang.select("lang").join(own, "lang", "left").join(F.broadcast(every), how="left")
    part = F.coalesce(F.col("n") / (F.col("n") + SHRINK), F.lit(0.0))
    mix = lambda v: F.zip_with(F.coalesce(f"o_{v}", f"p_{v}"), F.col(f"p_{v}"), lambda o, p: part * o + (1 - part) * p)
    return both.select("lang", *[mix(v).alias(f"q_{v}") for v in values])


def _by_language(rows: DataFrame, ident: str, languages: DataFrame) -> DataFrame:
    salted = languages.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(SALT)).cast("int")).join(salted, ["lang", "_salt"], "left").drop("_salt")


def robust_z(value: Column, quartiles: Column) -> Column:
    """(value - median) / (interquartile range / 1.349); a range of 0 gives 0 at the median, else +-infinity."""
    spread, away = (quartiles[2] - quartiles[0]) / 1.349, value - quartiles[1]
    return F.when(spread > 0, away / spread).when(away == 0, 0.0).when(away.isNotNull(), F.signum(away) * float("inf"))


def text_statistics(docs: DataFrame, ident: str, text: str, lang: str) -> DataFrame:
    """(ident, lang, STATISTICS...): one row per document, learned from and measured on all documents.

    prose_ratio is the share of a text's characters in segments whose score is not in the lower tail (z < -TAIL_Z) of the
    sure sentences of its language (their spread at least LEAST_SPREAD of the median), repetitions left out. Null, empty and blank texts have null statistics. Without any sure
    sentence in the collection nothing is one.
    """
    segments = cut(text_segments(docs, ident, text, lang))
    weights, common = word_weights(word_counts(segments))
    scored = cut(segment_scores(segments, ident, weights, common))
    parts = F.arrays_zip(F.col("scores").alias("s"), F.col("chars_of").alias("c"), F.col("kinds").alias("k"))
    sure = scored.select("lang", F.explode(parts).alias("e")).where(F.col("e.k").bitwiseAND(FIRST | SURE) == (FIRST | SURE)).select("lang", F.col("e.s").alias("score"))
    # a language without sure sentences of its own takes the quartiles of all
    every = scored.select("lang").distinct().withColumn("score", F.lit(None).cast("double"))
    judged = _by_language(scored, ident, language_quartiles(sure.unionByName(every), ["score"]))
    spread = F.greatest((F.col("q_score")[2] - F.col("q_score")[0]) / 1.349, LEAST_SPREAD * F.col("q_score")[1])
    floor = F.coalesce(F.col("q_score")[1] - TAIL_Z * spread, F.lit(float("inf")))
    held = F.aggregate(F.filter(parts, lambda e: (e["s"] >= floor) & (e["k"].bitwiseAND(FIRST) > 0)), F.lit(0), lambda total, e: total + e["c"])
    return judged.select(ident, "lang", *LAYOUT, "common_ratio", F.when(F.col("chars").isNotNull(), F.least(held / F.col("chars"), F.lit(1.0))).alias("prose_ratio"))


def profile_table(stats: DataFrame) -> DataFrame:
    """(lang, documents, statistic, q01, q25, q50, q75, q99), lang '*' for all documents, from merged sketches."""
    some = stats.where(F.col(STATISTICS[0]).isNotNull())
    by_lang = some.groupBy("lang").agg(F.count("*").alias("documents"), *[F.expr(f"kll_sketch_agg_double({s}, {SKETCH_K})").alias(s) for s in STATISTICS])
    every = by_lang.agg(F.sum("documents").alias("documents"), *[F.expr(f"kll_merge_agg_double({s})").alias(s) for s in STATISTICS])
    both = by_lang.unionByName(every.where("documents > 0").withColumn("lang", F.lit("*")))
    centre = lambda s: F.array(*[F.expr(f"kll_sketch_get_quantile_double({s}, {q}D)") for q in (0.01, 0.25, 0.5, 0.75, 0.99)])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), centre(s).alias("q")) for s in STATISTICS])).alias("p")
    flat = both.select("lang", "documents", pairs)
    return flat.select("lang", "documents", "p.statistic", *[F.col("p.q")[k].alias(name) for k, name in enumerate(["q01", "q25", "q50", "q75", "q99"])])


def flag_tails(stats: DataFrame, ident: str) -> DataFrame:
    """stats with z_<statistic> and tail_<statistic> ('low', 'high' or null) for each statistic, and `tails`, how many are flagged.

    z is told against the quartiles of the document's language (language_quartiles); a value with |z| > TAIL_Z is in a tail.
    """
    some = stats.where(F.col(STATISTICS[0]).isNotNull())
    joined = _by_language(stats, ident, language_quartiles(some, STATISTICS))
    z = joined.select(ident, "lang", *STATISTICS, *[robust_z(F.col(s), F.col(f"q_{s}")).alias(f"z_{s}") for s in STATISTICS])
    side = lambda s: F.when(F.col(f"z_{s}") > TAIL_Z, "high").when(F.col(f"z_{s}") < -TAIL_Z, "low")
    flagged = z.select("*", *[side(s).alias(f"tail_{s}") for s in STATISTICS])
    return flagged.withColumn("tails", sum((F.col(f"tail_{s}").isNotNull().cast("int") for s in STATISTICS), F.lit(0)))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(cut(p8_stats(spark, sf_dir)))


def p8_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_tails(cut(p8_stats(spark, sf_dir)), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of whose characters less than half stand in segments outside the tail of their language's sentences."""
    return p8_stats(spark, sf_dir).where(F.col("prose_ratio") < PROSE).select("doc_id")
