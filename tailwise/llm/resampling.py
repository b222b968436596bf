"""Importance resampling towards a target distribution of hashed word features, without Python and without a join.

A text's features are its words (or runs of up to NGRAM of them), hashed into BUCKETS; higher-order functions make each
text's array of buckets. A bucket's gain is the log ratio, in thousandths, of the target's share to the corpus's, with
one added to each count; the gains are one literal array of the plan, and a text's weight the sum of its elements. A
Gumbel noise from a hash of the id is added, so that the highest scores are a draw without replacement in proportion to
the importance weights, the same for any partitioning. Only the count totals shuffle, then the ids with their scores,
for the ranking: these are sorted in ranges, numbered within each, and the ranges' sizes (a row each) are added up.

Defined cases: a null or empty text has no features, weight 0 and is never drawn; a null id is hashed as an empty one and
comes last among ties; repeated rows are scored and ranked one by one; an empty corpus gives an empty result, an empty
target gains that favour rare buckets alike for all; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailwise.llm.common import discard, staged

BUCKETS = 10_000
#: Words of a feature at most.
NGRAM = 1
#: Words of a text that can be drawn, and the share of those texts that is, in percent.
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII that is no digit or letter, of texts whose A-Z are in lower case.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bits of monotonically_increasing_id below the partition's number.
ROW_BITS = 33


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def buckets_of(words: Column, ngram: int = NGRAM, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to ngram consecutive words, repeats included."""
    one = lambda feature: (F.crc32(feature) % buckets).cast("int")
    if ngram == 1:
        return F.transform(words, one)

    def sized(own: Column, k: int) -> Column:
        starts = F.slice(own, 1, F.greatest(F.size(own) - k + 1, F.lit(0)))
        return F.transform(starts, lambda _, i: one(F.array_join(F.slice(own, i + 1, k), " ")))

    def runs(own: Column) -> Column:
        return F.flatten(F.array(*[sized(own, k) for k in range(1, ngram + 1)]))

    # A one-element array binds the words to a name, so they are split once a text.
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket: a row a bucket and task is shuffled."""
    found = texts.select(F.explode(buckets_of(words_of(F.col("text")), ngram, buckets)).alias("b")).groupBy("b").count().collect()  # buckets at most
    out = [0] * buckets
    for r in found:
        out[r["b"]] = r["count"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln(target's share / corpus's share)) of each bucket, one added to each count."""
    s, t, n = float(sum(corpus)), float(sum(target)), len(corpus)
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus, target, strict=True)]


def literal(values: list[int]) -> Column:
    """An array of numbers that Catalyst folds into one literal, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def scored(docs: DataFrame, gain: list[int], ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row."""
    table, buckets = literal(gain), len(gain)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("_w"))
    rows = rows.select("doc_id", F.size("_w").cast("long").alias("n_words"), buckets_of(F.col("_w"), ngram, buckets).alias("_b"))
    weight = F.aggregate("_b", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = rows.select("doc_id", "n_words", F.size("_b").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(scores: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank: 1, 2, 3, ... of the percent highest scores among rows with min_words
    words, ties to smaller ids; null beyond. Sorted in ranges: no task sees more than its range."""
    held = staged(scores, "scores")
    able = held.select((F.col("n_words") >= min_words).alias("a")).agg(F.coalesce(F.count_if("a"), F.lit(0))).first()[0]
    drawn = able * percent // 100
    # A row's place in the files splits rows that are equal otherwise.
    keyed = held.select("*", (F.col("n_words") < min_words).alias("_unable"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc("_unable"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = staged(rows.drop("_row", "n_words"), "ranks")
    part = F.shiftright("_at", ROW_BITS)
    sizes = sorted_rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a range
    before, total = {}, 0
    for r in sizes:
        before[r["p"]] = total
        total += r["n"]
    offsets = literal([before.get(p, 0) for p in range(max(before, default=-1) + 1)] or [0])
    place = F.element_at(offsets, (part + 1).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    discard(held)
    return sorted_rows.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document, drawn towards the texts of target."""
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    return ranked(scored(docs, gain, ngram, seed), min_words, percent)
