"""Likely duplicates of short texts by MinHash bands, verified by exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# Permutations, rows in a band, words in a shingle, similarity.
PERMUTATIONS, ROWS, SHINGLE, SIMILAR = 128, 4, 4, 0.65


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of runs of so many words, with numbers as one word."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[^a-z0-9]+"), lambda w: w != "")
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " "))))).otherwise(F.array().cast("array<bigint>"))


def minhash_pairs(df: DataFrame, text: str, least_chars: int = 40) -> DataFrame:
    """a, b, similarity: pairs of classes of equal texts (by their least id, a < b) that share a band and are similar enough.

    df: id and the text. Equal shingle sets are one class from the start, so copies make no pairs. A pair at the
    threshold shares a band with probability over 0.99.
    """
    x = df.filter(F.length(text) >= least_chars).select("id", shingles(F.col(text)).alias("s")).filter(F.size("s") > 0)
    x = written(x.groupBy(F.array_sort("s").alias("s")).agg(F.min("id").alias("id")), "sets")
    band = lambda b: F.xxhash64(*(F.array_min(_hashed(b * ROWS + j)) for j in range(ROWS)))
    keys = x.select("id", F.size("s").alias("n"), F.posexplode(F.array(*(band(b) for b in range(PERMUTATIONS // ROWS)))).alias("band", "key"))
    one, two = keys.alias("x"), keys.alias("y")
    near = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= SIMILAR * F.greatest("x.n", "y.n"))
    pairs = one.join(two, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    full = pairs.join(x.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(x.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity")).filter(F.col("similarity") >= SIMILAR)


def _hashed(seed: int) -> Column:
    return F.transform("s", lambda h: F.xxhash64(h, F.lit(seed)))
