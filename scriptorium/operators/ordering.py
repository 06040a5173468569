"""First, last, top-k, bucket and position operators. Spark has no row order, so each takes the order it means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(seed: str, *ids: str) -> Column:
    """Pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ids]))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return top_k(df, keys, order, 1, "_place").drop("_place")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their ranks. Spark cuts each partition to k rows of a key before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def sample_n(df: DataFrame, n: int, seed: str, *ids: str) -> DataFrame:
    """``n`` rows in hashed order, the same ones each time."""
    return df.orderBy(hashed(seed, *ids), *ids).limit(n)


def counted(df: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def frequency_buckets(freq: DataFrame, key: str, count: str, buckets: int = 3) -> DataFrame:
    """Head, torso and tail by position in the order of falling counts, cut at n//3 and 2n//3 (or head and tail at n//2). All counts equal: all head."""
    if buckets not in (2, 3):
        raise ValueError("buckets: 2 or 3")
    ranked = positions(freq, [F.desc(count), F.col(key)], "_place")
    facts = freq.agg(F.count("*").alias("_n"), (F.min(count) == F.max(count)).alias("_flat"))
    place, n = F.col("_place"), F.col("_n")
    bucket = F.when(F.col("_flat") | (place <= F.floor(n / buckets)), "head")
    if buckets == 3:
        bucket = bucket.when(place <= F.floor(2 * n / 3), "torso")
    return ranked.crossJoin(facts).withColumn("bucket", bucket.otherwise("tail")).drop("_place", "_n", "_flat")


def running_sum(df: DataFrame, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to each row in a total order, without gathering all rows in one task: a range sort, the sums of its ranges, and sums within them."""
    from scriptorium.sources.tables import written

    ranged = written(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    # a row for each partition of the sort
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_within", within).join(sums.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_value", "_range", "_within", "_before")


def positions(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Position of each row, from 1, in a total order."""
    return running_sum(df, order, F.lit(1), name)


def _counted_upto(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Distinct non-null values with the number of rows up to each, and of all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    if not by:
        return running_sum(counts, [value], F.col("_c"), "_upto").crossJoin(counts.agg(F.sum("_c").alias("_n")))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))


def at_index(df: DataFrame, value: str, shares: Sequence[tuple[str, int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Values at index n * num // den of the sorted non-null values, not interpolated, with ``shares`` of (name, num, den). Values are counted first, so that what is sorted are distinct values."""
    counts = _counted_upto(df, value, by)
    picked = [F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * a / b), F.col("_n") - 1), F.col(value))).alias(name) for name, a, b in shares]
    return counts.groupBy(*by).agg(*picked)


def nearest_rank(df: DataFrame, value: str, percents: Sequence[tuple[str, int]], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles: the value at position ceil(p * n / 100), 1 at least."""
    counts = _counted_upto(df, value, by)
    picked = [F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_n") * p / 100), F.lit(1)), F.col(value))).alias(name) for name, p in percents]
    return counts.groupBy(*by).agg(*picked)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n) of equal bins between least and greatest value; the last is closed. If all values are equal, one bin holds them."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    edges = known.agg(F.min("v").alias("least"), F.max("v").alias("most")).withColumn("width", (F.col("most") - F.col("least")) / bins)
    at = F.when(F.col("width") == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("least")) / F.col("width")), F.lit(bins - 1)))
    grouped = known.crossJoin(edges).groupBy(at.cast("int").alias("bin"), "least", "width").agg(F.count("*").alias("n"))
    lo = F.col("least") + F.col("bin") * F.col("width")
    return grouped.select("bin", F.round(lo, 6).alias("lo"), F.round(F.col("least") + (F.col("bin") + 1) * F.col("width"), 6).alias("hi"), "n")
