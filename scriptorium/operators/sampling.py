"""Splits and samples that depend on hashes of ids, not on row order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import hashed, positions

#: Hexadecimal digits of the hash by which rows are counted before they are sorted.
PREFIX_DIGITS = 3


def largest_remainder(strata: DataFrame, budget: int | Column, weight: str, cap: str, name: str) -> DataFrame:
    """Shares a budget among strata (a row each, column ``stratum``) by weight: whole parts, then one more for the largest remainders, later names first among equals; then capped. The strata are few: one task orders them."""
    every = Window.partitionBy()
    budget = F.lit(budget) if isinstance(budget, int) else budget
    s = strata.withColumn("_b", budget.cast("bigint")).withColumn("_raw", F.col("_b") * (F.col(weight) / F.sum(weight).over(every)))
    s = s.withColumn("_floor", F.floor("_raw")).withColumn("_left", F.col("_b") - F.sum("_floor").over(every))
    s = s.withColumn("_place", F.row_number().over(Window.orderBy(F.desc(F.col("_raw") - F.col("_floor")), F.desc("stratum")))).withColumn("_n", F.count("*").over(every))
    extra = F.floor(F.col("_left") / F.col("_n")) + F.when(F.col("_place") <= F.col("_left") % F.col("_n"), 1).otherwise(0)
    return s.withColumn(name, F.least(F.col("_floor") + extra, F.col(cap)).cast("bigint")).drop("_b", "_raw", "_floor", "_left", "_place", "_n")


def stratified_split(df: DataFrame, stratum: str, id_col: str, val_size: int, test_size: int, seed: str) -> DataFrame:
    """``df`` with a fold: test and val of given sizes in proportion to strata, at least one of test in each stratum of two or more (as far as val leaves one)."""
    sizes = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    s = largest_remainder(sizes, val_size, "n", "n", "n_val")
    s = s.withColumn("free", F.col("n") - F.col("n_val")).withColumn("floor", F.least(F.when((F.col("n") >= 2) & (F.lit(test_size) > 0), 1).otherwise(0), F.col("free")))
    rest = F.greatest(F.lit(0), F.lit(test_size) - F.sum("floor").over(Window.partitionBy()))
    s = largest_remainder(s.withColumn("rest_cap", F.col("free") - F.col("floor")), rest, "n", "rest_cap", "more").withColumn("n_test", F.col("floor") + F.col("more"))
    s = s.select("stratum", "n_val", "n_test").withColumn("_take", F.col("n_val") + F.col("n_test"))
    near, far = _by_prefix(df, stratum, id_col, seed, s.select("stratum", "_take"))
    placed = near.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_col)))
    # a row for each stratum
    joined = placed.join(F.broadcast(s.select(F.col("stratum").alias("_stratum"), "n_val", "n_test")), F.col(stratum).eqNullSafe(F.col("_stratum")))
    fold = F.when(F.col("_place") <= F.col("n_val"), "val").when(F.col("_place") <= F.col("n_val") + F.col("n_test"), "test").otherwise("train")
    return joined.select(*df.columns, fold.alias("fold")).unionByName(far.select(*df.columns).withColumn("fold", F.lit("train")))


def _by_prefix(df: DataFrame, stratum: str, id_col: str, seed: str, take: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among the first ``_take`` of their stratum (columns stratum, _take) in hashed order, with the hash ``_h``, and the other rows.

    Rows are counted by stratum and the first digits of the hash; a stratum's first digits up to where the counts reach what is to be taken hold
    its first rows. So only these are sorted, however large the stratum is.
    """
    keyed = df.withColumn("_h", hashed(seed, id_col)).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    counts = keyed.groupBy(F.col(stratum).alias("_s"), "_p").agg(F.count("*").alias("_c"))
    # 16 ** PREFIX_DIGITS rows of a stratum at most
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_before", before).join(F.broadcast(take.select(F.col("stratum").alias("_t"), "_take")), F.col("_s").eqNullSafe(F.col("_t"))).where("_before < _take")
    last = last.groupBy("_s").agg(F.max("_p").alias("_last"))
    marked = keyed.join(F.broadcast(last), F.col(stratum).eqNullSafe(F.col("_s")), "left").withColumn("_near", F.coalesce(F.col("_p") <= F.col("_last"), F.lit(False)))
    return marked.where("_near").select(*df.columns, "_h"), marked.where("not _near").select(*df.columns)


def group_split(groups: DataFrame, key: str, seed: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(key, fold): whole groups in hashed order, cut at n * train and n * (train + val), rounded down. The shares are taken as the decimals that they are written as: 90 * 0.7 is 63, not the 62.99.. of binary fractions."""
    ids = groups.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = positions(ids.withColumn("_hash", hashed(seed, key)), [F.col("_hash"), F.col(key)], "_place")
    n = ids.agg(F.count("*").alias("_n"))
    first, second = Decimal(str(train)), Decimal(str(train)) + Decimal(str(val))
    a, b = F.floor(F.col("_n") * F.lit(first)), F.floor(F.col("_n") * F.lit(second))
    return ranked.crossJoin(n).select(key, F.when(F.col("_place") <= a, "train").when(F.col("_place") <= b, "val").otherwise("test").alias("fold"))


def time_fold(date: Column, train_end: str, val_end: str) -> Column:
    """Folds by comparing dates as texts; what has no date trains."""
    return F.when(date.isNull() | (date < train_end), "train").when(date < val_end, "val").otherwise("test")


def leaks(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that lie in more than one fold."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).where("n_folds > 1")


def stratified_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: str) -> DataFrame:
    """About ``n`` rows, max(1, round(n * share)) of each stratum with halves to even, then cut to n in hashed order."""
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_c"))
    sizes = sizes.crossJoin(df.agg(F.count("*").alias("_n"))).withColumn("_take", F.greatest(F.lit(1), F.bround(n * F.col("_c") / F.col("_n"))))
    near, _ = _by_prefix(df, stratum, id_col, seed, sizes.select(F.col("_s").alias("stratum"), "_take"))
    placed = near.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_col)))
    chosen = placed.join(F.broadcast(sizes.select("_s", "_take")), F.col(stratum).eqNullSafe(F.col("_s"))).where("_place <= _take")
    return chosen.orderBy("_h", id_col).limit(n).select(*df.columns)


def shard_range(n: Column, shard: Column, shards: Column) -> Column:
    """Struct (start, stop) of one of ``shards`` contiguous ranges of n rows; the first n % shards get one more."""
    each, rest = F.floor(n / shards), n % shards
    start = shard * each + F.least(shard, rest)
    return F.struct(start.cast("bigint").alias("start"), (start + each + F.when(shard < rest, 1).otherwise(0)).cast("bigint").alias("stop"))
