"""Semi-join chains, lookups and bridges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dedupe_first


def filter_chain(first: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Each step (table, foreign key, key of the table before) keeps the rows whose parent was kept; the last table's rows come back."""
    kept = first
    for table, foreign, key in steps:
        kept = table.join(kept.select(F.col(key).alias(foreign)), foreign, "left_semi")
    return kept


def lookup(df: DataFrame, side: DataFrame, on: str, key: str, value: str, name: str, default: str | None = None) -> DataFrame:
    """``df`` with ``value`` of the side row whose ``key`` is ``on``, or the default. The side's keys are unique."""
    found = side.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    out = df.join(found, F.col(on) == F.col("_key"), "left")
    return out.withColumn(name, F.col("_value") if default is None else F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def bridge(rows: DataFrame, index: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Equi-join on a composite key of which the index keeps the first row."""
    return rows.join(dedupe_first(index, key, order), list(key))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row about two id sets of one column each, named id: distinct ids in either, both, only one; share of the left that is in both, in percent; greatest of each; left ids above the right's greatest."""
    both = left.select("id", F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select("id", F.lit(0), F.lit(1))).groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    one = lambda c: F.count_if(c).alias
    sums = both.agg(
        one(F.col("l") == 1)("n_left"), one(F.col("r") == 1)("n_right"), one(F.col("l") + F.col("r") == 2)("n_both"), F.count("*").alias("n_either"),
        F.max(F.when(F.col("l") == 1, F.col("id"))).alias("max_left"), F.max(F.when(F.col("r") == 1, F.col("id"))).alias("max_right"),
    )
    above = both.where("l = 1").crossJoin(sums.select("max_right")).agg(F.count_if(F.col("id") > F.col("max_right")).alias("n_above"))
    return sums.withColumn("pct", F.round(100 * F.col("n_both") / F.col("n_left"), 6)).crossJoin(above)


def pair_overlap(pairs: DataFrame, source: str, dest: str, ids: DataFrame) -> DataFrame:
    """Distinct pairs by which of their ends is among ``ids`` (column id, distinct)."""
    p = pairs.select(F.col(source).alias("s"), F.col(dest).alias("d")).where("s is not null and d is not null").distinct()
    p = p.join(ids.select(F.col("id").alias("s"), F.lit(True).alias("has_s")), "s", "left").join(ids.select(F.col("id").alias("d"), F.lit(True).alias("has_d")), "d", "left")
    kind = F.when(F.col("has_s") & F.col("has_d"), "both").when(F.col("has_s"), "source_only").when(F.col("has_d"), "dest_only").otherwise("neither")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def split_dead(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead ones with why; ``reason`` is null for good rows."""
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done, list(keys), "left_anti")


def enrich(rows: DataFrame, index: DataFrame, on: str, key: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(enriched, unmatched, summary): ``rows`` with ``value`` from the index row whose ``key`` is ``on`` (the greatest, if it has several), an own value going first; rows that end
    without one; and one row (n_total, n_enriched, n_unmatched, unmatched_rate, sample_unmatched) with the first 20 ids of those."""
    found = index.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_value"))
    own = F.col(value) if value in rows.columns else F.lit(None).cast(index.schema[value].dataType)
    out = rows.withColumn("_own", own).join(found, F.col(on) == F.col("_key"), "left").withColumn(value, F.coalesce("_own", "_value")).drop("_own", "_key", "_value")
    missing = F.col(value).isNull()
    sums = out.agg(F.count("*").alias("n_total"), F.count_if(~missing).alias("n_enriched"), F.count_if(missing).alias("n_unmatched"))
    first = out.where(missing).select(on).orderBy(F.asc_nulls_last(on)).limit(20).agg(F.array_sort(F.collect_list(on)).alias("sample_unmatched"))
    summary = sums.withColumn("unmatched_rate", F.round(F.col("n_unmatched") / F.greatest(F.col("n_total"), F.lit(1)), 6)).crossJoin(first)
    return out.where(~missing), out.where(missing).drop(value), summary


def write_enriched(parts: tuple[DataFrame, DataFrame, DataFrame], path: str, max_unmatched_rate: float = 1.0) -> dict:
    """Writes PATH/good and, if there are any, PATH/dead, and returns the summary; then an error if more than a rate is unmatched, when the dead letters are there to look at."""
    from scriptorium.sources.sinks import write_shards

    good, dead, summary = parts
    write_shards(good, f"{path}/good")
    facts = summary.first().asDict()
    if facts["n_unmatched"]:
        write_shards(dead, f"{path}/dead", "json")
    if facts["n_unmatched"] > max_unmatched_rate * max(facts["n_total"], 1):
        raise RuntimeError(f"{facts['n_unmatched']} of {facts['n_total']} rows are unmatched, more than {max_unmatched_rate:.2%}; see {path}/dead")
    return facts


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two runs on their keys; an error, when it is read, if a key is in one only or comes twice."""
    left = a.groupBy(*keys).agg(F.count("*").alias("_na"), F.first(F.struct(*[c for c in a.columns if c not in keys])).alias("_a"))
    right = b.groupBy(*keys).agg(F.count("*").alias("_nb"), F.first(F.struct(*[c for c in b.columns if c not in keys])).alias("_b"))
    both = left.join(right, list(keys), "full")
    ok = (F.coalesce("_na", F.lit(0)) == 1) & (F.coalesce("_nb", F.lit(0)) == 1)
    name = F.concat_ws(",", *(F.col(k).cast("string") for k in keys))
    checked = both.withColumn("_a", F.when(ok, F.col("_a")).otherwise(F.raise_error(F.concat(F.lit("the runs aren't aligned at "), name)).cast(both.schema["_a"].dataType)))
    return checked.select(*keys, "_a.*", "_b.*")


def alignment(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: n_a, n_b, keys in both, only in a, only in b, and that come more than once in either."""
    both = a.groupBy(*keys).agg(F.count("*").alias("na")).join(b.groupBy(*keys).agg(F.count("*").alias("nb")), list(keys), "full").select(F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    n = F.count_if
    return both.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), n((F.col("na") > 0) & (F.col("nb") > 0)).alias("n_both"), n(F.col("nb") == 0).alias("n_only_a"), n(F.col("na") == 0).alias("n_only_b"), n((F.col("na") > 1) | (F.col("nb") > 1)).alias("n_repeated"))


def citation_chain(rows: DataFrame, cite: Column, index: DataFrame, order: Sequence[str], opinions: DataFrame, snippet: str) -> DataFrame:
    """The six stages from a citing row to a checked opinion: its citation is parsed; looked up in an index (volume, reporter, page, cluster_id) that keeps the first row of a key in ``order``;
    the cluster's least opinion (cluster_id, opinion_id, text) is taken; and that one holds the row's ``snippet`` or doesn't.

    ``rows`` with (cluster_id, opinion_id, stage, confirmed); ``stage`` says how far a row came: unparsed, unindexed, no_opinion, unconfirmed or confirmed.
    """
    from scriptorium.functions.text import normalize_reporter, parse_citation

    key = ["volume", "reporter", "page"]
    first = dedupe_first(index.withColumn("reporter", normalize_reporter(F.col("reporter"))), key, order).select(*(F.col(k).alias(f"_{k}") for k in key), "cluster_id")
    least = opinions.groupBy("cluster_id").agg(F.min(F.struct("opinion_id", "text")).alias("_o")).select("cluster_id", "_o.opinion_id", F.col("_o.text").alias("_text"))
    parsed = rows.withColumn("_c", parse_citation(cite)).withColumns({"_volume": F.col("_c.volume"), "_reporter": normalize_reporter(F.col("_c.reporter")), "_page": F.col("_c.page")})
    out = parsed.join(first, [f"_{k}" for k in key], "left").join(least, "cluster_id", "left").withColumn("confirmed", F.coalesce(F.contains("_text", snippet), F.lit(False)))
    stage = F.when(F.col("_volume").isNull(), "unparsed").when(F.col("cluster_id").isNull(), "unindexed").when(F.col("opinion_id").isNull(), "no_opinion").when(~F.col("confirmed"), "unconfirmed").otherwise("confirmed")
    return out.withColumn("stage", stage).select(*rows.columns, "cluster_id", "opinion_id", "stage", "confirmed")
