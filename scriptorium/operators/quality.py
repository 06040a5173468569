"""Audits, repairs, gates and contracts. Each gate is one row: gate, severity, measured value, whether it passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.functions.jsonlines import findings
from scriptorium.functions.text import nonfinite

SENTINELS = ("nan", "NaN", "inf", "-inf", "Infinity", "-Infinity")


def size_bucket(n: Column) -> Column:
    return F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").when(n < 1_000_000, "100K<n<1M").otherwise("n>1M")


def shard_audit(lines: DataFrame, shard: str, line: str) -> DataFrame:
    """Lines of each shard that aren't blank, and how many of them are JSON, bare NaN and Infinity included and nothing behind it."""
    real = lines.where(F.length(F.trim(F.col(line))) > 0)
    real = real.withColumn("_ok", findings(F.col(line))["decoded"])
    decoded = F.col("_ok")
    return real.groupBy(shard).agg(F.count("*").alias("n_lines"), F.count_if(~decoded).alias("n_errors"), F.count_if(decoded).alias("n_decoded"))


def nan_audit(df: DataFrame, shard: str, numbers: Sequence[str], texts: Sequence[str] = (), advisory: Sequence[str] = ()) -> DataFrame:
    """Non-finite numbers and texts that spell one, by shard and field, with a verdict: bad only in advisory fields can be repaired, in others it blocks."""
    bad = {c: nonfinite(F.col(c)) for c in numbers} | {c: F.col(c).isin(*SENTINELS) for c in texts}
    counts = df.groupBy(shard).agg(F.count("*").alias("n_rows"), *(F.count_if(b).alias(f"bad_{c}") for c, b in bad.items()))
    total = reduce(lambda a, b: a + b, [F.col(f"bad_{c}") for c in bad])
    hard = reduce(lambda a, b: a + b, [F.col(f"bad_{c}") for c in bad if c not in advisory], F.lit(0))
    return counts.withColumn("verdict", F.when(total == 0, "CLEAN").when(hard > 0, "HARD_FAILURE").otherwise("REPAIRABLE"))


def nan_repair(df: DataFrame, numbers: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({c: F.when(~nonfinite(F.col(c)), F.col(c)) for c in numbers} | {c: F.when(~F.col(c).isin(*SENTINELS), F.col(c)) for c in texts})


def advisory_fields(schema: StructType) -> list[str]:
    """Fields that may be null, in which a bad value doesn't block."""
    return [f.name for f in schema if f.nullable]


def errors(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that fail; a check that can't be told fails too."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in checks)))


def length_off(stored: Column, actual: Column) -> Column:
    """Off by more than 200, or by more than a twentieth."""
    gap = F.abs(stored - actual)
    return stored.isNull() | (gap > 200) | (gap > 0.05 * actual)


def gate(df: DataFrame, name: str, severity: str, value: Column, passes) -> DataFrame:
    """One row; ``passes`` maps the value's column to a boolean one."""
    return df.agg(F.round(value.cast("double"), 6).alias("value")).select(F.lit(name).alias("gate"), F.lit(severity).alias("severity"), "value", F.coalesce(passes(F.col("value")), F.lit(False)).alias("passed"))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def summary(gates: DataFrame) -> DataFrame:
    kind = F.when(F.col("passed"), "passed").when(F.col("severity") == "blocking", "failed_blocking").otherwise("failed_advisory")
    return gates.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def rollup(gates: DataFrame) -> DataFrame:
    """(outcome, n, gates, all_passed) for each outcome of gates (gate, severity, passed): a gate that says neither was skipped; all have passed if no blocking one failed."""
    kind = F.when(F.col("passed"), "passed").when(F.col("passed").isNull(), "skipped").when(F.col("severity") == "advisory", "failed_advisory").otherwise("failed_blocking")
    by = gates.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("gate")), ",").alias("gates"))
    return by.crossJoin(gates.agg((F.count_if(kind == "failed_blocking") == 0).alias("all_passed")))


def check_rows(df: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(check_name, kind, n_bad, passed) for each named condition that a row should not meet; one scan."""
    one = df.agg(*(F.count_if(c).alias(k) for k, (c, _) in checks.items()))
    rows = [F.struct(F.lit(k).alias("check_name"), F.lit(kind).alias("kind"), F.col(k).alias("n_bad"), (F.col(k) == 0).alias("passed")) for k, (_, kind) in checks.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def breakdown(df: DataFrame, by: str, known: Column, least_pct: float) -> DataFrame:
    """Count and rounded share in percent of each value, and, as the gate has it, the sum of the rounded shares of known ones against ``least_pct``."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    shares = counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).withColumn("pct", F.round(100 * F.col("n") / F.col("_all"), 2)).drop("_all")
    total = shares.agg(F.round(F.coalesce(F.sum(F.when(known, F.col("pct"))), F.lit(0.0)), 2).alias("known_pct"))
    return shares.crossJoin(total).withColumn("unknown_pct", F.round(100 - F.col("known_pct"), 2)).withColumn("passed", F.col("known_pct") >= least_pct)


def long_prompts(df: DataFrame, tokens: Column, limit: int = 32_768) -> DataFrame:
    """Advisory: mean, median and greatest number of tokens, and how many rows are over a model's limit."""
    over = F.count_if(tokens > limit)
    return df.agg(F.round(F.avg(tokens), 1).alias("mean_tokens"), F.percentile(tokens, 0.5).alias("median_tokens"), F.max(tokens).alias("max_tokens"), over.alias("over_limit"), F.round(100 * over / F.count("*"), 2).alias("over_pct"), F.lit("advisory").alias("severity"))


def anchors(df: DataFrame, text: Column, field: Column, window: int = 50_000, least_pct: float = 60) -> DataFrame:
    """Citations in the first ``window`` characters, as this gate is defined: how many texts have one, how many are longer than the window, and where a stored count of citations disagrees with what is found."""
    from scriptorium.functions.text import citation_count

    rows = df.select((F.length(text) > window).alias("capped"), citation_count(F.substring(text, 1, window)).alias("k"), (F.coalesce(field, F.lit(0)) > 0).alias("stored"))
    n, hit, off = F.count("*"), F.count_if(F.col("k") > 0), F.count_if(F.col("stored") & (F.col("k") == 0))
    return rows.agg(
        n.alias("n"), F.count_if("capped").alias("n_capped"), hit.alias("n_anchored"), F.round(100 * hit / n, 2).alias("pct_anchored"), F.round(F.avg("k"), 2).alias("mean_anchors"), F.count_if("stored").alias("field_nonzero"), off.alias("field_nonzero_regex_zero"),
        F.coalesce(F.round(100 * off / F.nullif(F.count_if("stored"), F.lit(0)), 2), F.lit(0.0)).alias("disagree_pct"), F.coalesce(100 * hit / n >= least_pct, F.lit(False)).alias("passed"),
    )


def stored_against(df: DataFrame, stored: Column, computed: Column, tolerance: float = 0.01) -> DataFrame:
    """Advisory, always passes: the greatest deviation of a stored value from the computed one."""
    gap = F.max(F.abs(stored - computed))
    return df.agg(F.count("*").alias("sample_n"), F.round(gap, 4).alias("max_deviation"), F.coalesce(gap <= tolerance, F.lit(True)).alias("consistent"), F.count_if(stored == 0).alias("zero_entropy"), F.lit(True).alias("passed"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, stage, n): rows that meet a stage's condition and those of all stages before; one scan."""
    conditions, so_far = [], F.lit(True)
    for _, c in stages:
        so_far = so_far & F.coalesce(c, F.lit(False))
        conditions.append(so_far)
    one = df.agg(*(F.count_if(c).alias(f"_{i}") for i, c in enumerate(conditions)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), F.col(f"_{i}").alias("n")) for i, (name, _) in enumerate(stages)))).alias("r")).select("r.*")


def heatmap(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """(rows, columns, n, share): counts of each pair and their share of the row's."""
    pairs = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    totals = pairs.groupBy(rows).agg(F.sum("n").alias("_all")).withColumnRenamed(rows, "_row")
    return pairs.join(totals, F.col(rows).eqNullSafe(F.col("_row"))).select(rows, columns, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))
