"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish time is the number of its source's tokens up
to and with it, divided by the source's weight. All documents are sorted by it, and the sorted list is cut
where the total budget of tokens ends. A source with twice the weight thus gives twice the tokens, as long as it has some.

Both running sums are computed in two steps, so that neither a hot source nor the global order needs one
task: sums of small parts first (4,096 hash ranges of a source; the range partitions of the global sort), then sums within
each part, shifted by what the parts before it hold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, fresh, numbered, order_key, repeatable, without_rows, word_count

#: Production weights of the sources; others count as DEFAULT_WEIGHT.
WEIGHTS: dict[str, float] = {"src0": 0.5, "src1": 2.0, "src2": 2.0, "src3": 1.5, "src4": 4.0}
DEFAULT_WEIGHT = 1.0
#: Share of all tokens that the mixture holds.
BUDGET_SHARE = 0.5
SEED = "mix"
#: Hexadecimal digits of the hash that make a part of a source.
PART_DIGITS = 3
NO_SOURCE = "\0"


def _weight(source: Column, weights: Mapping[str, float], default: float) -> Column:
    named = [F.lit(x) for k, w in weights.items() for x in (k, float(w))]
    return F.coalesce(F.try_element_at(F.create_map(*named), source), F.lit(float(default))) if named else F.lit(float(default))


def _mixed(docs: DataFrame, weights: Mapping[str, float], default: float, budget_share: float | None, budget_tokens: int | None, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(source_col), F.lit(NO_SOURCE)).alias("s"), word_count(text_col).alias("n_tokens"), order_key(seed, id_col).alias("k"))
    base = numbered(base, "row").withColumn("weight", _weight(F.col("s"), weights, default)).where("weight > 0").withColumn("part", F.substring("k", 1, PART_DIGITS))
    base = cut(base)

    parts = base.groupBy("s", "part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("s", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = Window.partitionBy("s", "part").orderBy("k", "doc_id", "n_tokens", "row").rowsBetween(Window.unboundedPreceding, 0)
    timed = base.withColumn("within", F.sum("n_tokens").over(within)).join(parts, ["s", "part"])
    timed = timed.select("row", "doc_id", "source", "s", "k", "n_tokens", ((F.col("before") + F.col("within")).cast("double") / F.col("weight")).alias("virtual_finish"))

    order = ["virtual_finish", "s", "k", "doc_id", "n_tokens", "row"]
    ranged = cut(timed.repartitionByRange(*order[:4]).withColumn("range", F.spark_partition_id()))
    sums = cut(ranged.groupBy("range").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    budget = budget_tokens if budget_tokens is not None else int(budget_share * (sums.agg(F.sum("tokens")).first()[0] or 0))
    # as many rows as the sort has partitions
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")).where(F.col("tokens_before") <= budget)
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("tokens_within", F.sum("n_tokens").over(within)).withColumn("rows_within", F.count("*").over(within)).join(sums, "range")
    return placed.select("row", "doc_id", "source", "n_tokens", "virtual_finish", (F.col("rows_before") + F.col("rows_within")).alias("position"), (F.col("tokens_before") + F.col("tokens_within")).alias("cum_tokens")).where(F.col("cum_tokens") <= budget)


def mix_sources(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget_share: float | None = BUDGET_SHARE, budget_tokens: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture in its order: (doc_id, source, n_tokens, virtual_finish, position, cum_tokens).

    Tokens are white-space separated words. Nulls: a null source is a source of its own with the default weight;
    null and empty texts have no tokens, so they cost nothing and come where their hash puts them; a null id
    hashes as an empty string. Long texts count whole. Ties are broken by source, hash, id, tokens and at last by
    row, so that repeated rows each get a place. A source of weight 0 gives nothing. An empty table gives an
    empty result. Other columns are not read.
    """
    return _mixed(docs.select(id_col, text_col, source_col), weights, default_weight, budget_share, budget_tokens, seed, id_col, text_col, source_col).drop("row")


def keep_mixture(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget_share: float | None = BUDGET_SHARE, budget_tokens: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`mix_sources` chooses, with the columns of ``docs``; same edge cases."""
    docs = repeatable(docs)
    row = fresh(docs, "row")
    mixed = _mixed(docs, weights, default_weight, budget_share, budget_tokens, seed, id_col, text_col, source_col).select("row")
    dropped = numbered(docs.select(), "row").join(mixed, "row", "left_anti")
    return without_rows(docs, row, dropped)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def mixing_sql(table: str, columns: str, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, budget_share: float = BUDGET_SHARE, seed: str = SEED) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(w)}" for k, w in weights.items())
    return f"""
WITH t AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS n_tokens,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(CASE source {cases} ELSE {float(default_weight)} END AS DOUBLE) AS weight
  FROM {table}),
v AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS DOUBLE) / weight AS virtual_finish
  FROM t),
g AS (
  SELECT *, row_number() OVER w AS position, CAST(sum(n_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens
  FROM v WINDOW w AS (ORDER BY virtual_finish, coalesce(source, ''), k, doc_id, n_tokens))
SELECT {columns} FROM g WHERE cum_tokens <= (SELECT floor({budget_share} * coalesce(sum(n_tokens), 0)) FROM t)
"""


ORACLE_SQL = mixing_sql("documents", "doc_id, source, n_tokens, virtual_finish, position, cum_tokens")
