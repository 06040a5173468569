"""Samples, splits and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import ordering, sampling
from scriptorium.sources.tables import table as t

from .base import query

VAL, TEST, SEED = 60, 100, "split"


@query("SELECT doc_id FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 100")
def sample_n(spark, d):
    return ordering.sample_n(t(spark, d, "documents").select("doc_id"), 100, "sample", "doc_id")


def _take(x):
    # halves to even
    return f"CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round({x} / 2) ELSE round({x}) END"


@query(f"""WITH c AS (SELECT source, count(*) AS c, (SELECT count(*) FROM documents) AS n FROM documents GROUP BY 1), k AS (SELECT source, greatest(1, {_take('(100 * c / n)')}) AS take FROM c),
p AS (SELECT doc_id, source, md5('strat:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY md5('strat:' || doc_id), doc_id) AS i FROM documents)
SELECT doc_id, source FROM p JOIN k USING (source) WHERE i <= take ORDER BY h, doc_id LIMIT 100""")
def stratified_sample(spark, d):
    return sampling.stratified_sample(t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100, "strat")


def _lrm(src: str, budget: str, weight: str, cap: str, name: str) -> str:
    """CTE body: ``src`` with column ``name``."""
    return f"""SELECT * EXCLUDE (_raw, _floor, _left, _place, _n), least(_floor + _left // _n + CASE WHEN _place <= _left % _n THEN 1 ELSE 0 END, {cap})::BIGINT AS {name} FROM (
SELECT *, {budget} - sum(_floor) OVER () AS _left, row_number() OVER (ORDER BY _raw - _floor DESC, stratum DESC) AS _place, count(*) OVER () AS _n FROM (
SELECT *, floor(_raw)::BIGINT AS _floor FROM (SELECT *, {budget} * ({weight}::DOUBLE / sum({weight}) OVER ()) AS _raw FROM {src})))"""


def _strat(src: str) -> str:
    return f"""s0 AS (SELECT stratum, count(*) AS n FROM {src} GROUP BY 1), s1 AS ({_lrm('s0', str(VAL), 'n', 'n', 'n_val')}),
s2 AS (SELECT *, n - n_val AS free, least(CASE WHEN n >= 2 THEN 1 ELSE 0 END, n - n_val) AS floor FROM s1), s3 AS (SELECT *, free - floor AS rest_cap, greatest(0, {TEST} - sum(floor) OVER ())::BIGINT AS rest FROM s2),
s4 AS ({_lrm('s3', 'rest', 'n', 'rest_cap', 'more')}), s5 AS (SELECT stratum, n_val, floor + more AS n_test FROM s4)"""


def _fold(src: str, key: str) -> str:
    return f"""SELECT {key}, stratum, CASE WHEN i <= n_val THEN 'val' WHEN i <= n_val + n_test THEN 'test' ELSE 'train' END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{SEED}:' || {key}), {key}) AS i FROM {src}) JOIN s5 USING (stratum)"""


@query(f"WITH s0 AS (SELECT source AS stratum, sum(n_chars)::BIGINT AS w, 2 AS cap FROM documents GROUP BY 1) {_lrm('s0', '33', 'w', 'cap', 'share')}")
def largest_remainder(spark, d):
    s = t(spark, d, "documents").groupBy(F.col("source").alias("stratum")).agg(F.sum("n_chars").alias("w"), F.lit(2).alias("cap"))
    return sampling.largest_remainder(s, 33, "w", "cap", "share")


@query(f"WITH d AS (SELECT doc_id, source AS stratum FROM documents), {_strat('d')} {_fold('d', 'doc_id')}")
def stratified_split(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("part"))
    return sampling.stratified_split(docs, "part", "doc_id", VAL, TEST, SEED).select("doc_id", F.col("part").alias("stratum"), "fold")


@query(f"""WITH m AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2), d AS (SELECT conv_id, role AS stratum FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f, role) = 1), {_strat('d')},
x AS ({_fold('d', 'conv_id')}) SELECT conv_id, turn, fold FROM conversations JOIN x USING (conv_id)""")
def group_stratified_split(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", "role")
    counts = rows.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("f"))
    groups = ordering.dedupe_first(counts, ["conv_id"], [F.desc("n"), "f", "role"]).select("conv_id", F.col("role").alias("part"))
    return rows.join(sampling.stratified_split(groups, "part", "conv_id", VAL, TEST, SEED).select("conv_id", "fold"), "conv_id").select("conv_id", "turn", "fold")


_GROUPS = """k AS (SELECT user_id, row_number() OVER (ORDER BY md5('group:' || user_id), user_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
f AS (SELECT user_id, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * (0.7 + 0.15)) THEN 'val' ELSE 'test' END AS fold FROM k)"""


@query(f"WITH {_GROUPS} SELECT event_id, fold FROM events JOIN f USING (user_id)")
def split_by_group(spark, d):
    events = t(spark, d, "events").select("event_id", "user_id")
    return events.join(sampling.group_split(events, "user_id", "group"), "user_id").select("event_id", "fold")


_DAY = "strftime(ts, '%Y-%m-%d')"


@query(f"SELECT event_id, CASE WHEN ts IS NULL OR {_DAY} < '2024-01-20' THEN 'train' WHEN {_DAY} < '2024-01-25' THEN 'val' ELSE 'test' END AS fold FROM events")
def split_by_time(spark, d):
    return t(spark, d, "events").select("event_id", sampling.time_fold(F.date_format("ts", "yyyy-MM-dd"), "2024-01-20", "2024-01-25").alias("fold"))


@query(f"SELECT user_id, count(DISTINCT fold) AS n_folds FROM (SELECT user_id, CASE WHEN {_DAY} < '2024-01-20' THEN 'train' ELSE 'test' END AS fold FROM events) GROUP BY 1 HAVING count(DISTINCT fold) > 1")
def leakage_audit(spark, d):
    events = t(spark, d, "events").select("user_id", F.when(F.date_format("ts", "yyyy-MM-dd") < "2024-01-20", "train").otherwise("test").alias("fold"))
    return sampling.leaks(events, "user_id")


@query(f"SELECT event_id FROM events WHERE {_DAY} BETWEEN '2024-01-05' AND '2024-01-09'")
def date_range_filter(spark, d):
    # a range of the time itself, which reaches the scan
    return t(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp"))).select("event_id")


@query("SELECT n_nationkey AS shard, n_nationkey * (1003 // 25) + least(n_nationkey, 1003 % 25) AS start, n_nationkey * (1003 // 25) + least(n_nationkey, 1003 % 25) + 1003 // 25 + CASE WHEN n_nationkey < 1003 % 25 THEN 1 ELSE 0 END AS stop FROM nation")
def shard_range(spark, d):
    r = sampling.shard_range(F.lit(1003), F.col("n_nationkey"), F.lit(25))
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("shard"), r["start"].alias("start"), r["stop"].alias("stop"))
