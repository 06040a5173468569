"""Retrieval, fusion and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.fuzzy import partial_ratio
from scriptorium.operators import ordering, retrieval as R
from scriptorium.sources.tables import table as t
from scriptorium.sources.tables import written

from .base import query
from .textual import _CHUNKS, chunk_rows

_TERMS = f"unnest(regexp_extract_all(lower(text), '{X.TERM}'))"
_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
BM25_SQL = f"""
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, {_TERMS} AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
z AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY 1),
a AS (SELECT count(*) AS n_docs, (SELECT sum(len) FROM z) / count(*) AS avg_len FROM documents),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN z USING (doc_id), a GROUP BY 1, 2),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)"""
#: Two runs over orders (queries) and parts (documents), and the relevant part of some orders.
RUNS_SQL = """
a AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT l_orderkey AS query_id, l_partkey AS doc_id, round(max(l_extendedprice), 6) AS score FROM lineitem GROUP BY 1, 2) QUALIFY rank <= 3),
b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT l_orderkey AS query_id, l_partkey AS doc_id, round(max(l_quantity), 6) AS score FROM lineitem GROUP BY 1, 2) QUALIFY rank <= 3),
g AS (SELECT l_orderkey AS query_id, min(l_partkey) AS gold FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
ra AS (SELECT g.query_id, gold, coalesce(rank, 0) AS rank FROM g LEFT JOIN a ON g.query_id = a.query_id AND gold = doc_id),
rb AS (SELECT g.query_id, gold, coalesce(rank, 0) AS rank FROM g LEFT JOIN b ON g.query_id = b.query_id AND gold = doc_id)"""
METRICS_SQL = """count(*) AS n_queries, round(avg(CASE WHEN rank BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank BETWEEN 1 AND 2 THEN 1.0 ELSE 0.0 END), 6) AS hit_2, round(avg(CASE WHEN rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3,
round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS mrr, round(avg(CASE WHEN rank BETWEEN 1 AND 3 THEN 1 / log2(1 + rank) ELSE 0.0 END), 6) AS ndcg_3"""
TOP = 3


def _scored(spark, d, value):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col(value).alias("score"))
    return R.max_passage(rows)


def _run(spark, d, value):
    return R.rank(_scored(spark, d, value), TOP)


def _gold(spark, d):
    return t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.min("l_partkey").alias("gold"))


def _ranks(spark, d, value="l_extendedprice"):
    return R.gold_ranks(_gold(spark, d), _run(spark, d, value))


def _both_ranks(spark, d):
    return R.gold_ranks(R.gold_ranks(_gold(spark, d), _run(spark, d, "l_extendedprice"), "ra"), _run(spark, d, "l_quantity"), "rb")


def _bm25(spark, d, k=10):
    return R.bm25(t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


def _hits(spark, d, k):
    """BM25's hits, written: joins with the documents know that they are few, and shuffle no texts."""
    return written(_bm25(spark, d, k))


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_topk(spark, d):
    return _bm25(spark, d)


def _dense(spark, d, k=10):
    e = t(spark, d, "embeddings")
    return R.dense(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), k)


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 10 = 0)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def dense_topk(spark, d):
    return _dense(spark, d)


@query("SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2")
def maxp(spark, d):
    return _scored(spark, d, "l_extendedprice")


@query(f"WITH {RUNS_SQL} SELECT query_id, doc_id, score, rank FROM a")
def shard_merge(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"), (F.col("l_partkey") % 4).alias("shard"))
    return R.merge_shards(rows, "shard", TOP)


@query(f"""WITH {RUNS_SQL}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 100""")
def rrf(spark, d):
    return R.reciprocal_rank_fusion([_run(spark, d, "l_extendedprice"), _run(spark, d, "l_quantity")])


@query(f"WITH {RUNS_SQL} SELECT query_id, gold, rank FROM ra")
def find_rank(spark, d):
    lists = R.as_lists(_run(spark, d, "l_extendedprice"))
    return _gold(spark, d).join(lists, "query_id", "left").select("query_id", "gold", R.find_rank(F.col("retrieved"), F.col("gold")).alias("rank"))


@query(f"WITH {RUNS_SQL} SELECT {METRICS_SQL} FROM ra")
def retrieval_metrics(spark, d):
    return _ranks(spark, d).agg(*R.metrics((1, 2, 3), (3,)))


_BUCKETS = """f AS (SELECT gold, count(*) AS freq FROM g GROUP BY 1), k AS (SELECT gold, freq, row_number() OVER (ORDER BY freq DESC, gold) AS i, count(*) OVER () AS n, min(freq) OVER () = max(freq) OVER () AS flat FROM f),
u AS (SELECT gold, freq, CASE WHEN flat OR i <= n // 3 THEN 'head' WHEN i <= 2 * n // 3 THEN 'torso' ELSE 'tail' END AS bucket FROM k)"""


def _buckets(spark, d):
    return ordering.frequency_buckets(ordering.counted(_gold(spark, d), "gold", name="freq"), "gold", "freq")


@query(f"WITH {RUNS_SQL}, {_BUCKETS} SELECT gold, freq, bucket FROM u")
def freq_buckets(spark, d):
    return _buckets(spark, d).select("gold", "freq", "bucket")


@query(f"""WITH {RUNS_SQL}, {_BUCKETS} SELECT coalesce(bucket, 'overall') AS bucket, {METRICS_SQL}, min(freq) AS min_freq, max(freq) AS max_freq, count(DISTINCT gold) AS n_gold FROM ra JOIN u USING (gold) GROUP BY ROLLUP (bucket)""")
def stratified_metrics(spark, d):
    out = _ranks(spark, d).join(_buckets(spark, d), "gold").rollup("bucket").agg(*R.metrics((1, 2, 3), (3,)), F.min("freq").alias("min_freq"), F.max("freq").alias("max_freq"), F.countDistinct("gold").alias("n_gold"))
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("overall")))


_PAIRED = "SELECT query_id, ra.rank AS ra, rb.rank AS rb FROM ra JOIN rb USING (query_id)"


@query(f"""WITH {RUNS_SQL}, p AS (SELECT CASE WHEN ra = 0 OR ra > 2 THEN 3 ELSE ra END AS x, CASE WHEN rb = 0 OR rb > 2 THEN 3 ELSE rb END AS y FROM ({_PAIRED}))
SELECT count(*) AS n_queries, count(*) FILTER (x < y) AS a_wins, count(*) FILTER (x > y) AS b_wins, count(*) FILTER (x = y) AS ties FROM p""")
def paired_comparison(spark, d):
    return R.paired(_both_ranks(spark, d), "ra", "rb", 2)


@query(f"""WITH {RUNS_SQL} SELECT count(*) FILTER (ra > 0 AND rb > 0) AS both, count(*) FILTER (ra > 0 AND rb = 0) AS a_only, count(*) FILTER (ra = 0 AND rb > 0) AS b_only, count(*) FILTER (ra = 0 AND rb = 0) AS neither,
round(avg(CASE WHEN ra > 0 OR rb > 0 THEN 1.0 ELSE 0.0 END), 6) AS union_recall FROM ({_PAIRED})""")
def joint_recall(spark, d):
    a, b = F.col("ra") > 0, F.col("rb") > 0
    return _both_ranks(spark, d).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"), F.round(F.avg(F.when(a | b, 1.0).otherwise(0.0)), 6).alias("union_recall"))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT query_id, list(doc_id ORDER BY rank) AS da FROM a GROUP BY 1), m AS (SELECT query_id, list(doc_id ORDER BY rank) AS db FROM b GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (list_sort(da) = list_sort(db)) AS same_set, count(*) FILTER (da = db) AS same_order, count(*) FILTER (ra > 0 AND rb > 0 AND rb < ra) AS up, count(*) FILTER (ra > 0 AND rb > ra) AS down,
count(*) FILTER (ra > 0 AND rb = ra) AS unchanged, count(*) FILTER (ra = 0 AND rb > 0) AS appeared, count(*) FILTER (ra > 0 AND rb = 0) AS disappeared FROM ({_PAIRED}) JOIN l USING (query_id) JOIN m USING (query_id)""")
def rank_movement(spark, d):
    def ids(value, name):
        return R.as_lists(_run(spark, d, value)).select("query_id", F.transform("retrieved", lambda h: h["doc_id"]).alias(name))

    both = _both_ranks(spark, d).join(ids("l_extendedprice", "da"), "query_id").join(ids("l_quantity", "db"), "query_id")
    a, b, n = F.col("ra"), F.col("rb"), F.count_if
    return both.agg(F.count("*").alias("n"), n(F.array_sort("da") == F.array_sort("db")).alias("same_set"), n(F.col("da") == F.col("db")).alias("same_order"), n((a > 0) & (b > 0) & (b < a)).alias("up"), n((a > 0) & (b > a)).alias("down"), n((a > 0) & (a == b)).alias("unchanged"), n((a == 0) & (b > 0)).alias("appeared"), n((a > 0) & (b == 0)).alias("disappeared"))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT rank AS v, row_number() OVER (ORDER BY rank) - 1 AS i, count(*) OVER () AS n FROM ra WHERE rank > 0)
SELECT max(v) FILTER (i = n // 10) AS p10, max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = n * 9 // 10) AS p90, (SELECT round(avg(CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END), 6) FROM ra) AS recall FROM s""")
def rank_percentiles(spark, d):
    ranks = _ranks(spark, d)
    return ordering.at_index(ranks.where("rank > 0"), "rank", [("p10", 1, 10), ("p50", 1, 2), ("p90", 9, 10)]).crossJoin(ranks.agg(F.round(F.avg(F.when(F.col("rank") > 0, 1.0).otherwise(0.0)), 6).alias("recall")))


@query(f"""WITH {RUNS_SQL} SELECT g.query_id, gold, array_to_string(list(doc_id ORDER BY rank) FILTER (rank <= 2), ',') AS best FROM ra g JOIN (SELECT query_id, doc_id, rank AS r2 FROM a) x USING (query_id) WHERE g.rank = 0 GROUP BY 1, 2""".replace("ORDER BY rank) FILTER (rank <= 2)", "ORDER BY r2) FILTER (r2 <= 2)"))
def failure_report(spark, d):
    lists = R.as_lists(_run(spark, d, "l_extendedprice"))
    return _ranks(spark, d).where("rank = 0").join(lists, "query_id").select("query_id", "gold", F.array_join(F.slice(F.transform("retrieved", lambda h: h["doc_id"].cast("string")), 1, 2), ",").alias("best"))


@query(f"""WITH {RUNS_SQL}, p AS (SELECT a.query_id, gold, doc_id FROM a JOIN ra ON a.query_id = ra.query_id WHERE ra.rank > 0 AND a.rank BETWEEN 2 AND 100 AND doc_id <> gold)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('neg:' || query_id || ':' || doc_id), doc_id) AS place FROM p QUALIFY place <= 1""")
def hard_negatives(spark, d):
    return R.hard_negatives(_gold(spark, d), _run(spark, d, "l_extendedprice"), 1, "neg")


@query(f"""WITH {RUNS_SQL}, n AS (SELECT a.query_id, gold, doc_id FROM a JOIN ra ON a.query_id = ra.query_id WHERE ra.rank > 0 AND doc_id <> gold)
SELECT query_id, doc_id, 0 AS label FROM n UNION ALL SELECT DISTINCT query_id, gold, 1 FROM n""")
def training_pairs(spark, d):
    n = R.hard_negatives(_gold(spark, d), _run(spark, d, "l_extendedprice"), 100, "neg", first=1)
    rows = n.groupBy("query_id", "gold").agg(F.collect_list("doc_id").alias("neg"))
    pairs = F.concat(F.array(F.struct(F.col("gold").alias("doc_id"), F.lit(1).alias("label"))), F.transform("neg", lambda x: F.struct(x.alias("doc_id"), F.lit(0).alias("label"))))
    return rows.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.doc_id", "p.label")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, doc_id) AS rank, len::DOUBLE AS score FROM (SELECT b.query_id, b.doc_id, length(d.text) AS len FROM bm25 b JOIN documents d USING (doc_id)) QUALIFY rank <= 5")
def rerank(spark, d):
    candidates = _hits(spark, d, 10).select("query_id", "doc_id").join(t(spark, d, "documents").select("doc_id", F.col("text").alias("pair_text")), "doc_id")
    return R.rerank(candidates, _length_score, 5)


def _length_score(texts: pd.Series) -> pd.Series:
    return texts.str.len().astype("float64")


#: A hit's context: its document's first chunks, whole.
CONTEXT_CHUNKS = 2
_CTX = f"{_CHUNKS}, x AS (SELECT doc_id, string_agg(text, ' ' ORDER BY chunk_index) AS context FROM chunks WHERE chunk_index < {CONTEXT_CHUNKS} GROUP BY 1)"


@query(f"""WITH {BM25_SQL}, {_CTX}, ctx AS (SELECT query_id, list(context ORDER BY rank) AS ctx FROM bm25 JOIN x USING (doc_id) WHERE rank <= 3 GROUP BY 1)
SELECT query_id, 'Sources:' || chr(10) || array_to_string(list_transform(ctx, lambda x, i: '[' || i || '] ' || x), chr(10)) || chr(10) || chr(10) || 'Text: ' || text || chr(10) || 'Answer from the sources alone:' AS prompt FROM ctx JOIN benchmark ON item_id = query_id""")
def build_prompt(spark, d):
    return _contexts(spark, d).join(t(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id").select("query_id", X.build_prompt(F.col("text"), F.col("contexts")).alias("prompt"))


def _contexts(spark, d):
    hits = _hits(spark, d, 3)
    # only documents that are hit are cut into chunks
    docs = t(spark, d, "documents").select("doc_id", "text").join(hits.select("doc_id"), "doc_id", "left_semi")
    parts = chunk_rows(docs).where(F.col("chunk_index") < CONTEXT_CHUNKS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    texts = parts.select("doc_id", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("context"))
    return hits.join(texts, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda x: x["context"]).alias("contexts"))


@query(f"WITH {BM25_SQL}, {_CTX} SELECT query_id, array_to_string(list(context ORDER BY rank), ' ') AS context FROM bm25 JOIN x USING (doc_id) WHERE rank <= 3 GROUP BY 1")
def context_assembly(spark, d):
    return _contexts(spark, d).select("query_id", F.array_join("contexts", " ").alias("context"))


@query()
def fuzzy_verify(spark, d):
    """Passages in the documents that BM25 finds for them: partial ratio of 80 or more."""
    hits = _hits(spark, d, 3).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id").join(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote")), "query_id")
    return hits.select("query_id", "doc_id", partial_ratio("quote", "text").alias("score")).where("score >= 80")


_JUDGED = """j AS (SELECT turn % 4 AS ablation, CASE WHEN conv_id % 7 = 0 THEN 'UNKNOWN' WHEN conv_id % 3 = 0 THEN 'FAITHFUL' WHEN conv_id % 3 = 1 THEN 'PARTIAL' ELSE 'HALLUCINATED' END AS label FROM conversations)"""


def _judged(spark, d):
    c = F.col("conv_id")
    label = F.when(c % 7 == 0, "UNKNOWN").when(c % 3 == 0, "FAITHFUL").when(c % 3 == 1, "PARTIAL").otherwise("HALLUCINATED")
    return t(spark, d, "conversations").select((F.col("turn") % 4).alias("ablation"), label.alias("label"))


def _rates(judged, denominator):
    return judged.groupBy("ablation").agg(F.count("*").alias("n"), *(F.round(F.count_if(F.col("label") == x) / denominator, 6).alias(x.lower()) for x in X.LABELS))


@query(f"WITH {_JUDGED} SELECT ablation, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (label = '{x}') / nullif(count(*) FILTER (label <> 'UNKNOWN'), 0), 6) AS {x.lower()}" for x in X.LABELS) + " FROM j GROUP BY 1")
def label_rates(spark, d):
    return _rates(_judged(spark, d), F.nullif(F.count_if(F.col("label") != "UNKNOWN"), F.lit(0)))


@query(f"WITH {_JUDGED} SELECT ablation, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (label = '{x}') / count(*), 6) AS {x.lower()}" for x in X.LABELS) + " FROM j GROUP BY 1")
def label_rates_all(spark, d):
    return _rates(_judged(spark, d), F.count("*"))


@query(f"WITH {_JUDGED} SELECT ablation, round(1.96 * sqrt(0.25 / count(*)), 6) AS half_width FROM j GROUP BY 1")
def ci_halfwidth(spark, d):
    return _judged(spark, d).groupBy("ablation").agg(F.round(1.96 * F.sqrt(0.25 / F.count("*")), 6).alias("half_width"))


_ABLATION = f"""WITH {RUNS_SQL}, {_JUDGED}, r AS (SELECT query_id % 4 AS ablation, round(avg(CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit FROM ra WHERE query_id % 4 > 0 GROUP BY 1),
m AS (SELECT ablation, n, hallucinated, hit FROM (SELECT ablation, count(*) AS n, round(count(*) FILTER (label = 'HALLUCINATED') / count(*), 6) AS hallucinated FROM j GROUP BY 1) LEFT JOIN r USING (ablation))"""


def _ablations(spark, d):
    hit = _ranks(spark, d).where("query_id % 4 > 0").groupBy((F.col("query_id") % 4).alias("ablation")).agg(F.round(F.avg(F.when(F.col("rank") > 0, 1.0).otherwise(0.0)), 6).alias("hit"))
    return _rates(_judged(spark, d), F.count("*")).join(hit, "ablation", "left").select("ablation", "n", "hallucinated", "hit")


@query(f"{_ABLATION} SELECT * FROM m")
def ablation_matrix(spark, d):
    return _ablations(spark, d)


@query(f"{_ABLATION} SELECT CASE WHEN count(hit) >= 3 THEN round(corr(hit, hallucinated), 6) END AS r, count(hit) AS n FROM m")
def pearson(spark, d):
    return _ablations(spark, d).agg(F.when(F.count("hit") >= 3, F.round(F.corr("hit", "hallucinated"), 6)).alias("r"), F.count("hit").alias("n"))
