"""Semi-join chains, lookups, bridges, overlaps, counts and audits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import joins, ordering, quality
from scriptorium.sources.tables import table as t

from .base import n_words, query

REGIONS = ("EUROPE", "ASIA", "AMERICA")


@query("""SELECT o.o_orderstatus, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name IN ('EUROPE', 'ASIA', 'AMERICA') GROUP BY 1""")
def filter_chain(spark, d):
    regions = t(spark, d, "region").where(F.col("r_name").isin(*REGIONS))
    orders = joins.filter_chain(regions, (t(spark, d, "nation"), "n_regionkey", "r_regionkey"), (t(spark, d, "customer"), "c_nationkey", "n_nationkey"), (t(spark, d, "orders"), "o_custkey", "c_custkey"))
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'JAPAN') OR n_regionkey IN (1, 3)")
def membership_filter(spark, d):
    return t(spark, d, "nation").where(F.col("n_name").isin("FRANCE", "GERMANY", "JAPAN") | F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")


@query("""SELECT o_orderkey, coalesce(nullif(c_name, ''), nullif(n_name, ''), '') AS name, coalesce(n_name, '') AS court, coalesce(r_name, '') AS region, o_orderstatus = 'F' AS is_final
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def denormalize(spark, d):
    out = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", joins.first_filled(F.col("c_name"), F.col("n_name")).alias("name"), joins.first_filled(F.col("n_name")).alias("court"), joins.first_filled(F.col("r_name")).alias("region"), F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)).alias("is_final"))


@query("SELECT s_suppkey, coalesce(n_name, 'unknown') AS court FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def annotate_court(spark, d):
    return joins.lookup(t(spark, d, "supplier"), t(spark, d, "nation").where("n_regionkey <> 2"), "s_nationkey", "n_nationkey", "n_name", "court", "unknown").select("s_suppkey", "court")


@query("""WITH i AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) = 1)
SELECT p.p_partkey, i.p_partkey AS first_partkey FROM part p JOIN i USING (p_brand, p_type, p_size)""")
def citation_bridge(spark, d):
    part = t(spark, d, "part")
    index = part.select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("first_partkey"))
    return joins.bridge(part.select("p_partkey", "p_brand", "p_type", "p_size"), index, ["p_brand", "p_type", "p_size"], ["first_partkey"]).select("p_partkey", "first_partkey")


@query("""WITH m AS (SELECT p_brand, p_type, min(p_partkey) AS first_partkey FROM part GROUP BY 1, 2)
SELECT p.p_partkey, m.first_partkey, contains(f.p_name, split_part(p.p_name, ' ', 1)) AS confirmed FROM part p JOIN m USING (p_brand, p_type) JOIN part f ON f.p_partkey = m.first_partkey""")
def bridge_min_opinion(spark, d):
    part = t(spark, d, "part")
    least = part.groupBy("p_brand", "p_type").agg(F.min_by("p_name", "p_partkey").alias("name"), F.min("p_partkey").alias("first_partkey"))
    return part.join(least, ["p_brand", "p_type"]).select("p_partkey", "first_partkey", F.contains("name", F.substring_index("p_name", " ", 1)).alias("confirmed"))


@query("""SELECT d.doc_id, b.item_id IS NOT NULL AS matched, coalesce(b.item_id, d.doc_id % 1000) AS cluster_id FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def enrich_chunks(spark, d):
    items = t(spark, d, "benchmark").select("item_id")
    out = t(spark, d, "documents").select("doc_id").join(items, F.col("item_id") == F.col("doc_id"), "left")
    return out.select("doc_id", F.col("item_id").isNotNull().alias("matched"), F.coalesce("item_id", F.col("doc_id") % 1000).alias("cluster_id"))


@query("""SELECT 'dead' AS side, reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'language' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'good', NULL, count(*) FROM documents WHERE n_chars >= 100 AND lang IN ('en', 'de')""")
def dead_letter_split(spark, d):
    reason = F.when(F.col("n_chars") < 100, "short").when(~F.col("lang").isin("en", "de"), "language")
    good, dead = joins.split_dead(t(spark, d, "documents").select("n_chars", "lang"), reason)
    return dead.groupBy(F.lit("dead").alias("side"), "reason").agg(F.count("*").alias("n")).unionByName(good.agg(F.count("*").alias("n")).select(F.lit("good").alias("side"), F.lit(None).cast("string").alias("reason"), "n"))


@query("""WITH g AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT l_orderkey, l_suppkey FROM g) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) = 1""")
def load_queries(spark, d):
    raw = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_returnflag")
    gold = raw.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    return ordering.dedupe_first(raw.drop("l_returnflag").join(gold, ["l_orderkey", "l_suppkey"], "left_semi"), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"])


@query("SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) = 1")
def dedupe_first(spark, d):
    raw = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return ordering.dedupe_first(raw, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"]).drop("l_linenumber")


@query("SELECT l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 0 AND l_orderkey > 0)")
def valid_pairs(spark, d):
    return t(spark, d, "lineitem").where("l_quantity > 0 AND l_orderkey > 0").select("l_orderkey", "l_suppkey").distinct()


@query("""WITH p AS (SELECT DISTINCT o_custkey AS s, o_orderkey AS d FROM orders), k AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 4000)
SELECT CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both' WHEN a.id IS NOT NULL THEN 'source_only' WHEN b.id IS NOT NULL THEN 'dest_only' ELSE 'neither' END AS kind, count(*) AS n
FROM p LEFT JOIN k a ON s = a.id LEFT JOIN k b ON d = b.id GROUP BY 1""")
def pair_overlap(spark, d):
    ids = t(spark, d, "customer").where("c_acctbal > 4000").select(F.col("c_custkey").alias("id"))
    return joins.pair_overlap(t(spark, d, "orders"), "o_custkey", "o_orderkey", ids)


@query("""WITH l AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 25), r AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25), u AS (SELECT id FROM l UNION SELECT id FROM r),
f AS (SELECT id, id IN (SELECT id FROM l) AS l, id IN (SELECT id FROM r) AS r FROM u), m AS (SELECT max(id) AS m FROM r)
SELECT CAST(count(*) FILTER (l) AS BIGINT) AS n_left, count(*) FILTER (r) AS n_right, count(*) FILTER (l AND r) AS n_both, count(*) AS n_either, max(id) FILTER (l) AS max_left, max(id) FILTER (r) AS max_right,
round(100 * count(*) FILTER (l AND r) / count(*) FILTER (l), 6) AS pct, count(*) FILTER (l AND id > (SELECT m FROM m)) AS n_above FROM f""")
def id_overlap(spark, d):
    left = t(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("id"))
    return joins.overlap(left, t(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id")))


@query("SELECT DISTINCT id FROM (SELECT l_suppkey AS id FROM lineitem UNION ALL SELECT l_partkey FROM lineitem)")
def endpoint_union(spark, d):
    pairs = t(spark, d, "lineitem")
    return pairs.select(F.col("l_suppkey").alias("id")).union(pairs.select("l_partkey")).distinct()


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def id_intersection(spark, d):
    pairs = t(spark, d, "lineitem")
    return pairs.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).intersect(pairs.where("l_returnflag = 'N'").select("l_partkey"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def id_difference(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT 0 AS shard, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer")
def ordered_concat(spark, d):
    one = t(spark, d, "supplier").select(F.lit(0).alias("shard"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return one.unionByName(t(spark, d, "customer").select(F.lit(1).alias("shard"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT o.o_orderkey FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def both_endpoints(spark, d):
    orders = t(spark, d, "orders").join(t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return orders.join(t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT count(*) AS n_left FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resume_antijoin(spark, d):
    done = t(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(t(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"]).agg(F.count("*").alias("n_left"))


@query("SELECT c_mktsegment, max_by(c_name, c_custkey) AS latest FROM customer GROUP BY 1")
def latest_per_group(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_name", "c_custkey").alias("latest"))


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 10000 THEN 'medium' ELSE 'large' END, count(*) FROM documents GROUP BY 2""")
def distributions(spark, d):
    docs = t(spark, d, "documents").select("lang", "source", "n_chars")
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 10000, "medium").otherwise("large")
    long = docs.select(F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("size"), size)).alias("field", "value"))
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 15")
def top_groups(spark, d):
    return ordering.counted(t(spark, d, "documents"), "source").orderBy(F.desc("n"), "source").limit(15)


@query("""SELECT source AS court, count(*) AS n FROM (SELECT DISTINCT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id)) GROUP BY 1""")
def court_distribution(spark, d):
    matched = t(spark, d, "labels").select("doc_id").distinct()
    return t(spark, d, "documents").select("doc_id", F.col("source").alias("court")).join(matched, "doc_id", "left_semi").distinct().groupBy("court").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "court")


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def majority_value(spark, d):
    counts = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return ordering.dedupe_first(counts, ["user_id"], [F.desc("n"), "f"]).select("user_id", "event_type")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def group_frequency(spark, d):
    return ordering.counted(t(spark, d, "lineitem"), "l_suppkey")


@query("SELECT l_suppkey % 4 AS shard, count(*) AS n, sum(l_linenumber)::BIGINT AS total, max(l_extendedprice) AS slowest FROM lineitem GROUP BY 1")
def summary_merge(spark, d):
    parts = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"), F.max("l_extendedprice").alias("slowest"))
    return parts.groupBy((F.col("l_suppkey") % 4).alias("shard")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("slowest").alias("slowest"))


_STATS = "SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT n_chars AS v FROM documents)"


@query(f"""WITH s AS ({_STATS}) SELECT max(v) FILTER (i = n // 2) AS median, max(v) FILTER (i = n // 20) AS p5, max(v) FILTER (i = n // 4) AS p25, max(v) FILTER (i = 3 * n // 4) AS p75,
max(v) FILTER (i = n * 9 // 10) AS p90, max(v) FILTER (i = n * 19 // 20) AS p95, max(v) FILTER (i = n * 99 // 100) AS p99, CAST(floor(avg(v)) AS BIGINT) AS mean, min(v) AS least, max(v) AS most FROM s""")
def length_stats(spark, d):
    docs = t(spark, d, "documents")
    spots = ordering.at_index(docs, "n_chars", [("median", 1, 2), ("p5", 1, 20), ("p25", 1, 4), ("p75", 3, 4), ("p90", 9, 10), ("p95", 19, 20), ("p99", 99, 100)])
    return spots.crossJoin(docs.agg(F.floor(F.avg("n_chars")).cast("bigint").alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")))


@query(f"""WITH s AS ({_STATS}) SELECT min(v) AS least, max(v) FILTER (i = n // 100) AS p1, max(v) FILTER (i = n // 20) AS p5, max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = n * 19 // 20) AS p95, max(v) AS most FROM s""")
def length_percentiles(spark, d):
    docs = t(spark, d, "documents")
    return ordering.at_index(docs, "n_chars", [("p1", 1, 100), ("p5", 1, 20), ("p50", 1, 2), ("p95", 19, 20)]).crossJoin(docs.agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most")))


@query("""WITH s AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(v) FILTER (i = greatest(1, ceil(10 * n / 100))) AS p10, max(v) FILTER (i = greatest(1, ceil(50 * n / 100))) AS p50, max(v) FILTER (i = greatest(1, ceil(90 * n / 100))) AS p90 FROM s GROUP BY 1""")
def nearest_rank(spark, d):
    return ordering.nearest_rank(t(spark, d, "documents"), "n_chars", [("p10", 10), ("p50", 50), ("p90", 90)], ["lang"])


@query("SELECT sum(n_chars // 4)::BIGINT AS tokens, count(*) FILTER (n_chars // 4 > 512) AS over_512, count(*) FILTER (n_chars // 4 > 2048) AS over_2048, count(*) FILTER (n_chars // 4 > 4096) AS over_4096 FROM documents")
def token_stats(spark, d):
    n = X.estimated_tokens(F.col("n_chars"))
    return t(spark, d, "documents").agg(F.sum(n).alias("tokens"), *(F.count_if(n > k).alias(f"over_{k}") for k in (512, 2048, 4096)))


@query("SELECT count(*) - count(DISTINCT doc_id) AS same_id, count(*) - count(DISTINCT sha256(substring(text, 1, 500))) AS same_text FROM documents")
def duplicate_counts(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2(F.substring("text", 1, 500), 256).alias("h"))
    one = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("same_id"))
    return one.crossJoin(docs.groupBy("h").agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("same_text")))


@query("""SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, round(avg(n_chars) FILTER (n_chars >= 100), 6) AS mean_valid, median(n_chars) FILTER (n_chars >= 100) AS median_valid, count(*) FILTER (n_chars > 4096) AS overflow FROM documents""")
def eda_scalars(spark, d):
    n, valid = F.col("n_chars"), F.when(F.col("n_chars") >= 100, F.col("n_chars"))
    return t(spark, d, "documents").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.5).alias("median"), F.round(F.avg(valid), 6).alias("mean_valid"), F.percentile(valid, 0.5).alias("median_valid"), F.count_if(n > 4096).alias("overflow"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / w), 9) AS INT) AS bin, round(any_value(lo) + least(floor((any_value(l_extendedprice) - any_value(lo)) / any_value(w)), 9) * any_value(w), 6) AS lo,
round(any_value(lo) + (least(floor((any_value(l_extendedprice) - any_value(lo)) / any_value(w)), 9) + 1) * any_value(w), 6) AS hi, count(*) AS n FROM lineitem, e GROUP BY 1""")
def histogram(spark, d):
    return ordering.histogram(t(spark, d, "lineitem"), "l_extendedprice")


@query(f"""WITH s AS (SELECT source, {n_words('text')} AS n FROM documents ORDER BY doc_id LIMIT 500) SELECT count(*) AS n, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, count(DISTINCT source) AS n_sources FROM s""")
def sample_stats(spark, d):
    s = t(spark, d, "documents").orderBy("doc_id").limit(500).select("source", X.word_count(F.col("text")).alias("n"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.countDistinct("source").alias("n_sources"))


@query("""SELECT CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' WHEN n < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS bucket, n FROM (SELECT count(*) AS n FROM lineitem)""")
def size_bucket(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n")).select(quality.size_bucket(F.col("n")).alias("bucket"), "n")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY coalesce(list_position(['FRANCE', 'JAPAN', 'CHINA'], n_name), 99), n_name")
def canonical_sort(spark, d):
    known = F.array_position(F.array(*map(F.lit, ("FRANCE", "JAPAN", "CHINA"))), F.col("n_name"))
    return t(spark, d, "nation").orderBy(F.coalesce(F.nullif(known, F.lit(0)), F.lit(99)), "n_name").select("n_nationkey", "n_name")


@query("SELECT event_id % 8 AS shard, count(*) AS n_lines, 0::BIGINT AS n_errors, count(json_extract(props, '$')) AS n_decoded FROM events GROUP BY 1")
def shard_audit(spark, d):
    return quality.shard_audit(t(spark, d, "events").withColumn("shard", F.col("event_id") % 8), "shard", "props")


_DIRTY = "SELECT event_id % 8 AS shard, event_id, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE ELSE value END AS value, CASE WHEN event_id % 301 = 0 THEN 'NaN' ELSE event_type END AS kind FROM events"
_DIRTY_COUNTS = f"SELECT shard, count(*) AS n_rows, count(*) FILTER (isnan(value) OR isinf(value)) AS bad_value, count(*) FILTER (kind IN ('nan', 'NaN', 'inf', '-inf', 'Infinity', '-Infinity')) AS bad_kind FROM ({_DIRTY}) GROUP BY 1"


def _dirty(spark, d):
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return t(spark, d, "events").select((F.col("event_id") % 8).alias("shard"), "event_id", value.alias("value"), F.when(F.col("event_id") % 301 == 0, "NaN").otherwise(F.col("event_type")).alias("kind"))


@query(f"""SELECT *, CASE WHEN bad_value + bad_kind = 0 THEN 'CLEAN' WHEN bad_kind > 0 THEN 'HARD_FAILURE' ELSE 'REPAIRABLE' END AS verdict FROM ({_DIRTY_COUNTS})""")
def nan_audit(spark, d):
    return quality.nan_audit(_dirty(spark, d), "shard", ["value"], ["kind"], advisory=["value"])


@query(f"SELECT event_id, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value, CASE WHEN kind = 'NaN' THEN NULL ELSE kind END AS kind FROM ({_DIRTY})")
def nan_repair(spark, d):
    return quality.nan_repair(_dirty(spark, d), ["value"], ["kind"]).select("event_id", "value", "kind")


@query(f"""SELECT 'before' AS stage, sum(bad_value)::BIGINT AS bad_value, sum(bad_kind)::BIGINT AS bad_kind FROM ({_DIRTY_COUNTS}) UNION ALL SELECT 'after', 0, 0""")
def repair_efficacy(spark, d):
    before = _dirty(spark, d)
    after = quality.nan_repair(before, ["value"], ["kind"])
    sums = [quality.nan_audit(x, "shard", ["value"], ["kind"]).agg(F.sum("bad_value").alias("bad_value"), F.sum("bad_kind").alias("bad_kind")).select(F.lit(s).alias("stage"), "bad_value", "bad_kind") for s, x in (("before", before), ("after", after))]
    return sums[0].unionByName(sums[1])
