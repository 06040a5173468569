"""Corpus building and its checks: nested JSON audits, extraction, contracts of written shards, enrichment, alignment of runs, details of gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import jsonlines as J
from scriptorium.functions import text as X
from scriptorium.operators import contracts as C
from scriptorium.operators import extract as E
from scriptorium.operators import joins, ordering, quality
from scriptorium.operators import retrieval as R
from scriptorium.sources import sinks
from scriptorium.sources.tables import scratch
from scriptorium.sources.tables import table as t

from .base import SP, n_words, query
from .evaluation import METRICS_SQL, RUNS_SQL, _gold, _run
from .textual import _CHARS, _CITES, _ENC, _SIGNALS, _boiler, _html, _signals

# --- nested JSON ---

#: (condition on event_id, line) in order; else the event's own line. The id stands for {}.
_ODD = [
    ("% 53", '{"id": {}, "case_name": NaN, "p": {"k": 1}}'),
    ("% 59", '{"id": {}, "p": {"list": [1, {"x": -Infinity}]}}'),
    ("% 61", '{"case_name": "NaN", "id": {}}'),
    ("% 67", '{"id": {}, "p": '),
    ("% 71", '{"id": {}, "t": "a NaN in a text, \\"NaN\\" quoted"}'),
    ("% 73", '{"id": {}} {}'),
    ("% 79", '{"raw_text": Infinity}'),
]
_LINE = "CASE " + " ".join(f"WHEN event_id {c} = 0 THEN replace('{x}', '{{}}', CAST(event_id AS VARCHAR))" for c, x in _ODD) + " ELSE props END"
#: What a line holds, found by patterns over it with its texts taken out (bare), or emptied of escapes.
_AUDIT = rf"""l AS (SELECT event_id, event_id % 8 AS shard, {_LINE} AS line FROM events),
s AS (SELECT *, regexp_replace(regexp_replace(line, '\\.', '', 'g'), '"[^"]*"', '""', 'g') AS bare FROM l),
v AS (SELECT *, NOT (regexp_matches(bare, '\}} [^,\}}]+$') OR regexp_matches(bare, ': *$')) AS ok, regexp_matches(bare, 'NaN|Infinity') AS number, regexp_matches(line, ': "NaN"') AS spelt FROM s),
f AS (SELECT *, list_filter([CASE WHEN ok AND regexp_matches(line, '"case_name": (NaN|"NaN")') THEN 'case_name' END, CASE WHEN ok AND regexp_matches(bare, '\{{.*\{{.*Infinity') THEN 'p' END, CASE WHEN ok AND regexp_matches(line, '"raw_text": Infinity') THEN 'raw_text' END], lambda x: x IS NOT NULL) AS fields FROM v)"""
_SHARDS = """a AS (SELECT shard, count(*) AS total_lines, count(*) FILTER (NOT ok OR len(fields) > 0) AS nan_lines, count(*) FILTER (ok AND number) AS nonfinite_lines, count(*) FILTER (ok AND spelt) AS sentinel_lines, count(*) FILTER (NOT ok) AS decode_errors FROM f GROUP BY 1),
n AS (SELECT shard, unnest(fields) AS field FROM f), m AS (SELECT shard, field, count(*) AS n FROM n GROUP BY 1, 2)"""
_VERDICT = "CASE WHEN nan_lines = 0 THEN 'CLEAN' WHEN decode_errors > 0 OR fields = '' THEN 'PARSE_FAILURE' WHEN regexp_matches(fields, '(^|,)p:') THEN 'HARD_FAILURE' ELSE 'REPAIRABLE' END AS verdict"


def _lines(spark, d) -> DataFrame:
    i = F.col("event_id")
    line = F.col("props")
    for c, x in reversed(_ODD):
        line = F.when(i % int(c[2:]) == 0, F.replace(F.lit(x), F.lit("{}"), i.cast("string"))).otherwise(line)
    return t(spark, d, "events").select("event_id", (i % 8).alias("shard"), line.alias("line"))


@query(f"WITH {_AUDIT}, {_SHARDS} SELECT *, {_VERDICT} FROM (SELECT a.*, coalesce(x.fields, '') AS fields FROM a LEFT JOIN (SELECT shard, string_agg(field || ':' || n, ',' ORDER BY field) AS fields FROM m GROUP BY 1) x USING (shard))")
def nan_audit_nested(spark, d):
    out = J.audit(_lines(spark, d), "shard", "line")
    return out.withColumn("verdict", J.verdict(F.col("nan_lines"), F.col("decode_errors"), F.col("fields"))).withColumn("fields", J.fields_text(F.col("fields")))


@query(f"""WITH {_AUDIT}, {_SHARDS}, w AS (SELECT count(*) AS total_shards, count(*) FILTER (nan_lines > 0) AS nan_shards, string_agg(shard, ',' ORDER BY shard) FILTER (nan_lines > 0) AS contaminated, sum(total_lines)::BIGINT AS total_lines, sum(nan_lines)::BIGINT AS nan_lines,
sum(nonfinite_lines)::BIGINT AS nonfinite_lines, sum(sentinel_lines)::BIGINT AS sentinel_lines, sum(decode_errors)::BIGINT AS decode_errors, (SELECT string_agg(field || ':' || n, ',' ORDER BY field) FROM (SELECT field, sum(n)::BIGINT AS n FROM m GROUP BY 1)) AS fields FROM a) SELECT *, {_VERDICT} FROM w""")
def dataset_health(spark, d):
    out = J.health(J.audit(_lines(spark, d), "shard", "line"))
    return out.withColumn("contaminated", F.array_join(F.transform("contaminated", lambda x: x.cast("string")), ",")).withColumn("fields", J.fields_text(F.col("fields")))


@query(rf"""WITH {_AUDIT} SELECT event_id, CASE WHEN ok AND number THEN regexp_replace(line, '-?(NaN|Infinity)', 'null', 'g') ELSE line END AS line, ok AND number AS changed FROM f""")
def nan_repair_nested(spark, d):
    return J.repair(_lines(spark, d), "line").select("event_id", "line", "changed")


@query(f"WITH {_AUDIT} SELECT shard, count(*) AS n_lines, count(*) FILTER (NOT ok) AS n_errors, count(*) FILTER (ok) AS n_decoded FROM f GROUP BY 1")
def shard_audit_damaged(spark, d):
    return quality.shard_audit(_lines(spark, d), "shard", "line")


# --- extraction ---

_OPINIONS = """o AS (SELECT CASE WHEN doc_id % 29 = 0 THEN 'x' || doc_id ELSE ' ' || doc_id END AS id, CASE WHEN doc_id % 31 = 0 THEN '1.5' ELSE CAST(doc_id % 700 AS VARCHAR) END AS cluster_id, doc_id,
CASE WHEN doc_id % 3 = 0 THEN text END AS plain_text, CASE WHEN doc_id % 3 = 1 THEN '<p>' || text || '</p>' WHEN doc_id % 3 = 2 AND doc_id % 5 = 0 THEN '<b>' || substring(text, 1, 20) || '</b>' || repeat('<br/>', 10) WHEN doc_id % 3 = 2 THEN 'Not Reported in F.' || chr(10) || text END AS html FROM documents)"""
_CLUSTERS = """c AS (SELECT c_custkey AS cid, c_nationkey AS docket_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS case_name, CASE WHEN c_custkey % 3 = 0 THEN '2020-01-01' END AS date_filed, CASE WHEN c_custkey % 2 = 0 THEN 'Published' ELSE c_mktsegment END AS status FROM customer WHERE c_custkey <= 400),
k AS (SELECT n_nationkey AS did, CASE WHEN n_nationkey % 7 <> 0 THEN CAST(n_regionkey AS VARCHAR) END AS court_id, n_name AS docket_name, '1999-12-31' AS docket_date FROM nation WHERE n_nationkey <> 3), r AS (SELECT CAST(r_regionkey AS VARCHAR) AS rid, r_name FROM region WHERE r_regionkey <> 2)"""
_TAGGED = rf"""{_OPINIONS}, {_CLUSTERS},
b AS (SELECT *, CASE WHEN regexp_matches(cluster_id, '^[0-9]+$') THEN cluster_id::BIGINT END AS cl, CASE WHEN regexp_matches(id, '^ *[0-9]+$') THEN trim(id)::BIGINT END AS num,
CASE WHEN length(regexp_replace(plain_text, '^{SP}+|{SP}+\z', '', 'g')) >= 50 THEN plain_text WHEN length(regexp_replace(html, '^{SP}+|{SP}+\z', '', 'g')) >= 50 THEN html END AS raw,
CASE WHEN length(regexp_replace(plain_text, '^{SP}+|{SP}+\z', '', 'g')) >= 50 THEN 'plain_text' WHEN length(regexp_replace(html, '^{SP}+|{SP}+\z', '', 'g')) >= 50 THEN 'html' END AS text_source FROM o),
e1 AS (SELECT *, {_ENC.replace('html', 'raw')} AS one FROM b), e2 AS (SELECT *, CASE WHEN text_source = 'html' THEN {_html('one')} ELSE one END AS two FROM e1), e3 AS (SELECT *, {_boiler('two')} AS three FROM e2),
e4 AS (SELECT *, regexp_replace(regexp_replace(three, '\n\n\n+', chr(10) || chr(10), 'g'), '^{SP}+|{SP}+\z', '', 'g') AS text FROM e3),
g AS (SELECT *, CASE WHEN cl IS NULL THEN 'bad_cluster_id' WHEN cl NOT IN (SELECT cid FROM c) THEN 'outside' WHEN raw IS NULL THEN 'empty' WHEN length(text) < 50 THEN 'stub' WHEN num IS NULL THEN 'bad_opinion_id' ELSE 'kept' END AS outcome FROM e4)"""


def _sides(spark, d):
    i = F.col("doc_id")
    text = F.col("text")
    docs = t(spark, d, "documents").select(
        F.when(i % 29 == 0, F.concat(F.lit("x"), i)).otherwise(F.concat(F.lit(" "), i)).alias("id"), F.when(i % 31 == 0, "1.5").otherwise((i % 700).cast("string")).alias("cluster_id"), "doc_id", F.when(i % 3 == 0, text).alias("plain_text"),
        F.when(i % 3 == 1, F.concat(F.lit("<p>"), text, F.lit("</p>"))).when((i % 3 == 2) & (i % 5 == 0), F.concat(F.lit("<b>"), F.substring(text, 1, 20), F.lit("</b>"), F.lit("<br/>" * 10))).when(i % 3 == 2, F.concat(F.lit("Not Reported in F.\n"), text)).alias("html"),
    )
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    clusters = t(spark, d, "customer").where(k <= 400).select(k.alias("id"), F.col("c_nationkey").alias("docket_id"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("case_name"), F.when(k % 3 == 0, "2020-01-01").alias("date_filed"), F.when(k % 2 == 0, "Published").otherwise(F.col("c_mktsegment")).alias("precedential_status"))
    dockets = t(spark, d, "nation").where(n != 3).select(n.alias("id"), F.when(n % 7 != 0, F.col("n_regionkey").cast("string")).alias("court_id"), F.col("n_name").alias("case_name"), F.lit("1999-12-31").alias("date_filed"))
    courts = t(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("full_name"))
    return docs, clusters, dockets, courts


def _extracted(spark, d):
    return E.extract(*_sides(spark, d), ["plain_text", "html"])


@query(f"WITH {_TAGGED} SELECT outcome, count(*) AS n FROM g GROUP BY 1")
def extract_outcomes(spark, d):
    return _extracted(spark, d)[2]


@query(f"WITH {_TAGGED} SELECT outcome AS reason, id, cluster_id, doc_id FROM g WHERE outcome IN ('bad_cluster_id', 'bad_opinion_id')")
def extract_quarantine(spark, d):
    return _extracted(spark, d)[1].select("reason", "id", "cluster_id", "doc_id")


@query(f"""WITH {_TAGGED} SELECT num AS id, cl AS cluster_id, docket_id, coalesce(court_id, '') AS court_id, coalesce(r_name, '') AS court_name, coalesce(nullif(case_name, ''), docket_name, '') AS case_name, coalesce(date_filed, docket_date, '') AS date_filed, status AS precedential_status,
status = 'Published' AS is_precedential, text_source, length(raw) AS raw_length, length(text) AS text_length, length(text) // 4 AS token_count, {_CITES} AS citation_count, sha256(text) AS text_hash, round({_CHARS}, 5) AS text_entropy, 'bulk' AS source
FROM g JOIN c ON cl = cid LEFT JOIN k ON docket_id = did LEFT JOIN r ON court_id = rid WHERE outcome = 'kept'""")
def extract_records(spark, d):
    r = _extracted(spark, d)[0].withColumn("raw_length", F.length("raw_text")).withColumn("text_entropy", F.round("text_entropy", 5))
    return r.select("court_name", "court_id", "docket_id", "cluster_id", "id", "case_name", "date_filed", "precedential_status", "is_precedential", "text_source", "raw_length", "text_length", "token_count", "citation_count", "text_hash", "text_entropy", "source")


@query("SELECT n_nationkey, n_name FROM nation WHERE regexp_matches(lower(CASE n_nationkey % 4 WHEN 0 THEN 'U.S. COURT OF APPEALS, ' || n_name WHEN 1 THEN 'Second Circuit ' || n_name WHEN 2 THEN n_name || ' District Court' END), 'court of appeals|second circuit')")
def appellate_filter(spark, d):
    k, name = F.col("n_nationkey") % 4, F.col("n_name")
    court = F.when(k == 0, F.concat(F.lit("U.S. COURT OF APPEALS, "), name)).when(k == 1, F.concat(F.lit("Second Circuit "), name)).when(k == 2, F.concat(name, F.lit(" District Court")))
    return t(spark, d, "nation").where(E.is_appellate(court)).select("n_nationkey", "n_name")


@query("SELECT n_nationkey FROM nation WHERE CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END IN ('', '1')")
def court_filter_missing(spark, d):
    return t(spark, d, "nation").where(E.in_courts(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")), ["", "1"])).select("n_nationkey")


@query("""WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || event_id WHEN 1 THEN event_id || '.0' WHEN 2 THEN 'n' || event_id WHEN 3 THEN '-' || event_id WHEN 4 THEN '' ELSE '99999999999999999999' END AS raw FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 3 THEN -event_id ELSE 0 END AS value, CASE WHEN event_id % 6 IN (0, 3) THEN NULL ELSE 'bad_id' END AS reason FROM s""")
def safe_ints(spark, d):
    i = F.col("event_id")
    k = i % 6
    raw = F.when(k == 0, F.concat(F.lit(" "), i)).when(k == 1, F.concat(i, F.lit(".0"))).when(k == 2, F.concat(F.lit("n"), i)).when(k == 3, F.concat(F.lit("-"), i)).when(k == 4, "").otherwise("99999999999999999999")
    value = E.safe_int(raw)
    return t(spark, d, "events").select("event_id", F.coalesce(value, F.lit(0)).alias("value"), F.when(value.isNull(), "bad_id").alias("reason"))


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN url END AS url, CASE WHEN page_id % 2 = 0 THEN html END AS contents, CASE WHEN page_id % 4 = 1 THEN substring(html, 1, 30) WHEN page_id % 4 = 3 THEN html END AS text FROM pages)
SELECT page_id, url, url AS source_url, regexp_replace(coalesce(text, contents), '^{SP}+|{SP}+\\z', '', 'g') AS text, CASE WHEN text IS NOT NULL THEN 'text' ELSE 'contents' END AS source_text_field, '2024-01-02T03:04:05Z' AS created_timestamp FROM p WHERE url IS NOT NULL AND length(coalesce(text, contents)) >= 100""")
def valid_rows(spark, d):
    i, html = F.col("page_id"), F.col("html")
    rows = t(spark, d, "pages").select("page_id", F.when(i % 11 != 0, F.col("url")).alias("url"), F.when(i % 2 == 0, html).alias("contents"), F.when(i % 4 == 1, F.substring(html, 1, 30)).when(i % 4 == 3, html).alias("text"), F.lit("at 2024-01-02T03:04:05Z").alias("created_timestamp"))
    return E.valid_rows(rows, ["url", "created_timestamp"], ["text", "contents"], 100).select("page_id", "url", "source_url", "text", "source_text_field", "created_timestamp")


@query("SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y') END AS year, count(*) AS n FROM orders GROUP BY 1")
def year_counts(spark, d):
    date = F.when(F.col("o_orderkey") % 9 == 0, "nan").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t(spark, d, "orders").groupBy(X.year(date).alias("year")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT e.event_id FROM events e JOIN l ON e.user_id = l.user_id WHERE l.event_type IN (SELECT min(event_type) FROM events UNION ALL SELECT max(event_type) FROM events)""")
def last_wins_chain(spark, d):
    """A user's last row decides whether the user is kept, and a kept user's events are."""
    events = t(spark, d, "events")
    kinds = events.agg(F.array(F.min("event_type"), F.max("event_type")).alias("k")).select(F.explode("k").alias("event_type"))
    users = E.last_by_key(events.select("user_id", "event_type", "event_id"), "user_id", "event_id")
    return joins.filter_chain(kinds, (users.select("user_id", "event_type"), "event_type", "event_type"), (events.select("event_id", "user_id"), "user_id", "user_id")).select("event_id")


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_seen FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2")
def ordered_pairs(spark, d):
    """Distinct pairs with where they come first, by which they can be put in order."""
    return t(spark, d, "lineitem").where("l_quantity > 0").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_seen"))


# --- contracts, enrichment, alignment ---


@query("""WITH s AS (SELECT * FROM documents WHERE doc_id < 150) SELECT unnest(['shard_dir_exists', 'manifest_exists', 'shards_exist', 'total_count', 'valid_json', 'text_present', 'provenance_fields', 'raw_and_normalized_text', 'schema_consistent', 'checksums']) AS contract, true AS passed, 0::BIGINT AS n_bad
UNION ALL SELECT 'text_substantive', avg(CASE WHEN length(text) < 200 THEN 1.0 ELSE 0.0 END) <= 0.1, CASE WHEN avg(CASE WHEN length(text) < 200 THEN 1.0 ELSE 0.0 END) <= 0.1 THEN 0 ELSE 1 END FROM s
UNION ALL SELECT 'text_source_tracked', count(*) FILTER (lang NOT IN ('en', 'fr')) = 0, count(*) FILTER (lang NOT IN ('en', 'fr')) FROM s UNION ALL SELECT 'multiple_circuits', count(DISTINCT source) >= 5, greatest(0, 5 - count(DISTINCT source)) FROM s""")
def corpus_contracts(spark, d):
    docs = t(spark, d, "documents").where("doc_id < 150").select(
        F.col("doc_id").alias("id"), F.col("source").alias("court_id"), F.lit(1).alias("docket_id"), F.lit("a v. b").alias("case_name"), F.lit("2020-01-01").alias("date_filed"), F.lit("Published").alias("precedential_status"), F.col("lang").alias("text_source"),
        F.col("text").alias("raw_text"), "text", F.array(F.lit("html_stripped")).alias("cleaning_flags"),
    )
    path = f"{scratch(spark)}/corpus-{uuid.uuid4().hex}"
    sinks.write_shards(docs.coalesce(1), path, "json")
    manifest = sinks.write_manifest(spark, path, docs.groupBy(F.lit("court_id").alias("field"), F.col("court_id").alias("value")).agg(F.count("*").alias("n")))
    return C.corpus_contracts(spark, path, manifest, ["en", "fr"], min_total=100, min_text=200)


_ENRICHED = "e AS (SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 3 THEN d.doc_id + 5000 ELSE b.item_id * 7 END AS cluster_id FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 60)"


def _enriched(spark, d):
    i = F.col("doc_id")
    rows = t(spark, d, "documents").select("doc_id", (i % 60).alias("key"), F.when(i % 10 == 3, i + 5000).alias("cluster_id"))
    return joins.enrich(rows, t(spark, d, "benchmark").select("item_id", (F.col("item_id") * 7).alias("cluster_id")), "key", "item_id", "cluster_id")


@query(f"WITH {_ENRICHED} SELECT doc_id, cluster_id FROM e WHERE cluster_id IS NOT NULL")
def enriched_chunks(spark, d):
    return _enriched(spark, d)[0].select("doc_id", "cluster_id")


@query(f"WITH {_ENRICHED} SELECT doc_id FROM e WHERE cluster_id IS NULL")
def enrich_dead_letters(spark, d):
    return _enriched(spark, d)[1].select("doc_id")


@query(f"""WITH {_ENRICHED} SELECT count(*) AS n_total, count(cluster_id) AS n_enriched, count(*) - count(cluster_id) AS n_unmatched, round((count(*) - count(cluster_id)) / count(*), 6) AS unmatched_rate,
(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT doc_id % 60 AS k FROM e WHERE cluster_id IS NULL ORDER BY 1 LIMIT 20)) AS sample_unmatched FROM e""")
def enrich_summary(spark, d):
    # SQL has null where there is nothing to list, and NaN where there is nothing to divide by
    listed = F.when(F.size("sample_unmatched") > 0, F.array_join(F.transform("sample_unmatched", lambda x: x.cast("string")), ","))
    return _enriched(spark, d)[2].withColumns({"sample_unmatched": listed, "unmatched_rate": F.when(F.col("n_total") > 0, F.col("unmatched_rate")).otherwise(float("nan"))})


_TWO_RUNS = "x AS (SELECT o_orderkey AS q, o_custkey AS c, o_totalprice AS s FROM orders WHERE o_orderkey % 5 <> 1), y AS (SELECT o_orderkey AS q, o_custkey AS c, o_orderstatus AS t FROM orders WHERE o_orderkey % 7 <> 2)"


@query(f"WITH {_TWO_RUNS} SELECT (SELECT count(*) FROM x) AS n_a, (SELECT count(*) FROM y) AS n_b, count(*) FILTER (x.q IS NOT NULL AND y.q IS NOT NULL) AS n_both, count(*) FILTER (y.q IS NULL) AS n_only_a, count(*) FILTER (x.q IS NULL) AS n_only_b, 0::BIGINT AS n_repeated FROM x FULL JOIN y ON x.q = y.q AND x.c = y.c")
def run_alignment(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("c"))
    return joins.alignment(o.where("q % 5 <> 1"), o.where("q % 7 <> 2"), ["q", "c"])


@query("SELECT o_orderkey AS q, o_custkey AS c, o_totalprice AS s, o_orderstatus AS t FROM orders")
def aligned_runs(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("s"), F.col("o_orderstatus").alias("t"))
    return joins.aligned(o.select("q", "c", "s"), o.select("q", "c", "t"), ["q", "c"])


@query(f"WITH {RUNS_SQL}, sk AS (SELECT * FROM ra WHERE query_id % 3 <> 0) SELECT {METRICS_SQL}, (SELECT count(DISTINCT query_id) FROM a WHERE query_id NOT IN (SELECT query_id FROM sk)) AS n_skipped FROM sk")
def evaluate_with_skips(spark, d):
    return R.evaluate(_gold(spark, d).where("query_id % 3 <> 0"), _run(spark, d, "l_extendedprice"), (1, 2, 3), (3,))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'no citation' ELSE (doc_id % 50 + 1) || '  F.  Supp. 3d ' || (doc_id % 97) || ', 12' END AS cite, CASE WHEN doc_id % 2 = 0 THEN 'priority 1' ELSE 'priority 2' END AS snippet FROM documents),
i AS (SELECT p_size AS v, p_partkey % 97 AS g, p_partkey AS cluster_id FROM part QUALIFY row_number() OVER (PARTITION BY p_size, p_partkey % 97 ORDER BY p_partkey) = 1),
o AS (SELECT l_partkey AS cluster_id, min(l_orderkey) AS opinion_id FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1), x AS (SELECT o.*, 'of priority ' || (opinion_id % 2 + 1) AS t FROM o)
SELECT doc_id, coalesce(i.cluster_id, -1) AS cluster_id, coalesce(x.opinion_id, -1) AS opinion_id, CASE WHEN doc_id % 13 = 0 THEN 'unparsed' WHEN i.cluster_id IS NULL THEN 'unindexed' WHEN x.opinion_id IS NULL THEN 'no_opinion' WHEN contains(t, snippet) THEN 'confirmed' ELSE 'unconfirmed' END AS stage
FROM p LEFT JOIN i ON doc_id % 13 <> 0 AND v = doc_id % 50 + 1 AND g = doc_id % 97 LEFT JOIN x USING (cluster_id)""")
def citation_chain(spark, d):
    i = F.col("doc_id")
    cite = F.when(i % 13 == 0, "no citation").otherwise(F.concat(i % 50 + 1, F.lit("  F.  Supp. 3d "), i % 97, F.lit(", 12")))
    rows = t(spark, d, "documents").select("doc_id", cite.alias("cite"), F.when(i % 2 == 0, "priority 1").otherwise("priority 2").alias("snippet"))
    index = t(spark, d, "part").select(F.col("p_size").cast("string").alias("volume"), F.lit(" F. SUPP.  3D").alias("reporter"), (F.col("p_partkey") % 97).cast("string").alias("page"), F.col("p_partkey").alias("cluster_id"))
    opinions = t(spark, d, "lineitem").where("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("cluster_id"), F.col("l_orderkey").alias("opinion_id"), F.concat(F.lit("of priority "), F.col("l_orderkey") % 2 + 1).alias("text"))
    return joins.citation_chain(rows, F.col("cite"), index, ["cluster_id"], opinions, "snippet").select("doc_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("opinion_id", F.lit(-1)).alias("opinion_id"), "stage")


_CITED = "substring(text, 1, 100) || ' In Acme Ltd. 347 U.S. 483 the rest, and 12 F. Supp. 2d at 9 then ACME LTD. too ' || substring(text, 101)"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_CITED}, '(?i)\bacme ltd\b', '[MASK]', 'g'), '347 U\.S\. 483|12 F\. Supp\. 2d at 9', '[MASK]', 'g'), '\[MASK\]\. \[MASK\]', '[MASK]', 'g') AS text FROM documents WHERE NOT regexp_matches(text, '[0-9] ')")
def detected_spans(spark, d):
    cited = F.concat(F.substring("text", 1, 100), F.lit(" In Acme Ltd. 347 U.S. 483 the rest, and 12 F. Supp. 2d at 9 then ACME LTD. too "), F.expr("substring(text, 101)"))
    docs = t(spark, d, "documents").where(~F.regexp_like("text", F.lit("[0-9] "))).select("doc_id", cited.alias("text"))
    return docs.select("doc_id", X.mask_citations(F.col("text"), F.array(F.lit("Acme Ltd"), F.lit("")), gap=2).alias("text"))


# --- details of gates ---

_CHECKS = {
    "missing_text": ("text IS NULL", "presence"), "missing_source": ("source IS NULL", "presence"), "negative_length": ("n_chars < 0", "range"), "unknown_lang": ("lang NOT IN ('en', 'fr', 'de')", "vocabulary"),
    "length_off": ("abs(n_chars + doc_id % 300 - length(text)) > 200 OR abs(n_chars + doc_id % 300 - length(text)) > 0.05 * greatest(length(text), 1)", "consistency"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS check_name, '{kind}' AS kind, count(*) FILTER ({c}) AS n_bad, count(*) FILTER ({c}) = 0 AS passed FROM documents" for k, (c, kind) in _CHECKS.items()))
def schema_checks(spark, d):
    return quality.check_rows(t(spark, d, "documents"), {k: (F.expr(c), kind) for k, (c, kind) in _CHECKS.items()})


@query("""WITH s AS (SELECT source, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT round(sum(pct) FILTER (source <> 'src1'), 2) AS known FROM s)
SELECT source, n, pct, known AS known_pct, round(100 - known, 2) AS unknown_pct, known >= 80 AS passed FROM s, k""")
def text_source_breakdown(spark, d):
    return quality.breakdown(t(spark, d, "documents"), "source", F.col("source") != "src1", 80)


@query(f"""WITH s AS (SELECT {n_words('text')} AS n FROM documents) SELECT round(avg(n), 1) AS mean_tokens, median(n) AS median_tokens, max(n) AS max_tokens, count(*) FILTER (n > 2000) AS over_limit, round(100.0 * count(*) FILTER (n > 2000) / count(*), 2) AS over_pct, 'advisory' AS severity FROM s""")
def prompt_lengths(spark, d):
    return quality.long_prompts(t(spark, d, "documents"), X.word_count(F.col("text")), 2000)


_ANCHORS = f"len(regexp_extract_all(substring(text, 1, 50000), '{X.CITATION}'))"


@query(f"""WITH s AS (SELECT length(text) > 50000 AS capped, {_ANCHORS} AS k, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS field FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' 347 U.S. 483' ELSE text END AS text FROM documents))
SELECT count(*) AS n, count(*) FILTER (capped) AS n_capped, count(*) FILTER (k > 0) AS n_anchored, round(100.0 * count(*) FILTER (k > 0) / count(*), 2) AS pct_anchored, round(avg(k), 2) AS mean_anchors, count(*) FILTER (field > 0) AS field_nonzero, count(*) FILTER (field > 0 AND k = 0) AS field_nonzero_regex_zero,
round(100.0 * count(*) FILTER (field > 0 AND k = 0) / count(*) FILTER (field > 0), 2) AS disagree_pct, 100.0 * count(*) FILTER (k > 0) / count(*) >= 60 AS passed FROM s""")
def anchor_details(spark, d):
    docs = t(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 347 U.S. 483"))).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("field"))
    return quality.anchors(docs, F.col("text"), F.col("field"))


@query(f"""WITH s AS (SELECT doc_id, {_CHARS} AS e, CASE WHEN doc_id % 50 = 7 THEN {_CHARS} + 0.5 ELSE {_CHARS} END AS stored FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100))
SELECT count(*) AS sample_n, round(max(abs(e - stored)), 4) AS max_deviation, max(abs(e - stored)) <= 0.01 AS consistent, count(*) FILTER (stored = 0) AS zero_entropy, true AS passed FROM s""")
def entropy_spot_check(spark, d):
    docs = t(spark, d, "documents").orderBy("doc_id").limit(100)
    e = X.char_entropy(F.col("text"))
    return quality.stored_against(docs.withColumn("stored", F.when(F.col("doc_id") % 50 == 7, e + 0.5).otherwise(e)), F.col("stored"), e)


@query(f"WITH s AS ({_SIGNALS} WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY md5('signals:' || doc_id), doc_id LIMIT 120)) SELECT count(*) AS sample_n, count(*) FILTER (len(signals) = 0) AS n_clean, round(100.0 * count(*) FILTER (len(signals) = 0) / count(*), 2) AS pct_clean, sum(len(signals))::BIGINT AS n_signals FROM s")
def signals_pct_clean(spark, d):
    sample = ordering.sample_n(t(spark, d, "documents").select("doc_id", "text"), 120, "signals", "doc_id")
    return _signals(sample).agg(F.count("*").alias("sample_n"), F.count_if(F.size("signals") == 0).alias("n_clean"), F.round(100 * F.count_if(F.size("signals") == 0) / F.count("*"), 2).alias("pct_clean"), F.sum(F.size("signals")).alias("n_signals"))


@query("SELECT 'passed' AS outcome, 2::BIGINT AS n, 'a,f' AS gates, false AS all_passed UNION ALL SELECT 'failed_blocking', 1, 'b', false UNION ALL SELECT 'failed_advisory', 1, 'c', false UNION ALL SELECT 'skipped', 2, 'd,e', false")
def gate_rollup(spark, d):
    rows = [("a", "blocking", True), ("b", "blocking", False), ("c", "advisory", False), ("d", "blocking", None), ("e", "advisory", None), ("f", "advisory", True)]
    return quality.rollup(spark.createDataFrame(rows, "gate string, severity string, passed boolean"))


@query("""SELECT 1 AS step, 'all' AS stage, count(*) AS n FROM documents UNION ALL SELECT 2, 'long', count(*) FILTER (n_chars >= 100) FROM documents UNION ALL SELECT 3, 'english', count(*) FILTER (n_chars >= 100 AND lang = 'en') FROM documents
UNION ALL SELECT 4, 'labelled', count(*) FILTER (n_chars >= 100 AND lang = 'en' AND doc_id IN (SELECT doc_id FROM labels)) FROM documents""")
def funnel(spark, d):
    known = t(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    docs = t(spark, d, "documents").select("doc_id", "n_chars", "lang").join(known, "doc_id", "left")
    return quality.funnel(docs, [("all", F.lit(True)), ("long", F.col("n_chars") >= 100), ("english", F.col("lang") == "en"), ("labelled", F.col("known"))])


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")
def heatmap(spark, d):
    return quality.heatmap(t(spark, d, "documents"), "lang", "source")


@query(rf"SELECT page_id, row_number() OVER (ORDER BY page_id) AS ordinal, {_html('html')} AS html FROM pages")
def clean_in_order(spark, d):
    """A cleaned field with each row's place, by which the file's order can be had again."""
    return ordering.positions(t(spark, d, "pages").select("page_id", "html"), [F.col("page_id")], "ordinal").withColumn("html", X.strip_html(F.col("html")))
