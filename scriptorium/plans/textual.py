"""Text functions, chunking, gates and contracts on documents and pages."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from scriptorium.functions import text as X
from scriptorium.operators import ordering, quality
from scriptorium.sources.tables import table as t

from .base import W, n_words, query, stripped

_C1 = "".join(f"chr({c}) || " for c in range(0x80, 0xA0)) + "''"
_ENC = "replace(translate(html, '“”‘’–' || {c1}, '\"\"''''-'), '—', '--')".format(c1=_C1)


def _html(x):
    return stripped(f"regexp_replace(regexp_replace({x}, '{X.TAG}', ' ', 'g'), '[ \\t]+', ' ', 'g')")


def _boiler(x):
    head = rf"regexp_replace({x}, '(?m)^(?:Only the Westlaw citation|Not Reported in )[^\n]*\n', '', 'g')"
    return stripped(rf"regexp_replace({head}, '\n?\*[0-9]+\n?', ' ', 'g')")


@query(f"SELECT page_id, {_ENC} AS text FROM pages")
def clean_encoding(spark, d):
    return t(spark, d, "pages").select("page_id", X.clean_encoding(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_html('html')} AS text FROM pages")
def strip_html(spark, d):
    return t(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(f"SELECT doc_id, {_boiler('text')} AS text FROM documents")
def remove_boilerplate(spark, d):
    return t(spark, d, "documents").select("doc_id", X.remove_boilerplate(F.col("text")).alias("text"))


@query(rf"""WITH a AS (SELECT page_id, html, {_ENC} AS one FROM pages), b AS (SELECT *, {_html('one')} AS two FROM a), c AS (SELECT *, {_boiler('two')} AS three FROM b), e AS (SELECT *, {stripped(r"regexp_replace(three, '\n\n\n+', chr(10) || chr(10), 'g')")} AS four FROM c)
SELECT page_id, four AS text, array_to_string(list_filter([CASE WHEN one <> html THEN 'encoding_cleaned' END, 'html_stripped', CASE WHEN three <> two THEN 'boilerplate_removed' END, CASE WHEN regexp_matches(three, '\n\n\n') THEN 'newlines_collapsed' END, CASE WHEN four <> {stripped('html')} THEN 'whitespace_trimmed' END], lambda x: x IS NOT NULL), ',') AS flags FROM e""")
def normalize_text(spark, d):
    out = X.normalize(t(spark, d, "pages").select("page_id", F.col("html").alias("text"), F.lit("html").alias("source")), "text", "source")
    return out.select("page_id", "text", F.array_join("cleaning_flags", ",").alias("flags"))


@query(f"""SELECT page_id, CASE WHEN length({stripped('url')}) >= 50 THEN url WHEN length({stripped('html')}) >= 50 THEN html END AS text, CASE WHEN length({stripped('url')}) >= 50 THEN 'url' WHEN length({stripped('html')}) >= 50 THEN 'html' END AS source FROM pages""")
def select_best_text(spark, d):
    return t(spark, d, "pages").select("page_id", X.select_best_text(["url", "html"]).alias("b")).select("page_id", "b.text", "b.source")


_CITES = "len(regexp_extract_all(text, '" + X.CITATION + "'))"
_PARAS = f"greatest(len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: length({stripped('x')}) > 0)), 1)"
_CHARS = "(SELECT CASE WHEN sum(k) > 0 THEN -sum(k / s * log2(k / s)) ELSE 0.0 END FROM (SELECT count(*) AS k, sum(count(*)) OVER () AS s FROM (SELECT unnest(string_split(text, '')) AS c) GROUP BY c))"


@query(f"SELECT doc_id, {_CITES} AS n_citations FROM documents")
def citation_count(spark, d):
    return t(spark, d, "documents").select("doc_id", X.citation_count(F.col("text")).alias("n_citations"))


@query(f"SELECT doc_id, {_PARAS} AS n_paragraphs FROM documents")
def paragraph_count(spark, d):
    return t(spark, d, "documents").select("doc_id", X.paragraph_count(F.col("text")).alias("n_paragraphs"))


@query("""WITH c AS (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY 1, 2), p AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM c)
SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def char_entropy(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(X.char_entropy(F.col("text")), 6).alias("entropy"))


@query(f"""WITH c AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{W}')) AS w FROM documents) GROUP BY 1, 2), p AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM c)
SELECT doc_id, round(abs(sum(p * log2(p))), 6) AS entropy FROM p GROUP BY 1""")
def word_entropy(spark, d):
    return t(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.round(F.abs(X.word_entropy(F.col("text"))), 6).alias("entropy"))


@query(f"""SELECT doc_id, length(text) AS text_length, length(text) // 4 AS token_count, {_PARAS} AS paragraph_count, {_CITES} AS citation_count, CASE WHEN length(text) // 4 > 0 THEN round({_CITES} / (length(text) // 4) * 1000, 6) ELSE 0.0 END AS citation_density, sha256(text) AS text_hash, lang = 'en' AS is_precedential FROM documents""")
def doc_features(spark, d):
    text, n = F.col("text"), F.length("text")
    return t(spark, d, "documents").select("doc_id", n.alias("text_length"), X.estimated_tokens(n).alias("token_count"), X.paragraph_count(text).alias("paragraph_count"), X.citation_count(text).alias("citation_count"), F.round(X.density(X.citation_count(text), n), 6).alias("citation_density"), F.sha2(text, 256).alias("text_hash"), (F.coalesce(F.col("lang"), F.lit("")) == "en").alias("is_precedential"))


@query(f"""SELECT doc_id, list_filter([CASE WHEN text IS NULL THEN 'text' END, CASE WHEN length(text) < 100 OR text IS NULL THEN 'min_length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END], lambda x: x IS NOT NULL)::VARCHAR AS errors FROM documents""")
def row_validation(spark, d):
    e = quality.errors((F.col("text").isNotNull(), "text"), (F.length("text") >= 100, "min_length"), (F.col("lang").isin("en", "de", "fr"), "lang"))
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(e, ", "), F.lit("]")).alias("errors"))


@query(f"SELECT doc_id FROM documents WHERE {n_words('text')} >= 250")
def min_tokens_filter(spark, d):
    return t(spark, d, "documents").where(X.word_count(F.col("text")) >= 250).select("doc_id")


@query("SELECT doc_id, n_chars, length(text) AS actual, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) <> n_chars THEN 'stale' ELSE 'short' END AS kind FROM documents WHERE n_chars < 100")
def length_anomalies(spark, d):
    n = F.length("text")
    return t(spark, d, "documents").where("n_chars < 100").select("doc_id", "n_chars", n.alias("actual"), F.when(n == 0, "empty").when(n != F.col("n_chars"), "stale").otherwise("short").alias("kind"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 201 WHEN doc_id % 7 = 0 THEN n_chars + 20 ELSE n_chars END AS stored, length(text) AS actual FROM documents)
SELECT doc_id, CASE WHEN abs(stored - actual) > 200 OR abs(stored - actual) > 0.05 * actual THEN actual ELSE stored END AS text_length, abs(stored - actual) > 200 OR abs(stored - actual) > 0.05 * actual AS repaired FROM s""")
def length_repair(spark, d):
    stored = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 201).when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 20).otherwise(F.col("n_chars"))
    off = quality.length_off(stored, F.length("text"))
    return t(spark, d, "documents").select("doc_id", F.when(off, F.length("text")).otherwise(stored).alias("text_length"), off.alias("repaired"))


_TS = "CASE event_id % 5 WHEN 0 THEN 'on ' || strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.5Z' ELSE 'none' END"


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN '' WHEN 4 THEN '' ELSE {_TS} END AS stamp FROM events""")
def normalize_timestamp(spark, d):
    k, full = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd"))).when(k == 1, F.concat(full, F.lit("Z"))).when(k == 2, F.concat(full, F.lit("+02:00"))).when(k == 3, F.concat(full, F.lit(".5Z"))).otherwise("none")
    return t(spark, d, "events").select("event_id", X.normalize_timestamp(raw).alias("stamp"))


_CITED = "substring(text, 1, 300) || ' 347 U.S. 483 and 12 F. Supp. 2d at 9, id. at 4 (1954) ____ ' || substring(text, 301)"


def _strip_sql(x):
    for part in X.CITATION_PARTS:
        x = f"regexp_replace({x}, '{part}', ' ', 'g')"
    return stripped(x)


@query(f"SELECT doc_id, {_strip_sql(_CITED)} AS text FROM documents")
def strip_citations(spark, d):
    cited = F.concat(F.substring("text", 1, 300), F.lit(" 347 U.S. 483 and 12 F. Supp. 2d at 9, id. at 4 (1954) ____ "), F.expr("substring(text, 301)"))
    return t(spark, d, "documents").select("doc_id", X.strip_citations(cited).alias("text"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS volume, 'f. supp. 3d' AS reporter, CAST(p_partkey AS VARCHAR) AS page FROM part")
def parse_citation(spark, d):
    cite = F.concat(F.col("p_size"), F.lit("  F.  Supp. 3d "), F.col("p_partkey"), F.lit(", 12"))
    p = X.parse_citation(cite)
    return t(spark, d, "part").select("p_partkey", p["volume"].alias("volume"), X.normalize_reporter(p["reporter"]).alias("reporter"), p["page"].alias("page"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'FAITHFUL' WHEN conv_id % 3 = 1 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS verdict FROM conversations""")
def parse_verdict(spark, d):
    k = F.col("conv_id") % 3
    raw = F.when(k == 0, "not faithful, or partial").when(k == 1, "Label: Partial. Hallucinated?").otherwise("unfaithful")
    return t(spark, d, "conversations").select("conv_id", "turn", X.parse_verdict(raw).alias("verdict"))


@query("SELECT doc_id, '[MASK]' || substring(text, 9, 12) || '[MASK]' || substring(text, 31) AS text FROM documents WHERE length(text) > 40")
def mask_spans(spark, d):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((20, 26), (0, 5), (3, 8), (25, 30))))
    return t(spark, d, "documents").where(F.length("text") > 40).select("doc_id", X.mask_spans(F.col("text"), spans).alias("text"))


_CHUNKS = f"""w AS (SELECT doc_id, regexp_extract_all(text, '{W}') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 16) / 112.0), 1)::BIGINT)) AS chunk_index FROM w WHERE len(w) > 0),
chunks AS (SELECT doc_id, chunk_index, array_to_string(w[chunk_index * 112 + 1 : chunk_index * 112 + 128], ' ') AS text FROM c)"""


def _chunks(spark, d) -> DataFrame:
    return chunk_rows(t(spark, d, "documents"))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text): windows of 128 words that share 16."""
    # the words are a column of their own: within a lambda they would be cut anew for each chunk
    words = docs.select("doc_id", X.words(F.col("text")).alias("words"))
    # outer, or the optimizer computes the windows twice, once to see whether there are any
    return words.select("doc_id", F.posexplode_outer(X.chunks(F.col("words"), 128, 16)).alias("chunk_index", "w")).where("chunk_index is not null").select("doc_id", "chunk_index", F.array_join("w", " ").alias("text"))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, text FROM chunks")
def chunk_text(spark, d):
    return _chunks(spark, d)


@query(f"WITH {_CHUNKS} SELECT doc_id, text FROM chunks WHERE chunk_index = 0")
def one_chunk_per_doc(spark, d):
    return ordering.dedupe_first(_chunks(spark, d).where("chunk_index = 0"), ["doc_id"], ["text"]).drop("chunk_index")


@query(f"WITH {_CHUNKS}, k AS (SELECT doc_id % 100 AS cluster_id, doc_id, chunk_index, text, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id, chunk_index) AS i FROM chunks) SELECT cluster_id, array_to_string(list(text ORDER BY chunk_index, doc_id), ' ') AS text FROM k WHERE i <= 4 GROUP BY 1")
def cluster_text_index(spark, d):
    first = ordering.top_k(_chunks(spark, d).withColumn("cluster_id", F.col("doc_id") % 100), ["cluster_id"], ["doc_id", "chunk_index"], 4)
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "doc_id", "text")))
    return first.groupBy("cluster_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


@query(f"SELECT doc_id, greatest(ceil(({n_words('text')} - 128) / 896.0), 1)::BIGINT AS n_chunks FROM documents")
def chunk_count(spark, d):
    return t(spark, d, "documents").select("doc_id", X.chunk_count(X.word_count(F.col("text"))).alias("n_chunks"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{W}') AS w FROM documents), p AS (SELECT doc_id, w, least(8, len(w)) AS k, unnest(range(0, least(8, len(w)))) AS place FROM w WHERE len(w) > 0)
SELECT doc_id, place, array_to_string(CASE WHEN place = k - 1 THEN w[place * (len(w) // k) + 1 :] ELSE w[place * (len(w) // k) + 1 : (place + 1) * (len(w) // k)] END, ' ') AS passage FROM p""")
def passages(spark, d):
    words = t(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("words"))
    return words.select("doc_id", F.posexplode_outer(X.passages(F.col("words"))).alias("place", "passage")).where("place is not null")


_LEAK = r"(?i)\bLicensed under\b"


@query(f"""WITH s AS (SELECT regexp_matches(text, '{_LEAK}') AS leak, {n_words('text')} AS n FROM documents), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM s)
SELECT (SELECT round(avg(CASE WHEN leak THEN 1.0 ELSE 0.0 END), 6) FROM s) AS leak_share, max(n) FILTER (i = c // 10) AS p10, max(n) FILTER (i = c // 2) AS p50, max(n) FILTER (i = c * 9 // 10) AS p90,
CASE WHEN (SELECT avg(CASE WHEN leak THEN 1.0 ELSE 0.0 END) FROM s) > 0.05 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM o""")
def leakage_rates(spark, d):
    docs = t(spark, d, "documents").select(F.regexp_like("text", F.lit(_LEAK)).alias("leak"), X.word_count(F.col("text")).alias("n"))
    rate = docs.agg(quality.share(F.col("leak")).alias("r"))
    return ordering.at_index(docs, "n", [("p10", 1, 10), ("p50", 1, 2), ("p90", 9, 10)]).crossJoin(rate).select(F.round("r", 6).alias("leak_share"), "p10", "p50", "p90", F.when(F.col("r") > 0.05, "FAIL").otherwise("PASS").alias("verdict"))


@query("SELECT count(*) AS n, count(*) FILTER (l.doc_id IS NOT NULL) AS covered, round(avg(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_check(spark, d):
    known = t(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return t(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if("known").alias("covered"), F.round(quality.share(F.col("known")), 6).alias("share"))


@query(f"SELECT count(*) FILTER ({n_words('text')} * 1.3 > 512) AS truncated, round(avg(CASE WHEN {n_words('text')} * 1.3 > 512 THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents")
def truncation_estimate(spark, d):
    over = X.word_count(F.col("text")) * 1.3 > 512
    return t(spark, d, "documents").agg(F.count_if(over).alias("truncated"), F.round(quality.share(over), 6).alias("share"))


# --- signals, gates, contracts ---

_NOTICE = ("licensed under", "all rights reserved", "released under the mit")


@F.pandas_udf(BooleanType())
def _is_nfc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda x: x is None or unicodedata.is_normalized("NFC", x)).astype(bool)


def _signals(docs: DataFrame) -> DataFrame:
    n = X.word_count(F.col("text"))
    return docs.select("doc_id", F.array_compact(F.array(
        F.when(n < 20, "truncated_document"), F.when(n > 5000, "gigantic_document"), F.when(F.regexp_like("text", F.lit("<[a-zA-Z/][^>]*>")), "html_remnants"),
        F.when(~_is_nfc("text"), "unicode_not_nfc"), F.when(F.regexp_like(F.lower("text"), F.lit("|".join(_NOTICE))), "boilerplate"), F.when((n > 100) & (X.citation_count(F.col("text")) == 0), "no_citations"),
    )).alias("signals"))


_SIGNALS = f"""SELECT doc_id, list_filter([CASE WHEN n < 20 THEN 'truncated_document' END, CASE WHEN n > 5000 THEN 'gigantic_document' END, CASE WHEN regexp_matches(text, '<[a-zA-Z/][^>]*>') THEN 'html_remnants' END, CASE WHEN nfc_normalize(text) <> text THEN 'unicode_not_nfc' END,
CASE WHEN regexp_matches(lower(text), '{'|'.join(_NOTICE)}') THEN 'boilerplate' END, CASE WHEN n > 100 AND {_CITES} = 0 THEN 'no_citations' END], lambda x: x IS NOT NULL) AS signals FROM (SELECT *, {n_words('text')} AS n FROM documents)"""


@query(f"SELECT doc_id, array_to_string(signals, ',') AS signals FROM ({_SIGNALS})")
def quality_signals(spark, d):
    return _signals(t(spark, d, "documents")).select("doc_id", F.array_join("signals", ",").alias("signals"))


@query(f"WITH s AS ({_SIGNALS}) SELECT signal, count(*) AS n FROM (SELECT unnest(CASE WHEN len(signals) = 0 THEN ['clean'] ELSE signals END) AS signal FROM s) GROUP BY 1")
def quality_summary(spark, d):
    s = _signals(t(spark, d, "documents"))
    return s.select(F.explode(F.when(F.size("signals") == 0, F.array(F.lit("clean"))).otherwise(F.col("signals"))).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def _one(name: str, severity: str, value: str, ok: str, source: str = "documents") -> str:
    return f"SELECT '{name}' AS gate, '{severity}' AS severity, round(({value})::DOUBLE, 6) AS value, coalesce(({ok.replace('value', f'round(({value})::DOUBLE, 6)')}), false) AS passed FROM {source}"


def _share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


_SENT = "len(regexp_extract_all(text, '[.!?]+'))"
_SCHEMA_BAD = "doc_id IS NULL OR text IS NULL OR n_chars < 0 OR lang NOT IN ('en', 'fr', 'de', 'es') OR n_chars <> length(text)"
GATES = {
    "gate_schema": ("blocking", f"sum(CASE WHEN {_SCHEMA_BAD} THEN 1 ELSE 0 END)", "value = 0"),
    "gate_text_source": ("blocking", _share("source LIKE 'src%'"), "value >= 0.8"),
    "gate_length": ("blocking", _share("n_chars < 1500"), "value < 0.25"),
    "gate_citations": ("advisory", _share(f"{_CITES} = 0"), "value < 0.2"),
    "gate_chunks": ("blocking", f"median(greatest(ceil(({n_words('text')} - 128) / 896.0), 1))", "value >= 2"),
    "gate_anchor": ("blocking", _share(f"regexp_matches(text, '{X.CITATION}')"), "value >= 0.6"),
    "gate_sentences": ("advisory", _share(f"{_SENT} < 20"), "value < 0.15"),
}


def _gate_columns():
    text, n = F.col("text"), F.col("n_chars")
    bad = F.col("doc_id").isNull() | text.isNull() | (n < 0) | ~F.col("lang").isin("en", "fr", "de", "es") | (n != F.length(text))
    return {
        "gate_schema": (F.sum(F.when(bad, 1).otherwise(0)), lambda v: v == 0),
        "gate_text_source": (quality.share(F.col("source").startswith("src")), lambda v: v >= 0.8),
        "gate_length": (quality.share(n < 1500), lambda v: v < 0.25),
        "gate_citations": (quality.share(X.citation_count(text) == 0), lambda v: v < 0.2),
        "gate_chunks": (F.percentile(X.chunk_count(X.word_count(text)), 0.5), lambda v: v >= 2),
        "gate_anchor": (quality.share(F.regexp_like(text, F.lit(X.CITATION))), lambda v: v >= 0.6),
        "gate_sentences": (quality.share(F.regexp_count(text, F.lit("[.!?]+")) < 20), lambda v: v < 0.15),
    }


def _gate(name: str):
    severity, value, ok = GATES[name]

    def run(spark, d):
        column, passes = _gate_columns()[name]
        return quality.gate(t(spark, d, "documents"), name, severity, column, passes)

    run.__name__ = name
    query(_one(name, severity, value, ok))(run)


for _name in GATES:
    _gate(_name)


def _all_gates(spark, d) -> DataFrame:
    """All gates from one scan, then a row for each."""
    columns = _gate_columns()
    one = t(spark, d, "documents").agg(*(F.round(c.cast("double"), 6).alias(name) for name, (c, _) in columns.items()))
    rows = [F.struct(F.lit(name).alias("gate"), F.lit(GATES[name][0]).alias("severity"), F.col(name).alias("value"), F.coalesce(passes(F.col(name)), F.lit(False)).alias("passed")) for name, (_, passes) in columns.items()]
    return one.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


_ALL = " UNION ALL ".join(_one(name, *GATES[name]) for name in GATES)


@query(f"SELECT CASE WHEN passed THEN 'passed' WHEN severity = 'blocking' THEN 'failed_blocking' ELSE 'failed_advisory' END AS outcome, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def gate_summary(spark, d):
    return quality.summary(_all_gates(spark, d))


@query(f"""WITH e AS (SELECT doc_id, {_CHARS} AS chars, n_chars FROM documents) SELECT round(min(chars), 5) AS least, round(avg(chars), 5) AS mean, round(max(chars), 5) AS most, count(*) FILTER (chars < 3) AS low, true AS passed FROM e""")
def gate_entropy(spark, d):
    e = t(spark, d, "documents").select(X.char_entropy(F.col("text")).alias("e"))
    return e.agg(F.round(F.min("e"), 5).alias("least"), F.round(F.avg("e"), 5).alias("mean"), F.round(F.max("e"), 5).alias("most"), F.count_if(F.col("e") < 3).alias("low"), F.lit(True).alias("passed"))


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT 'row_floor' AS contract, (SELECT count(*) FROM documents) >= 100 AS passed UNION ALL SELECT 'top_share', (SELECT max(n) / sum(n) FROM s) <= 0.5 UNION ALL SELECT 'length', (SELECT avg(n_chars) FROM documents) >= 1000 AND (SELECT max(v) FILTER (i = n // 20) FROM p) >= 100""")
def data_contracts(spark, d):
    docs = t(spark, d, "documents").select("lang", "n_chars")
    by_lang = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c")).agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("top"), (F.sum("c") / F.sum("n")).alias("mean"))
    facts = by_lang.crossJoin(ordering.at_index(docs, "n_chars", [("p5", 1, 20)]))
    rows = (("row_floor", F.col("n") >= 100), ("top_share", F.col("top") <= 0.5), ("length", (F.col("mean") >= 1000) & (F.col("p5") >= 100)))
    return facts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("contract"), c.alias("passed")) for k, c in rows))).alias("r")).select("r.*")


CONTRACTS = {
    "ids_present": "doc_id IS NULL", "text_present": "text IS NULL", "ids_positive": "doc_id < 0", "length_positive": "n_chars <= 0", "length_matches": "n_chars <> length(text)", "lang_present": "lang IS NULL", "lang_known": "lang NOT IN ('en', 'fr', 'de', 'es')",
    "source_present": "source IS NULL", "source_named": "source NOT LIKE 'src%'", "no_nul": "contains(text, chr(0))", "not_blank": "trim(text) = ''", "not_gigantic": "n_chars > 10000000",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS contract, count(*) FILTER ({v}) AS n_bad, count(*) FILTER ({v}) = 0 AS passed FROM documents" for k, v in CONTRACTS.items()) + " UNION ALL SELECT 'ids_unique', count(*) - count(DISTINCT doc_id), count(*) = count(DISTINCT doc_id) FROM documents")
def contracts(spark, d):
    docs = t(spark, d, "documents")
    one = docs.agg(*(F.count_if(F.expr(v)).alias(k) for k, v in CONTRACTS.items()))
    extra = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("ids_unique"))
    rows = [F.struct(F.lit(k).alias("contract"), F.col(k).alias("n_bad"), (F.col(k) == 0).alias("passed")) for k in [*CONTRACTS, "ids_unique"]]
    return one.crossJoin(extra).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_ODD_TS = """CASE event_id % 8 WHEN 0 THEN 'on ' || strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-') || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') WHEN 2 THEN strftime(ts, '%Y-%m-%d') || 'T' || lpad(CAST(event_id % 30 AS VARCHAR), 2, '0') || ':15:00Z'
WHEN 3 THEN '2023-02-' || (20 + event_id % 12) || 'T01:02:03-0530' WHEN 4 THEN strftime(ts, '%Y-%m-%d') || 'T01:02:03' WHEN 5 THEN '2024-' || lpad(CAST(event_id % 15 AS VARCHAR), 2, '0') || '-05T00:00:00+00:00' WHEN 6 THEN strftime(ts, '%Y-%m-%d') || 'T01:02:03.25Z' ELSE props END"""


@query(rf"""WITH r AS (SELECT event_id, regexp_extract({_ODD_TS}, '[0-9]{{4}}(-[0-9]{{2}}){{2}}(T[0-9]{{2}}(:[0-9]{{2}}){{2}}(\.[0-9]+Z?|[-+][0-9]{{2}}:?[0-9]{{2}}|Z)?)?') AS raw FROM events),
p AS (SELECT *, substring(raw, 1, 10) AS day, substring(raw, 12, 8) AS clock, substring(raw, 20) AS rest FROM r),
v AS (SELECT *, try_strptime(day || ' ' || CASE WHEN clock = '' THEN '00:00:00' ELSE clock END, '%Y-%m-%d %H:%M:%S') IS NOT NULL AS real FROM p)
SELECT event_id, CASE WHEN NOT real OR raw = '' OR rest LIKE '.%' THEN '' WHEN clock = '' THEN day ELSE day || 'T' || clock || CASE WHEN rest IN ('Z', '+00:00', '-00:00', '+0000', '-0000') THEN 'Z' WHEN length(rest) = 5 THEN left(rest, 3) || ':' || right(rest, 2) ELSE rest END END AS stamp FROM v""")
def normalize_timestamp_odd(spark, d):
    """Times whose days and hours may not exist; what each becomes is worked out by the other engine."""
    i, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    raw = (
        F.when(i % 8 == 0, F.concat(F.lit("on "), day)).when(i % 8 == 1, F.concat(F.date_format("ts", "yyyy-MM-"), two(i % 40))).when(i % 8 == 2, F.concat(day, F.lit("T"), two(i % 30), F.lit(":15:00Z")))
        .when(i % 8 == 3, F.concat(F.lit("2023-02-"), 20 + i % 12, F.lit("T01:02:03-0530"))).when(i % 8 == 4, F.concat(day, F.lit("T01:02:03"))).when(i % 8 == 5, F.concat(F.lit("2024-"), two(i % 15), F.lit("-05T00:00:00+00:00")))
        .when(i % 8 == 6, F.concat(day, F.lit("T01:02:03.25Z"))).otherwise(F.col("props"))
    )
    return t(spark, d, "events").select("event_id", X.normalize_timestamp(raw).alias("stamp"))


_SAID = "CASE WHEN conv_id % 5 = 0 THEN text || ' so: Partial, not faithful.' WHEN conv_id % 5 = 1 THEN 'unfaithful ' || text WHEN conv_id % 5 = 2 THEN upper(text) || ' HALLUCINATED' WHEN conv_id % 5 = 3 THEN 'faithful-ish? ' || text ELSE text END"


@query(rf"SELECT conv_id, turn, CASE WHEN regexp_matches({_SAID}, '(?i)\b(FAITHFUL|PARTIAL|HALLUCINATED)\b') THEN upper(regexp_extract({_SAID}, '(?i)\b(FAITHFUL|PARTIAL|HALLUCINATED)\b', 1)) ELSE 'UNKNOWN' END AS verdict FROM conversations")
def parse_verdict_in_text(spark, d):
    k, text = F.col("conv_id") % 5, F.col("text")
    said = F.when(k == 0, F.concat(text, F.lit(" so: Partial, not faithful."))).when(k == 1, F.concat(F.lit("unfaithful "), text)).when(k == 2, F.concat(F.upper(text), F.lit(" HALLUCINATED"))).when(k == 3, F.concat(F.lit("faithful-ish? "), text)).otherwise(text)
    return t(spark, d, "conversations").select("conv_id", "turn", X.parse_verdict(said).alias("verdict"))


@query(f"WITH s AS ({_SIGNALS} WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 150)) SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM s) GROUP BY 1")
def signals_first_n(spark, d):
    first = t(spark, d, "documents").select("doc_id", "text").orderBy("doc_id").limit(150)
    return _signals(first).select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))
