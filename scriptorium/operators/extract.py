"""From raw rows to clean records: safe ids, text choice, normalisation, lookups and features in one plan, with a reason for each row that doesn't make it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X

from .joins import first_filled
from .quality import errors

MIN_TEXT = 50
PRECEDENTIAL = ("published", "precedential")
_NUMBERED = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh".split()
APPELLATE = ("court of appeals", *(f"{x} circuit" for x in (*_NUMBERED, "federal", "d.c.", "district of columbia")))


def safe_int(text: Column) -> Column:
    """A whole number of a text, white space around it and a sign allowed; null if it isn't one."""
    return F.when(F.regexp_like(text, F.lit(r"^\s*[-+]?[0-9]+(_[0-9]+)*\s*$")), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("bigint"))


def is_appellate(court: Column, keywords: Sequence[str] = APPELLATE) -> Column:
    """Whether a court's name holds one of the keywords, whatever its case; false for a null."""
    low = F.lower(court)
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(low, F.lit(k))
    return F.coalesce(found, F.lit(False))


def in_courts(court: Column, courts: Sequence[str]) -> Column:
    """Membership of a value as text; a missing one counts as an empty text."""
    return F.coalesce(court.cast("string"), F.lit("")).isin(*courts)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key, the one that is last in ``order``."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in others))


def features(text: Column, raw: Column | None = None) -> dict[str, Column]:
    """Columns that describe a clean text."""
    n, cites = F.length(text), X.citation_count(text)
    out = {
        "text_length": n, "token_count": X.estimated_tokens(n), "paragraph_count": X.paragraph_count(text), "citation_count": cites, "text_hash": F.sha2(text, 256),
        "citation_density": X.density(cites, n), "text_entropy": X.char_entropy(text),
    }
    return out if raw is None else {"raw_text": raw} | out


def tagged(opinions: DataFrame, clusters: DataFrame, text_columns: Sequence[str], least: int = MIN_TEXT, plain: Sequence[str] = ("plain_text",)) -> DataFrame:
    """``opinions`` (id, cluster_id and text columns, all text) with safe ids, ``raw_text``, ``text``, ``text_source``, ``cleaning_flags`` and ``reason``: why a row is left out, null if it isn't.

    Reasons in the order they are found: bad_cluster_id; outside (no such cluster, column id); empty (no text column of ``least`` characters); stub (fewer are left after
    cleaning); bad_opinion_id. Nothing is dropped here, so that both sides can be written from one plan.
    """
    known = clusters.select(F.col("id").alias("_known")).where("_known is not null").distinct()
    rows = opinions.withColumn("_cluster", safe_int(F.col("cluster_id"))).withColumn("_id", safe_int(F.col("id")))
    rows = rows.join(known, F.col("_cluster") == F.col("_known"), "left").withColumn("_best", X.select_best_text(list(text_columns), least))
    early = F.when(F.col("_cluster").isNull(), "bad_cluster_id").when(F.col("_known").isNull(), "outside").when(F.col("_best").isNull(), "empty")
    rows = rows.withColumn("_early", early).withColumn("raw_text", F.when(F.col("_early").isNull(), F.col("_best.text"))).withColumn("text", F.col("raw_text"))
    rows = rows.withColumn("text_source", F.col("_best.source")).withColumn("_kind", F.when(F.col("text_source").isin(*plain), "plain_text").otherwise(F.col("text_source")))
    rows = X.normalize(rows, "text", "_kind")
    reason = F.coalesce("_early", F.when(F.length("text") < least, "stub").when(F.col("_id").isNull(), "bad_opinion_id"))
    return rows.withColumn("reason", reason).withColumns({"id_text": F.col("id"), "cluster_text": F.col("cluster_id"), "id": F.col("_id"), "cluster_id": F.col("_cluster")}).drop("_cluster", "_id", "_known", "_best", "_early", "_kind")


def records(kept: DataFrame, clusters: DataFrame, dockets: DataFrame, courts: DataFrame) -> DataFrame:
    """Records of 23 fields from the kept rows of :func:`tagged`, with what clusters (id, docket_id, case_name, date_filed, precedential_status), dockets (id, court_id, case_name, date_filed) and courts (id, full_name) say; a cluster's value goes before its docket's. Repeated ids of a side table: the caller decides, by :func:`last_by_key`."""
    c = clusters.select(F.col("id").alias("cluster_id"), "docket_id", F.col("case_name").alias("_cn"), F.col("date_filed").alias("_cd"), "precedential_status")
    d = dockets.select(F.col("id").alias("docket_id"), "court_id", F.col("case_name").alias("_dn"), F.col("date_filed").alias("_dd"))
    k = courts.select(F.col("id").alias("court_id"), F.col("full_name").alias("court_name"))
    rows = kept.join(c, "cluster_id", "left").join(d, "docket_id", "left").join(k, "court_id", "left")
    status = F.coalesce("precedential_status", F.lit(""))
    optional = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in kept.columns else F.lit("")
    return rows.select(
        "id", "cluster_id", "docket_id", F.coalesce("court_id", F.lit("")).alias("court_id"), F.coalesce("court_name", F.lit("")).alias("court_name"),
        first_filled(F.col("_cn"), F.col("_dn")).alias("case_name"), first_filled(F.col("_cd"), F.col("_dd")).alias("date_filed"), status.alias("precedential_status"),
        optional("type").alias("opinion_type"), optional("extracted_by_ocr").alias("extracted_by_ocr"), "raw_text", "text", "text_source", "cleaning_flags", F.lit("bulk").alias("source"),
        *(x.alias(n) for n, x in features(F.col("text")).items()), F.lower(status).isin(*PRECEDENTIAL).alias("is_precedential"),
    )


def extract(opinions: DataFrame, clusters: DataFrame, dockets: DataFrame, courts: DataFrame, text_columns: Sequence[str], least: int = MIN_TEXT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, quarantine, counts): clean records; rows with ids that are no numbers, as they came, with the reason; and the number of rows by reason, "kept" among them."""
    rows = tagged(opinions, clusters, text_columns, least)
    quarantine = rows.where(F.col("reason").isin("bad_cluster_id", "bad_opinion_id")).select("reason", F.col("id_text").alias("id"), F.col("cluster_text").alias("cluster_id"), *[c for c in opinions.columns if c not in ("id", "cluster_id")])
    counts = rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
    return records(rows.where("reason is null").drop("reason"), clusters, dockets, courts), quarantine, counts


def row_errors(df: DataFrame, required: Sequence[str], text_fields: Sequence[str], least: int) -> Column:
    """Names of what is wrong with a row: a required field that is null, no text field, a text below ``least`` characters."""
    text = F.coalesce(*(F.col(c) for c in text_fields if c in df.columns), F.lit(None).cast("string"))
    checks = [(F.col(c).isNotNull() if c in df.columns else F.lit(False), f"missing {c}") for c in sorted(required)]
    return errors(*checks, (text.isNotNull(), "no text field"), (text.isNull() | (F.length(text) >= least), "too short"))


def normalize_rows(df: DataFrame, text_fields: Sequence[str], times: Sequence[str] = ("created_timestamp", "downloaded_timestamp"), url: str = "url") -> DataFrame:
    """Rows in one form: the first text field that isn't null as ``text``, stripped, in place of its own column, and its name in ``source_text_field``; times in one form; the address also as ``source_url``."""
    there = [c for c in text_fields if c in df.columns]
    out = df.withColumn("source_text_field", F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in there)))
    out = out.withColumn("_text", X.strip(F.coalesce(*(F.col(c) for c in there))))
    # a field that wasn't chosen stays as it is
    out = out.withColumns({c: F.when(F.col("source_text_field") != c, F.col(c)) for c in there if c != "text"}).withColumn("text", F.col("_text")).drop("_text")
    out = out.withColumns({c: X.normalize_timestamp(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in times if c in df.columns})
    return out.withColumn("source_url", F.col(url)) if url in df.columns else out


def valid_rows(df: DataFrame, required: Sequence[str], text_fields: Sequence[str], least: int, **how: Sequence[str] | str) -> DataFrame:
    """Rows without errors, normalised."""
    return normalize_rows(df.where(F.size(row_errors(df, required, text_fields, least)) == 0), text_fields, **how)


