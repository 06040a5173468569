"""Contracts of a written corpus: JSON-lines shards and the manifest beside them. Every line is read, not a sample."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.jsonlines import findings
from scriptorium.sources.sinks import verify_manifest

PROVENANCE = tuple("case_name court_id date_filed docket_id precedential_status text_source".split())
TEXTS = ("raw_text", "text", "cleaning_flags")
NAMES = (
    "shard_dir_exists", "manifest_exists", "shards_exist", "total_count", "valid_json", "text_present", "text_substantive", "provenance_fields", "raw_and_normalized_text", "text_source_tracked", "multiple_circuits", "schema_consistent", "checksums",
)


def corpus_contracts(spark: SparkSession, path: str, manifest: dict | None, sources: Sequence[str], min_total: int = 1, min_text: int = 50, min_courts: int = 5) -> DataFrame:
    """(contract, passed, n_bad) of each of 13 contracts; ``n_bad`` counts lines, shards or values that break it.

    Stubs may be a tenth of each shard. A check that has nothing to look at because shards are missing fails only where that is its subject. Checksums
    that the manifest doesn't have are not checked.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = system.exists(at)
    shards = len(system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")) or []) if there else 0
    fixed = [("shard_dir_exists", there, 0 if there else 1), ("manifest_exists", manifest is not None, 0 if manifest is not None else 1), ("shards_exist", shards > 0, 0 if shards else 1)]
    facts = spark.createDataFrame([(0,)], "_one int")
    if shards:
        line = F.col("value")
        keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
        lines = spark.read.text(f"{path}/part-*").select(F.input_file_name().alias("file"), "value").where(F.length(F.trim("value")) > 0)
        text, source, court = (F.get_json_object(line, f"$.{c}") for c in ("text", "text_source", "court_id"))
        lacks = lambda wanted: F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col("keys"))) > 0
        row = lines.select("file", findings(line)["decoded"].alias("ok"), keys.alias("keys"), F.length(F.coalesce(text, F.lit(""))).alias("n"), F.coalesce(source, F.lit("")).alias("src"), F.coalesce(court, F.lit("")).alias("court"))
        schema = F.array_join(F.array_sort("keys"), "\0")
        # a row for each shard and court, counted in each partition first
        by = row.groupBy("file", "court").agg(
            F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad_json"), F.count_if(F.col("n") == 0).alias("no_text"), F.count_if(F.col("n") < min_text).alias("stubs"), F.count_if(lacks(PROVENANCE)).alias("no_provenance"), F.count_if(lacks(TEXTS)).alias("no_raw"),
            F.count_if(~F.col("src").isin(*sources)).alias("bad_source"), F.min(schema).alias("lo"), F.max(schema).alias("hi"),
        )
        sums = [F.sum(c).alias(c) for c in ("n", "bad_json", "no_text", "stubs", "no_provenance", "no_raw", "bad_source")]
        of_file = by.groupBy("file").agg(*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        facts = of_file.agg(*[F.sum(c).alias(c) for c in ("n", "bad_json", "no_text", "no_provenance", "no_raw", "bad_source")], F.count_if(F.col("stubs") > 0.1 * F.col("n")).alias("stubby"), (F.min("lo") != F.max("hi")).cast("long").alias("mixed"))
        facts = facts.crossJoin(by.agg(F.countDistinct("court").alias("courts")))
        bad = [
            ("total_count", F.greatest(F.lit(0), F.lit(min_total) - F.coalesce("n", F.lit(0)))), ("valid_json", F.col("bad_json")), ("text_present", F.col("no_text")), ("text_substantive", F.col("stubby")), ("provenance_fields", F.col("no_provenance")),
            ("raw_and_normalized_text", F.col("no_raw")), ("text_source_tracked", F.col("bad_source")), ("multiple_circuits", F.greatest(F.lit(0), F.lit(min_courts) - F.col("courts"))), ("schema_consistent", F.col("mixed")),
        ]
    else:
        bad = [(c, F.lit({"total_count": min_total, "multiple_circuits": min_courts}.get(c, 0))) for c in NAMES[3:12]]
    if shards and manifest is not None:
        facts = facts.crossJoin(verify_manifest(spark, path, manifest).where("state = 'changed'").agg(F.count("*").alias("changed")))
        bad.append(("checksums", F.col("changed")))
    else:
        bad.append(("checksums", F.lit(0)))
    rows = [F.struct(F.lit(c).alias("contract"), F.lit(ok).alias("passed"), F.lit(n).cast("bigint").alias("n_bad")) for c, ok, n in fixed]
    rows += [F.struct(F.lit(c).alias("contract"), (F.coalesce(n, F.lit(0)) == 0).alias("passed"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_bad")) for c, n in bad]
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def all_passed(results: DataFrame) -> bool:
    """Whether every contract holds; a row for each is all there is."""
    return reduce(lambda a, r: a and r.passed, results.collect(), True)
