"""Readers of bulk files. Schemas are always given, never inferred; rows that can't be read are told apart, not lost in silence."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.jsonlines import findings, strict_json

CORRUPT = "_corrupt_record"


_CSV = {"escape": "\\", "quote": '"', "maxCharsPerColumn": -1}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of a file."""
    return [x for x in (spark.read.csv(path, header=False, **_CSV).first() or ())]


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, keep: Sequence[str] | None = None, multi_line: bool = True, ragged: str = "drop") -> DataFrame:
    """Bulk CSV, plain or bz2 or gz: backslash escapes, quoted line breaks, fields of any length, all columns as text, found by the names in the header.

    ``columns`` must be in the header, in any order; ``keep`` are those wanted. All files have the same header; one that differs is an error. Rows with too many
    fields are dropped, or cut off if ``ragged`` is "truncate"; short ones are filled with nulls. With ``multi_line`` a file is one task, as a quoted line break can't be
    told from its middle; without it, plain and bz2 files are split, and fields must not hold line breaks.
    """
    if ragged not in ("drop", "truncate"):
        raise ValueError("ragged: drop or truncate")
    names = csv_header(spark, path if isinstance(path, str) else path[0])
    columns = list(columns or names)
    if missing := [c for c in (*columns, *(keep or ())) if c not in names]:
        raise ValueError(f"not in the header: {missing}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False, **_CSV)
    if ragged == "drop":
        # a row of another number of fields is marked as corrupt, be it short or long; its separators are counted outside of quotes
        bare = F.regexp_replace(F.regexp_replace(CORRUPT, r"(?s)\\.", ""), '"[^"]*"', "")
        touched = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0  # always true: Spark won't read the corrupt records by themselves
        raw = raw.where(touched).where(F.col(CORRUPT).isNull() | (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) < len(names)))
    return raw.select(*(f"`{c}`" for c in (keep or columns)))


def csv_has_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> bool:
    """Smoke probe: whether the file's header has the columns and ten rows can be read; never raises."""
    try:
        read_csv(spark, path, wanted).limit(10).collect()
        return True
    except Exception:  # noqa: BLE001
        return False


def has_columns(df: DataFrame, wanted: Sequence[str]) -> bool:
    """Whether the columns are there and ten rows can be read; never raises."""
    try:
        df.limit(10).collect()
        return set(wanted) <= set(df.columns)
    except Exception:  # noqa: BLE001
        return False


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines, plain or compressed; blank lines and lines that aren't JSON are dropped."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def audit_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n_lines, n_blank, n_decoded, n_errors) of each file. Bare NaN and Infinity decode; a value with something behind it doesn't."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("value")).withColumn("ok", findings(F.col("value"))["decoded"])
    blank = F.length("value") == 0
    decoded = F.col("ok")
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & decoded).alias("n_decoded"), F.count_if(~blank & ~decoded).alias("n_errors"))


def file_errors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, failed) of each file: one bad line fails it as a whole, as a reader of whole files would have it."""
    return audit_jsonl(spark, path).select("file", (F.col("n_errors") > 0).alias("failed"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One positive decimal without sign or leading zero a line, plain or gz; anything else is an error that names the line. A list is read whole, as one row a file, so that its lines have numbers."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("at", "value")).withColumn("value", F.rtrim("value", F.lit("\r")))
    bad = ~F.col("value").rlike("^[1-9][0-9]{0,18}$") | F.col("value").try_cast("bigint").isNull()
    return lines.select(F.when(bad, F.raise_error(F.concat(F.lit("line "), (F.col("at") + 1).cast("string"), F.lit(" is not an id: "), F.col("value")))).otherwise(F.col("value").try_cast("bigint")).alias("id"))


def read_pairs(spark: SparkSession, path: str, source: str = "source_id", dest: str = "dest_id") -> DataFrame:
    """Pairs of ids in JSON lines; a line that isn't strict JSON, or whose ids aren't whole numbers (not 1.0, not true), is an error."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("v", strict_json(F.col("value")))
    lines = lines.withColumn("v", F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.col("value"))).cast("variant")).otherwise(F.col("v")))

    def whole(c: str) -> Column:
        at = F.try_variant_get("v", f"$.{c}", "variant")
        return F.when(F.coalesce(F.schema_of_variant(at), F.lit("")) != "BIGINT", F.raise_error(F.concat(F.lit(f"no whole number {c} in: "), F.col("value"))).cast("bigint")).otherwise(F.try_variant_get("v", f"$.{c}", "bigint")).alias(c)

    return lines.select(whole(source), whole(dest))


def read_map(spark: SparkSession, path: str, key: str = "id", value: str = "name") -> DataFrame:
    """A JSON object of texts as a table; an absent file is an empty one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{key} string, {value} string")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def latest_per_prefix(files: DataFrame, prefix: str, date: str, path: str) -> DataFrame:
    return files.groupBy(prefix).agg(F.max_by(path, date).alias(path))


def check_source(mode: str, revision: str | None = None, streaming: bool = False) -> None:
    """Guards for reproducible loads: a pinned hub revision, no streaming from artifacts."""
    if mode not in ("artifact", "hub"):
        raise ValueError("mode: artifact or hub")
    if mode == "hub" and not re.fullmatch("[0-9a-f]{40}", revision or ""):
        raise ValueError("a hub source needs a revision of 40 hexadecimal digits")
    if mode == "artifact" and streaming:
        raise ValueError("artifacts aren't streamed")


def pick_shards(paths: Sequence[str], mode: str = "all", head: int = 3, share: float = 0.2) -> list[str]:
    """All shards, the first ones, or an even sample of a share of them, ``head`` at least."""
    paths = sorted(paths)
    if mode == "all":
        return paths
    if mode == "head":
        return paths[:head]
    n = min(len(paths), max(head, int(len(paths) * share)))
    return [paths[i * len(paths) // n] for i in range(n)] if n else []
