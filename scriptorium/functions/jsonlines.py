"""JSON lines with numbers that aren't finite: bare NaN and Infinity, which strict parsers refuse, and texts that spell them.

Spark has no reader of arbitrary JSON that takes them, so that suspicious lines are walked in Python, in Arrow batches. Which
lines are suspicious is decided in the JVM: only those that it can't parse, or that spell such a number somewhere. The others cross to
Python as nulls.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

SENTINELS = frozenset(sign + word for word in ("NaN", "nan", "Infinity", "Inf") for sign in ("", "-")) - {"-NaN", "-nan"}
#: Fields in which a bad value can be repaired; in others it blocks.
ADVISORY = ("case_name", "raw_text", "cleaning_flags")
#: What the JVM parses and yet may be bad: a text of the letters of such a number alone, be they escaped, and a number too large for a double. Bare ones it doesn't parse.
_SUSPICIOUS = r'"(?:[-NaIifnty]|\\u00[0-9A-Fa-f]{2}){3,9}"|[0-9][eE]\+?[0-9]{3}|[0-9]{300}'
_END = "§§ end of value §§"
_FINDINGS = StructType(
    [StructField("decoded", BooleanType()), StructField("fields", ArrayType(StringType())), StructField("nonfinite", BooleanType()), StructField("sentinel", BooleanType()), StructField("repaired", StringType()), StructField("changed", BooleanType())]
)


def _bad(x) -> tuple[bool, bool]:
    """Whether a value holds a number that isn't finite, and whether it holds a text that spells one, at any depth."""
    number = text = False
    todo = [x]
    while todo:
        v = todo.pop()
        if isinstance(v, float):
            number |= not math.isfinite(v)
        elif isinstance(v, str):
            text |= v in SENTINELS
        elif isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return number, text


def _nulled(x):
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: _nulled(v) for k, v in x.items()}
    return [_nulled(v) for v in x] if isinstance(x, list) else x


def findings_of(line: str) -> tuple:
    """(decoded, top-level fields with a bad value, nonfinite, sentinel, repaired line, changed) of one line. Texts that spell a number stay: they are valid."""
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return False, [], False, False, line, False
    number, text = _bad(value)
    fields = sorted(k for k, v in value.items() if any(_bad(v))) if isinstance(value, dict) else []
    return True, fields, number, text, json.dumps(_nulled(value), allow_nan=False) if number else line, number


@F.pandas_udf(_FINDINGS)
def _walked(lines: pd.Series) -> pd.DataFrame:
    names = _FINDINGS.fieldNames()
    return pd.DataFrame([(None,) * len(names) if x is None else findings_of(x) for x in lines], columns=names)


def strict_json(line: Column) -> Column:
    """The variant of a line that is one JSON value and nothing else; null if it isn't. (Spark's parser stops behind the first value: so the line is put in an array with a mark behind it.)"""
    pair = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{_END}"]')))
    whole = (F.try_variant_get(pair, "$[1]", "string") == _END) & ~F.contains(line, F.lit(_END))
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def findings(line: Column) -> Column:
    """Struct (decoded, fields, nonfinite, sentinel, repaired, changed) about a line. A line that the JVM parses and that spells no such number is clean."""
    plain = strict_json(line).isNotNull() & ~F.regexp_like(line, F.lit(_SUSPICIOUS))
    clean = F.struct(F.lit(True).alias("decoded"), F.array().cast("array<string>").alias("fields"), F.lit(False).alias("nonfinite"), F.lit(False).alias("sentinel"), line.alias("repaired"), F.lit(False).alias("changed"))
    return F.coalesce(F.when(~plain, _walked(F.when(~plain, line))), clean)


def audit(lines: DataFrame, shard: str, line: str) -> DataFrame:
    """A row for each shard: (shard, total_lines, nan_lines, nonfinite_lines, sentinel_lines, decode_errors, fields). Blank lines don't count. A line that isn't JSON is a bad one; ``fields`` maps top-level fields to the number of lines that are bad in them."""
    real = lines.select(F.col(shard).alias("shard"), F.trim(F.col(line), F.lit(" \t\r\n")).alias("_line")).where(F.length("_line") > 0).select("shard", findings(F.col("_line")).alias("f"))
    # a row for the line, whose field is null, and one for each bad field: one pass, counted in each partition first
    every = real.select("shard", "f", F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), "f.fields")).alias("field"))
    hit = F.size("f.fields") > 0
    counts = every.groupBy("shard", "field").agg(
        F.count("*").alias("n"), F.count_if(~F.col("f.decoded") | hit).alias("nan"), F.count_if(hit & F.col("f.nonfinite")).alias("nonfinite"), F.count_if(hit & F.col("f.sentinel")).alias("sentinel"), F.count_if(~F.col("f.decoded")).alias("errors"),
    )
    of_lines = lambda c: F.max(F.when(F.col("field").isNull(), F.col(c)))
    entries = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "n"))))
    return counts.groupBy("shard").agg(of_lines("n").alias("total_lines"), of_lines("nan").alias("nan_lines"), of_lines("nonfinite").alias("nonfinite_lines"), of_lines("sentinel").alias("sentinel_lines"), of_lines("errors").alias("decode_errors"), F.map_from_entries(entries).alias("fields"))


def verdict(nan_lines: Column, decode_errors: Column, fields: Column, advisory: tuple[str, ...] = ADVISORY) -> Column:
    """CLEAN; PARSE_FAILURE if a line isn't JSON; REPAIRABLE if only advisory fields are bad; else HARD_FAILURE."""
    hard = F.exists(F.map_keys(fields), lambda k: ~k.isin(*advisory)) if advisory else F.size(fields) > 0
    return F.when(nan_lines == 0, "CLEAN").when((decode_errors > 0) | (F.size(fields) == 0), "PARSE_FAILURE").when(hard, "HARD_FAILURE").otherwise("REPAIRABLE")


def health(shards: DataFrame, advisory: tuple[str, ...] = ADVISORY) -> DataFrame:
    """One row about all shards of :func:`audit`: sums, merged fields, the sorted names of contaminated shards, and the verdict."""
    dirty = F.col("nan_lines") > 0
    sums = shards.agg(
        F.count("*").alias("total_shards"), F.count_if(dirty).alias("nan_shards"), F.array_sort(F.collect_list(F.when(dirty, F.col("shard")))).alias("contaminated"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total_lines", "nan_lines", "nonfinite_lines", "sentinel_lines", "decode_errors")),
    )
    merged = shards.select(F.explode("fields").alias("field", "n")).groupBy("field").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "n")))).alias("fields"))
    return sums.crossJoin(merged).withColumn("verdict", verdict(F.col("nan_lines"), F.col("decode_errors"), F.col("fields"), advisory))


def repair(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with bare non-finite numbers as nulls, and ``changed``. Lines that aren't JSON stay as they are, as do those that change nothing."""
    out = lines.withColumn("_f", findings(F.col(line)))
    return out.withColumns({line: F.coalesce("_f.repaired", line), "changed": F.coalesce("_f.changed", F.lit(False))}).drop("_f")


def fields_text(fields: Column) -> Column:
    """A map of counts as one text, "a:1,b:2"."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
