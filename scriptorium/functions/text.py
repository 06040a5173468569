"""Scalar functions on text, as column expressions. Only the character entropy leaves the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: White space and words by explicit ASCII classes, on which Java, RE2 and DuckDB agree.
SPACE = r"[ \t\n\r\f]"
WORD = r"[^ \t\n\r\f]+"
TERM = "[a-zà-öø-ÿ]+"
TAG = "<[^>]+>"
CHARS_PER_TOKEN = 4
#: Reporter abbreviations: letters, then an optional series.
_SERIES = r"(?: ?[234](?:d|th))?"
REPORTER = r"(?:(?:U\. ?S|S\. ?Ct|L\. ?Ed|F|F\. ?Supp|P|A|[NS]\. ?[EW]|B\.R|Fed\. ?Cl|U\.S\.C)\." + _SERIES + "|WL|Stat|CFR)"
CITATION = r"[0-9]+[ \t\n]+(?:U\.S\.|S\.Ct\.|L\.Ed\.|F\.[0-9][a-z]*|F\.Supp\.[0-9]*)"
LABELS = ("FAITHFUL", "PARTIAL", "HALLUCINATED")
_PAGES = "[0-9]+(?:[-,][0-9]+)?"
#: In the order they are taken out.
CITATION_PARTS = (
    rf"\b[0-9]+ +{REPORTER} +at +{_PAGES}",
    rf"\b[0-9]+ +{REPORTER} +{_PAGES}",
    rf"(?i)\b(?:Id\.|supra)(?: *, *(?:at +)?{_PAGES})?",
    r"\( *(?:20[0-9][0-9]|1[7-9][0-9][0-9]) *\)",
    "____+",
    f"{SPACE}+",
)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-case runs of Latin letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def clean_encoding(text: Column) -> Column:
    """Drops NUL and C1 controls; straight quotes and plain dashes."""
    dropped = F.translate(text, "“”‘’–" + "\0" + "".join(map(chr, range(0x80, 0xA0))), "\"\"''-")
    return F.replace(dropped, F.lit("—"), F.lit("--"))


def strip_html(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, TAG, " "), r"[ \t]+", " "))


def remove_boilerplate(text: Column) -> Column:
    """Drops header lines of unreported opinions, and page numbers marked by a star."""
    headless = F.regexp_replace(text, r"(?m)^(?:Only the Westlaw citation|Not Reported in )[^\n]*\n", "")
    return strip(F.regexp_replace(headless, r"\n?\*[0-9]+\n?", " "))


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\n\n+", "\n\n")


def citation_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(CITATION)), F.lit(0)).cast("bigint")


def paragraph_count(text: Column) -> Column:
    """Parts between empty lines that aren't blank; 1 at least."""
    parts = F.filter(F.split(text, "\n\n"), lambda x: F.length(strip(x)) > 0)
    return F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(1)).cast("bigint")


def estimated_tokens(length: Column) -> Column:
    return F.floor(length / CHARS_PER_TOKEN).cast("bigint")


def density(count: Column, length: Column) -> Column:
    """Citations in a thousand estimated tokens."""
    tokens = estimated_tokens(length)
    return F.when(tokens > 0, count / tokens * 1000).otherwise(0.0)


def _bits(text: str | None) -> float:
    if not text:
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(codes) if codes.max() < 0x3000 else np.unique(codes, return_counts=True)[1]
    p = counts[counts > 0] / len(codes)
    return abs(float((p * np.log2(p)).sum()))


def _entropies(texts: pa.Array) -> pa.Array:
    return pa.array((_bits(x.as_py()) for x in texts), pa.float64())


@F.arrow_udf(DoubleType())
def _char_entropy(texts: pa.Array) -> pa.Array:
    return _entropies(texts)


def char_entropy(text: Column) -> Column:
    """Bits a character. In numpy counts, of one text of an Arrow batch at a time: the JVM has no counts within a row that are linear, and a count by groups would shuffle some sixty rows for each text."""
    return _char_entropy(text)


def word_entropy(text: Column) -> Column:
    """Bits a word. The sorted words are run through once, so that long texts stay linear but for the sort."""
    sorted_words = F.array_sort(words(text))
    n = F.size(sorted_words)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def spent(s: Column) -> Column:
        return s["sum"] + F.when(s["run"] > 1, s["run"] * F.log2(s["run"])).otherwise(0.0)

    def step(s: Column, w: Column) -> Column:
        same = s["last"] == w
        return F.struct(w.alias("last"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), F.when(same, s["sum"]).otherwise(spent(s)).alias("sum"))

    return F.when(n > 0, F.log2(n) - F.aggregate(sorted_words, start, step, spent) / n).otherwise(0.0)


def year(date: Column) -> Column:
    found = F.regexp_extract(date, "^([0-9]{4})", 1)
    return F.when(found == "", "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


def normalize_timestamp(text: Column) -> Column:
    """The first date or time in a text, in one form: UTC times end in Z, other offsets stay, fractions of a second aren't understood, and what isn't a date gives ""."""
    day = "[0-9]{4}(?:-[0-9]{2}){2}"
    raw = F.regexp_extract(text, rf"{day}(?:T[0-9]{{2}}(?::[0-9]{{2}}){{2}}(?:\.[0-9]+Z?|[-+][0-9]{{2}}:?[0-9]{{2}}|Z)?)?", 0)
    date, time = F.substring(raw, 1, 10), F.substring(raw, 12, 8)
    rest = F.substring(raw, 20, 40)
    offset = F.regexp_replace(rest, "^([-+][0-9]{2}):?([0-9]{2})$", "$1:$2")
    real = F.try_to_timestamp(F.concat(date, F.lit(" "), F.when(time == "", "00:00:00").otherwise(time)), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return (
        F.when(~real | (raw == "") | rest.startswith("."), "")
        .when(F.length(raw) == 10, date)
        .otherwise(F.concat(date, F.lit("T"), time, F.when(rest.isin("Z", "+00:00", "-00:00", "+0000", "-0000"), "Z").otherwise(offset)))
    )


def strip_citations(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for part in CITATION_PARTS:
        out = F.regexp_replace(out, part, " ")
    return strip(out)


def normalize_reporter(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, f"{SPACE}+", " ")))


def parse_citation(text: Column) -> Column:
    """Struct of volume, reporter, page; nulls if it isn't one."""
    form = rf"^{SPACE}*([0-9]+)[ \t]+([A-Za-z][A-Za-z0-9. ]*?)[ \t]+([0-9]+)\b"
    return F.struct(*(F.nullif(F.regexp_extract(text, form, i), F.lit("")).alias(n) for i, n in ((1, "volume"), (2, "reporter"), (3, "page"))))


def parse_verdict(text: Column) -> Column:
    """The first of the labels that stands as a word, whatever its case; else UNKNOWN."""
    found = F.upper(F.regexp_extract(text, rf"(?i)\b(?:{'|'.join(LABELS)})\b", 0))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("UNKNOWN"))


def chunk_count(n_tokens: Column, size: int = 1024, overlap: int = 128) -> Column:
    return F.greatest(F.ceil((n_tokens - overlap) / (size - overlap)), F.lit(1)).cast("bigint")


def chunks(tokens: Column, size: int = 1024, overlap: int = 128) -> Column:
    """Windows of ``size`` tokens that share ``overlap``; the last one ends where the tokens end. None for no tokens. ``tokens`` is best a stored column: an expression would be computed for each window."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), (chunk_count(n, size, overlap).cast("int") - 1) * (size - overlap), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(size)))).otherwise(F.slice(F.array(tokens), 1, 0))


def passages(tokens: Column, most: int = 8) -> Column:
    """At most ``most`` slices of equal length; the last takes the rest. ``tokens`` is best a stored column."""
    n = F.size(tokens)
    parts = F.least(F.lit(most), n)
    width = F.floor(n / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.array_join(F.slice(tokens, i * width + 1, F.when(i == parts - 1, n - i * width).otherwise(width)), " "))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def merge_spans(spans: Column, gap: int = 0) -> Column:
    """Sorted (start, stop) structs, with those that overlap or are ``gap`` apart joined."""
    kind = "array<struct<start:int,stop:int>>"

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (x["start"] <= last["stop"] + gap), joined).otherwise(F.concat(done, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), step)


def spans_of(text: Column, pattern: str | Column) -> Column:
    """Where a pattern matches: (start, stop) structs, from 0, stop excluded. ``pattern`` has no groups of its own that capture."""
    form = F.concat(F.lit("("), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(")"))
    # the parts between marks are, in turn, outside of a match and inside
    parts = F.split(F.regexp_replace(text, form, F.lit("\x01$1\x01")), "\x01", -1)
    kind = "array<struct<start:int,stop:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(kind).alias("found"))

    def step(s: Column, x: Column) -> Column:
        stop = s["at"] + F.length(x)
        span = F.array(F.struct(s["at"].alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"], F.concat(s["found"], span)).otherwise(s["found"]).cast(kind).alias("found"))

    return F.aggregate(parts, start, step, lambda s: s["found"])


def names_pattern(names: Column) -> Column:
    """A pattern of an array of names, as whole words in any case; it matches nothing if there are none."""
    real = F.filter(names, lambda x: F.length(x) > 0)
    return F.when(F.size(real) > 0, F.concat(F.lit(r"(?i:\b(?:"), F.array_join(F.transform(real, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|"), F.lit(r")\b)"))).otherwise(F.lit("(?!)"))


def mask_citations(text: Column, names: Column, mask: str = "[MASK]", gap: int = 0) -> Column:
    """``text`` with citations and the parties' names masked; spans that overlap or are ``gap`` apart become one."""
    cited = rf"\b[0-9]+ +{REPORTER} +(?:at +)?{_PAGES}"
    return mask_spans(text, F.concat(spans_of(text, cited), spans_of(text, names_pattern(names))), mask, gap)


def mask_spans(text: Column, spans: Column, mask: str = "[MASK]", gap: int = 0) -> Column:
    """``text`` with each merged span (from 0, stop excluded) replaced by ``mask``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        merge_spans(spans, gap),
        start,
        lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)).alias("out"), x["stop"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )


def build_prompt(question: Column, contexts: Column) -> Column:
    """Numbered contexts before the question; another wording if there are none."""
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")
    return F.when(F.size(contexts) > 0, F.concat(F.lit("Sources:\n"), numbered, F.lit("\n\nText: "), question, F.lit("\nAnswer from the sources alone:"))).otherwise(F.concat(F.lit("Text: "), question, F.lit("\nAnswer:")))


def nonfinite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def select_best_text(columns: list[str], least: int = 50) -> Column:
    """Struct (text, source) of the first column whose stripped text has ``least`` characters; null if none has."""
    return F.coalesce(*(F.when(F.length(strip(F.col(c))) >= least, F.struct(F.col(c).alias("text"), F.lit(c).alias("source"))) for c in columns))


def normalize(df: DataFrame, text: str, source: str) -> DataFrame:
    """``df`` with ``text`` cleaned by all steps in order, and ``cleaning_flags``: which of them changed it. Tags are taken out unless the source is plain_text.

    The steps are columns of their own until the end, so that each is computed once.
    """
    d = df.withColumn("_one", clean_encoding(F.col(text)))
    d = d.withColumn("_two", F.when(F.col(source) == "plain_text", F.col("_one")).otherwise(strip_html(F.col("_one"))))
    d = d.withColumn("_three", remove_boilerplate(F.col("_two")))
    d = d.withColumn("_four", strip(collapse_newlines(F.col("_three"))))
    flags = F.array(
        F.when(F.col("_one") != F.col(text), "encoding_cleaned"),
        F.when(F.col(source) != "plain_text", "html_stripped"),
        F.when(F.col("_three") != F.col("_two"), "boilerplate_removed"),
        F.when(F.contains(F.col("_three"), F.lit("\n\n\n")), "newlines_collapsed"),
        F.when(F.col("_four") != strip(F.col(text)), "whitespace_trimmed"),
    )
    return d.withColumn("cleaning_flags", F.array_compact(flags)).withColumn(text, F.col("_four")).drop("_one", "_two", "_three", "_four")
