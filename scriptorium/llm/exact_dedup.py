"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Equal blocks get the same integer name by being
sorted; then neighbouring names are paired and the pairs are named the same way, until one name is left for
each text. Two texts have the same last name exactly if they are equal: names come from sorted content, so that
no hash has to be trusted.

Blocks are spread over 2**20 buckets by a hash, and a name is (level, bucket, salt, rank of the block among the
sorted blocks of its bucket). One shuffle moves each text once; each further level moves half as many narrow rows. A
key with more than ``hot_rows`` rows is spread over ``SALTS`` parts, named in each, and then one of these names
stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, fresh, numbered, repeatable, without_rows

BLOCK_CHARS = 32_768
HOT_ROWS = 200_000
SALTS = 64
#: Bits of a name: 6 level, 20 bucket, 7 salt, 30 rank.
BUCKETS, SALT_BITS, RANK_BITS, LEVEL_SHIFT = 1 << 20, 7, 30, 57
#: More hot keys than this aren't broadcast but joined.
HOT_BROADCAST = 2_000_000


def _packed(level: int, bucket: str, salt: Column, rank: Column) -> Column:
    return F.lit(level << LEVEL_SHIFT).cast("bigint") + F.shiftleft(F.col(bucket).cast("bigint"), SALT_BITS + RANK_BITS) + F.shiftleft(salt.cast("bigint"), RANK_BITS) + rank.cast("bigint")


def name_keys(rows: DataFrame, keys: list[str], level: int, hot_rows: int = HOT_ROWS, most_rows: int | None = None) -> DataFrame:
    """Rows without ``keys`` but with ``name``, an integer that is the same for equal keys and differs for others. The result is cut from its lineage. Where there are ``most_rows`` at most, and they are few, no key can be hot."""
    keep = [c for c in rows.columns if c not in keys]
    rows = rows.withColumn("h", F.xxhash64(*keys))
    n_hot = 0
    if most_rows is None or most_rows > hot_rows:
        hot = cut(rows.groupBy("h").count().where(F.col("count") > hot_rows).select("h"))
        n_hot = hot.count()
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    if not n_hot:
        ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys)))
        return cut(ranked.select(*keep, _packed(level, "bucket", F.lit(0), F.col("rank")).alias("name")))
    hot = hot.withColumn("is_hot", F.lit(True))
    rows = rows.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "h", "left")
    rows = rows.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(*keep), F.lit(SALTS)) + 1).otherwise(0).cast("int"))
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket", "salt").orderBy(*keys)))
    first = F.row_number().over(Window.partitionBy("bucket", "salt", *keys).orderBy(*keys)) == 1
    ranked = cut(ranked.select(*keep, "bucket", "salt", "rank", F.when((F.col("salt") > 0) & first, F.struct(*keys)).alias("key")))
    # one name of each hot key, the least, stands for those of its other parts
    place = F.struct("salt", "rank")
    same = ranked.where("key is not null").groupBy("bucket", "key").agg(F.min(place).alias("one"), F.collect_set(place).alias("all"))
    same = cut(same.select("bucket", "one", F.explode("all").alias("at")).select("bucket", F.col("at.salt").alias("salt"), F.col("at.rank").alias("rank"), "one"))
    named = ranked.join(F.broadcast(same) if n_hot * SALTS <= HOT_BROADCAST else same, ["bucket", "salt", "rank"], "left")
    return cut(named.select(*keep, _packed(level, "bucket", F.coalesce("one.salt", "salt"), F.coalesce("one.rank", "rank")).alias("name")))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row, doc, name): the row number in ``docs``, its id and the collision-free name of its text. Rows with a null text have none and are left out."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    texts = numbered(texts, "row").where("text is not null")
    blocks = F.when(F.length("text") <= block_chars, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block_chars), F.lit(0)))
    rows = texts.select("row", "doc", blocks.alias("blocks")).select("row", "doc", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    level, done = 0, []
    named = name_keys(rows, ["block"], level, hot_rows)
    most, left = named.agg(F.max("n"), F.count_if(F.col("n") > 1)).first()
    most = most or 0
    while True:
        done.append(named.where("n = 1").select("row", "doc", "name"))
        if most <= 1:
            break
        level, most = level + 1, (most + 1) // 2
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        even = F.col("pos") % 2 == 0
        pairs = named.where("n > 1").groupBy("row", "doc", ((F.col("n") + 1) / 2).cast("int").alias("n"), half).agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"))
        named = name_keys(pairs, ["left", "right"], level, hot_rows, left)  # as many rows as the level before had, at most
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, block_chars: int, hot_rows: int) -> DataFrame:
    """(row, doc, canonical, is_kept) of rows with a text."""
    names = identities(docs, id_col, text_col, block_chars, hot_rows)
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row"))
    firsts = names.groupBy("name").agg(first.alias("first"))
    return names.join(firsts, "name").select("row", "doc", F.col("first.doc").alias("canonical"), (F.col("row") == F.col("first.row")).alias("is_kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each document (doc_id, canonical_id, is_kept): the least id among documents of exactly the same text, and whether it is the one that stays.

    Nulls: a null text is no text; such a row is its own canonical and stays. A null id counts as the greatest.
    Empty texts are equal to each other. Texts of any length are compared whole. Ties: among rows that share
    text and id (repeated rows), exactly one stays. An empty table gives an empty result. Other columns of
    ``docs`` are not read, whatever their names.
    """
    docs = repeatable(docs.select(id_col, text_col))
    judged = _judged(docs, id_col, text_col, block_chars, hot_rows).select(F.col("doc").alias("doc_id"), F.col("canonical").alias("canonical_id"), "is_kept")
    return judged.unionByName(docs.where(F.col(text_col).isNull()).select(F.col(id_col).alias("doc_id"), F.col(id_col).alias("canonical_id"), F.lit(True).alias("is_kept")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with one row of each text, and all rows without a text; same columns. Edge cases as in :func:`exact_duplicates`."""
    docs = repeatable(docs)
    return without_rows(docs, fresh(docs, "row"), _judged(docs, id_col, text_col, block_chars, hot_rows).where("not is_kept").select("row"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE_SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS canonical_id,
       text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY text) AS is_kept
FROM documents
"""
