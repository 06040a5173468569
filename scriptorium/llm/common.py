"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, written out so that Java, RE2 and DuckDB agree on it.
WORD = r"[^ \t\n\r\f]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see, from ``spark.checkpoint.dir``. A folder of this machine is made only where that is unset and driver and executors are one process; on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not given and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="scriptorium-"))
    return given or sc.getCheckpointDir()


def table_dir(spark: SparkSession) -> str:
    """Folder for the tables that one application writes between its jobs; removed when the application ends."""
    folder = f"{shared_dir(spark)}/scriptorium-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes narrow rows as a table in the shared folder and reads it: lost executors cost no recomputation, and the
    planner sees the table's true size. (A checkpoint would carry on the estimate, which joins in a loop multiply without end.)"""
    spark = df.sparkSession
    path = f"{table_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Nodes of an optimized plan under which rows come in the same order each time, as far as the splits of the files are the same.
_STEADY = {"LogicalRelation", "Project", "Filter"}


def _steady(node) -> bool:
    if node.nodeName() not in _STEADY or node.nodeName() == "LogicalRelation" and node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    children = node.children()
    return all(_steady(children.apply(i)) for i in range(children.size()))


def repeatable(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a scan of files, projected and filtered, whose rows come in the same order each time it is read; else a written table of it.

    Row numbers are only good for joins between two readings of ``docs`` if both readings number alike. How Spark splits files
    depends on the cores that it has at the time, so that the number it goes by is fixed for the session.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().optimizedPlan()
    return docs if plan.deterministic() and _steady(plan) else cut(docs)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, F.monotonically_increasing_id())


#: Bits of a row number below those of its partition, and of a partition's number below those of its group.
ROW_BITS, GROUP_BITS = 33, 6


def arrow_path(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def without_rows(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose number ``row`` isn't in ``dropped`` (one column, no nulls), with the columns of ``docs``.

    A row's number says which partition it is in. So the dropped numbers, sorted, are written to the shared folder by groups of partitions, and each
    task of the scan reads those of its own partition: neither texts nor their sort keys are shuffled, and nothing is broadcast, however many rows go. Where pyarrow can't reach
    the folder, it is an anti-join.
    """
    spark = docs.sparkSession
    path = f"{table_dir(spark)}/{uuid.uuid4().hex}"
    numbers = dropped.select(F.col(dropped.columns[0]).alias("row"))
    try:
        arrow_path(path)
    except (pa.ArrowException, OSError):
        return numbered(docs, row).join(numbers.withColumnRenamed("row", row), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    grouped = numbers.withColumn("part", F.shiftright("row", ROW_BITS + GROUP_BITS))
    grouped.repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = TaskContext.get().partitionId()
        system, folder = arrow_path(f"{path}/part={mine >> GROUP_BITS}")
        gone = np.zeros(0, dtype=np.int64)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            first = mine << ROW_BITS
            rows = ds.dataset(folder, filesystem=system, format="parquet").to_table(columns=["row"], filter=(ds.field("row") >= first) & (ds.field("row") < first + (1 << ROW_BITS)))
            gone = np.sort(rows["row"].to_numpy())
        for batch in batches:
            number = batch.column(row).to_numpy(zero_copy_only=False)
            if len(gone):
                stays = gone[np.minimum(np.searchsorted(gone, number), len(gone) - 1)] != number
                batch = batch.filter(pa.array(stays))
            yield batch.select([c for c in batch.schema.names if c != row])

    return numbered(docs, row).mapInArrow(run, docs.schema)


def word_count(text: str | Column) -> Column:
    """White-space separated words; none for a null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(seed: str, doc_id: str) -> Column:
    """Pseudo-random order that SQL can repeat: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def first_labelled(labels: DataFrame, label: str, seed: str, n: int, values: Sequence[int] | None = None) -> DataFrame:
    """(chosen_id, label) of the first ``n`` documents of each of ``values``, or of all, in a hashed order. ``labels`` has an id once. A sort with a limit: no partition passes on more than n rows."""
    rows = [labels if values is None else labels.where(F.col(label) == v) for v in (values or [None])]
    chosen = [r.orderBy(order_key(seed, "doc_id"), "doc_id").limit(n).select(F.col("doc_id").alias("chosen_id"), label) for r in rows]
    return reduce(DataFrame.unionByName, chosen)


def labelled_texts(docs: DataFrame, chosen: DataFrame, label: str, id_col: str, text_col: str) -> tuple[list[str], list[int]]:
    """Texts and labels of chosen documents, in a fixed order, for a model that the driver fits: as many as :func:`first_labelled` was told. Of rows with one id, the least text counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = rows.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id")).groupBy("id", label).agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["id"], r["text"]))
    return [r["text"] for r in found], [r[label] for r in found]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a piece hold about ``limit`` bytes; a text is never cut, only alone if it is long."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def hash_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word, of all words of less than 32 bytes at once. And which words aren't empty."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "")[0].as_buffer(), dtype=np.uint8) if sizes.any() else np.zeros(0, np.uint8)
    fits = sizes < 32
    raw, held = raw if fits.all() else raw[np.repeat(fits, sizes)], sizes[fits]
    padded = np.zeros((len(words), 32), dtype=np.uint8)
    padded[np.repeat(np.flatnonzero(fits), held), np.arange(len(raw)) - np.repeat(np.cumsum(held) - held, held)] = raw
    at, h = np.arange(len(words)), p5 + sizes.astype(np.uint64)
    for i in range(3):
        h = np.where(sizes >= 8 * i + 8, _turned(h ^ _turned(padded.view("<u8")[:, i] * p2, 31) * p1, 27) * p1 + p4, h)
    done = sizes // 8 * 8 % 32
    four = sizes - done >= 4
    h = np.where(four, _turned(h ^ padded.view("<u4")[at, done // 4].astype(np.uint64) * p1, 23) * p2 + p3, h)
    done += 4 * four
    for _ in range(3):
        one = done < sizes
        h = np.where(one, _turned(h ^ padded[at, done % 32].astype(np.uint64) * p5, 11) * p1, h)
        done += one
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32):
        h[i] = xxhash.xxh64_intdigest(words[i].as_py())
    return h, sizes > 0
