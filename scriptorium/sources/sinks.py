"""Writers: numbered shards of bounded size, dead letters beside them, and a manifest that can be verified."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_SHARD = 10_000
MANIFEST = "_manifest.json"
PIECE = 1 << 20


def write_shards(df: DataFrame, path: str, kind: str = "parquet", rows: int = ROWS_PER_SHARD, compression: str | None = None) -> None:
    """Files of at most ``rows`` rows. Spark's committer makes them visible only when all are complete."""
    w = df.write.option("maxRecordsPerFile", rows)
    if compression:
        w = w.option("compression", compression)
    {"parquet": w.parquet, "json": w.json, "csv": lambda p: w.option("header", True).csv(p)}[kind](path)


def write_split(good: DataFrame, dead: DataFrame, path: str) -> None:
    write_shards(good, f"{path}/good")
    write_shards(dead, f"{path}/dead", "json")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the data files under ``path``, each read in pieces by a task of its own, however large it is."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                h = hashlib.sha256()
                with system.open_input_stream(at, compression=None) as f:
                    while piece := f.read(PIECE):
                        h.update(piece)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(sums, pa.string())], ["path", "bytes", "sha256"])

    # the list is small; by number, so that adaptive execution doesn't put all files into one task
    n = max(1, listed.count())
    hashed = listed.coalesce(1).repartition(n).mapInArrow(run, "path string, bytes bigint, sha256 string")
    return hashed.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "bytes", "sha256")


def write_manifest(spark: SparkSession, path: str, counts: DataFrame, **run: str) -> dict:
    """Counts (columns field, value, n), file hashes and facts about the run, as one JSON file beside the data."""
    files = {r.file: {"bytes": r.bytes, "sha256": r.sha256} for r in file_hashes(spark, path).collect()}
    fields: dict[str, dict[str, int]] = {}
    for r in counts.collect():
        fields.setdefault(r.field, {})[str(r.value)] = r.n
    manifest = {"files": files, "counts": fields, "run": run}
    _put(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, value: dict) -> None:
    system, at = _at(spark, path)
    out = system.create(at, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the data under ``path``; None if there is none."""
    system, at = _at(spark, f"{path}/{MANIFEST}")
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def verify_manifest(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """(file, state) of files that are missing, changed or not listed; empty if all is well."""
    listed = spark.createDataFrame([(k, v["sha256"]) for k, v in manifest["files"].items()], "file string, listed string")
    both = listed.join(file_hashes(spark, path), "file", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("sha256") != F.col("listed"), "changed")
    return both.select("file", state.alias("state")).where("state is not null")


def ingest(df: DataFrame, path: str, cap: int | None = None, verify_only: bool = False) -> dict:
    """Writes at most ``cap`` rows as JSON lines and tells their number and an order-free hash; or only verifies that what is there has the same."""
    rows = df.limit(cap) if cap is not None else df
    facts = lambda x: x.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(x.columns)))).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    if not verify_only:
        rows.write.mode("overwrite").json(path)
    there = facts(df.sparkSession.read.schema(df.schema).json(path))
    out = {"rows": there.n, "hash": str(there.h)}
    if verify_only:
        now = facts(rows)
        out["same"] = (now.n, now.h) == (there.n, there.h)
    return out


def _landed(spark: SparkSession, path: str) -> dict:
    """Rows and digest of what lies under ``path``: of the bytes, file by file."""
    files = sorted((r.file, r.sha256) for r in file_hashes(spark, path).collect())
    return {"rows_written": spark.read.text(path).count(), "sha256": hashlib.sha256("".join(f"{f}:{h}\n" for f, h in files).encode()).hexdigest()}


def land(df: DataFrame, path: str, cap: int, source: dict[str, str], verify_only: bool = False, force: bool = False, dry_run: bool = False) -> dict:
    """Lands at most ``cap`` rows as JSON lines under ``path``, with a manifest of where they are from, their number and the digest of their files.

    What is complete isn't written again (``skipped``). Data whose manifest is gone, as after a crash between the two, gets a new one, made from the files, that says
    so (``provenance_reconstructed``). ``force`` writes in any case; ``dry_run`` only counts; ``verify_only`` raises ValueError unless data and manifest are there and agree in
    source, cap, rows and digest.
    """
    if cap < 1:
        raise ValueError("cap: 1 at least")
    spark = df.sparkSession
    system, at = _at(spark, f"{path}/_SUCCESS")
    complete, manifest = system.exists(at), read_manifest(spark, path)
    if verify_only:
        if not complete:
            raise FileNotFoundError(f"nothing complete under {path}")
        if manifest is None:
            raise ValueError(f"{path} has no manifest")
        now = _landed(spark, path)
        wanted = now | {"cap": cap, "source": source}
        if wrong := [f"{k}: {manifest.get(k)} is not {v}" for k, v in wanted.items() if manifest.get(k) != v]:
            raise ValueError("; ".join(wrong))
        return manifest
    if dry_run:
        return {"rows_written": df.limit(cap).count()}
    if complete and not force:
        if manifest is not None:
            return manifest | {"skipped": True}
        manifest = _landed(spark, path) | {"cap": cap, "source": source, "provenance_reconstructed": True}
        _put(spark, f"{path}/{MANIFEST}", manifest)
        return manifest
    df.limit(cap).write.mode("overwrite").json(path)
    manifest = _landed(spark, path) | {"cap": cap, "source": source}
    _put(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def pending(spark: SparkSession, files: Sequence[str], out: str) -> list[str]:
    """Those of ``files`` that :func:`write_by_shard` hasn't written yet."""
    system, at = _at(spark, out)
    done = {x.getPath().getName().removeprefix("shard=") for x in system.listStatus(at)} if system.exists(at) else set()
    return [f for f in files if f.rsplit("/", 1)[-1] not in done]


def write_by_shard(df: DataFrame, name: str, out: str) -> None:
    """Writes rows under OUT/shard=NAME, NAME from a column; a shard's folder appears when the job is complete, and is replaced as a whole. An input shard without rows leaves none, and is read again."""
    df.withColumn("shard", F.col(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(out)
