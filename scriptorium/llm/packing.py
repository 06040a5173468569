"""Bounded-space online best-fit packing of documents into sequences of a fixed number of tokens.

Documents come in a pseudo-random order, dealt to shards of about ``shard_tokens`` tokens each; a shard is packed by one
task, with its own bins. A document goes into the open bin that it fills best. The open bins are held in a
bitset, whose bit f is set if some open bin has f tokens free, so that the best fit is the lowest set bit from
the document's length on. At most ``open_bins`` bins are open: if none fits and all are in use, the fullest one is closed.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, order_key, word_count

CAPACITY = 2048
OPEN_BINS = 64
SHARD_TOKENS = 4_000_000
SEED = "pack"


def best_fit(lengths: Iterable[int], capacity: int, open_bins: int) -> Iterator[tuple[int, int, int, int]]:
    """(item, start in the item, bin, start in the bin) of each piece; an item longer than a bin fills bins of its own and its rest is packed."""
    free: dict[int, deque[int]] = defaultdict(deque)  # open bins by free tokens, oldest first
    bits, n_open, made = 0, 0, 0
    for item, length in enumerate(lengths):
        start = 0
        while length - start >= capacity:
            yield item, start, made, 0
            made += 1
            start += capacity
        need = length - start
        if not need:
            continue
        fits = bits >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = free[room].popleft()
            if not free[room]:
                bits ^= 1 << room
            n_open -= 1
        else:
            if n_open == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                free[fullest].popleft()
                if not free[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            room, at, made = capacity, made, made + 1
        yield item, start, at, capacity - room
        room -= need
        if room:
            free[room].append(at)
            bits |= 1 << room
            n_open += 1


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: (doc_id, token_start, n_tokens, shard, bin, bin_start).

    Tokens are white-space separated words. Nulls: a null id hashes as an empty string and stays null; a null,
    empty or blank text has no tokens and no piece. A text longer than a bin is cut into pieces that fill bins,
    and its rest is packed like a short text; nothing is dropped. Ties in the order are broken by id and length;
    repeated rows are packed each. An empty table gives an empty result. Other columns are not read.
    """
    items = docs.select(F.col(id_col).alias("doc_id"), word_count(text_col).alias("n"), order_key(seed, id_col).alias("k")).where("n > 0")
    items = cut(items)
    shards = max(1, math.ceil((items.agg(F.sum("n")).first()[0] or 0) / shard_tokens))
    kind = items.schema["doc_id"].dataType.simpleString()

    def shard(rows: pa.Table) -> pa.Table:
        # ids stay in Arrow: numpy and pandas would make floats of integers beside a null
        rows = rows.take(pc.sort_indices(rows, [("k", "ascending"), ("doc_id", "ascending"), ("n", "ascending")], null_placement="at_end"))
        lengths = rows["n"].to_pylist()
        placed = list(best_fit(lengths, capacity, open_bins))
        item = [i for i, *_ in placed]
        return pa.table(
            {
                "doc_id": rows["doc_id"].take(pa.array(item, pa.int64())),
                "token_start": pa.array([s for _, s, _, _ in placed], pa.int64()),
                "n_tokens": pa.array([min(capacity, lengths[i] - s) for i, s, _, _ in placed], pa.int64()),
                "shard": pa.array([rows["shard"][0].as_py()] * len(placed), pa.int64()),
                "bin": pa.array([b for _, _, b, _ in placed], pa.int64()),
                "bin_start": pa.array([s for *_, s in placed], pa.int64()),
            }
        )

    return items.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards))).groupBy("shard").applyInArrow(shard, f"doc_id {kind}, token_start bigint, n_tokens bigint, shard bigint, bin bigint, bin_start bigint")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
