"""Token ids, bit-packed: each id takes the bits that the vocabulary needs, no more.

The tokenizer's own library cuts and encodes each text whole, in compiled code. A document's ids are packed in blocks of ``block`` ids, each starting on a byte, so that
any range of ids is unpacked by numpy from the blocks it touches, without the rest.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents

#: Ranks of a public byte-level tokenizer; any file of lines "base64 rank" will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
#: How the tokenizer cuts a text into the pieces that it encodes.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The ids of texts from this many characters on come as an array, not as a list of Python's integers, which takes nine times the memory.
LONG = 1 << 20


def bit_width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """Packed ids and the byte offset of each block. Bit j of id i of a block is bit i * bits + j of the block, lowest first."""
    out, offsets, at = [], [], 0
    for start in range(0, len(ids), block):
        part = ids[start : start + block].astype(np.uint32)
        if bits == 16:
            data = part.astype("<u2").tobytes()
        else:
            data = np.packbits((part[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1, bitorder="little").tobytes()
        offsets.append(at)
        out.append(data)
        at += len(data)
    return b"".join(out), offsets


def unpack_ids(packed: bytes, offsets: list[int], n: int, bits: int, start: int = 0, stop: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Ids start .. stop; only the blocks that hold them are read."""
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block, (stop - 1) // block
    end = offsets[last + 1] if last + 1 < len(offsets) else len(packed)
    parts = []
    for b in range(first, last + 1):
        data = np.frombuffer(packed, np.uint8, (offsets[b + 1] if b < last else end) - offsets[b], offsets[b])
        count = min(block, n - b * block)
        if bits == 16:
            parts.append(data.view("<u2").astype(np.uint32))
        else:
            unpacked = np.unpackbits(data, bitorder="little")[: count * bits].reshape(count, bits)
            parts.append(unpacked @ (np.uint32(1) << np.arange(bits, dtype=np.uint32)))
    return np.concatenate(parts)[start - first * block : stop - first * block].astype(np.uint32)


def read_ranks(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})


def ids_of(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    if len(text) < LONG:
        return np.array(enc.encode_ordinary(text), dtype=np.uint32)
    return enc.encode_to_numpy(text, disallowed_special=())


def token_binary(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bits, block_offsets, packed) of each document; :func:`unpack_ids` reads it.

    Nulls: a null text has no token, as an empty one: 0 tokens, no block, no byte; a null id stays null. Long texts
    are encoded whole. Repeated rows get a row each. An empty table gives an empty result. Other columns are
    not read. The vocabulary is read where the job starts, and sent to the executors (about 1 MB).
    """
    ranks = read_ranks(vocabulary)
    bits = bit_width(1 + max(int(x.split()[1]) for x in ranks.splitlines() if x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                counts, offsets, packed = [], [], []
                for text in batch.column("text"):
                    ids = ids_of(text.as_py() or "", enc)
                    data, at = pack_ids(ids, bits, block)
                    counts.append(len(ids))
                    offsets.append(at)
                    packed.append(data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(np.full(len(counts), bits, np.int32)), pa.array(offsets, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                    ["doc_id", "n_tokens", "bits", "block_offsets", "packed"],
                )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, bits int, block_offsets array<bigint>, packed binary")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(documents(spark, sf_dir))
