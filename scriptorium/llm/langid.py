"""Language identification in two steps: the language family first, then languages within it.

Both steps are one-versus-one linear support vector machines over hashed byte trigrams of the lower-cased text; the
class with the most votes wins, then the one with the greater sum of margins. All machines read the text in one pass:
the weights of a trigram for every machine lie beside each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, documents, order_key
from .linear import hinge_dual

FAMILIES: dict[str, tuple[str, ...]] = {"germanic": ("en", "de"), "romance": ("fr", "es")}
#: Bound of the labelled sample that the machines are fitted on: documents of each language.
TRAIN_PER_LANGUAGE = 300
BITS = 16
#: Bytes whose weights are held at a time.
PIECE = 1 << 20
C = 10.0
#: Frequencies of trigrams are multiplied by this before fitting.
SCALE = 20.0


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[str, ...]
    members: tuple[tuple[str, ...], ...]
    #: (classes, first, second) of each machine: level -1 tells families apart, level k the languages of family k.
    machines: tuple[tuple[int, int, int], ...]
    weights: np.ndarray  # (2**BITS, machines)
    bias: np.ndarray


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hash of the three bytes from each place on."""
    x = data.astype(np.uint32)
    h = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the lower-cased texts, and where each text starts, with the end."""
    low = pc.fill_null(pc.utf8_lower(texts), "")
    data = b"".join(x.as_buffer() for x in low) if low.offset else low.buffers()[2]
    sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(data, dtype=np.uint8)[: int(ends[-1])] if len(ends) and ends[-1] else np.zeros(0, np.uint8)
    return raw, np.r_[0, ends]


def margins(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Margin of each machine, and which texts have a trigram at all."""
    raw, edges = _bytes(texts)
    n = np.maximum(edges[1:] - edges[:-1] - 2, 0)
    out = np.zeros((len(n), len(model.bias)), dtype=np.float64)
    # texts, or pieces of a long one, up to PIECE bytes at a time
    pieces = -(-n // PIECE)
    of = np.repeat(np.arange(len(n)), pieces)
    start = edges[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.minimum(start + PIECE, edges[of] + n[of])
    first = 0
    while first < len(of):
        last = max(first + 1, int(np.searchsorted(stop, start[first] + PIECE, side="right")))
        base = start[first]
        w = np.concatenate([model.weights[trigrams(raw[base : stop[last - 1] + 2])], np.zeros((1, len(model.bias)), np.float32)])
        at = np.stack([start[first:last], stop[first:last]], axis=1).ravel() - base
        np.add.at(out, of[first:last], np.add.reduceat(w, at, axis=0, dtype=np.float64)[::2])
        first = last
    out /= np.maximum(n, 1)[:, None]
    return SCALE * out + model.bias, n > 0


def decide(margin: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, list[np.ndarray]]:
    """Index of the family of each text, and of the language within each family."""

    def vote(level: int, classes: int) -> np.ndarray:
        votes, sums = np.zeros((len(margin), classes)), np.zeros((len(margin), classes))
        for k, (at, a, b) in enumerate(model.machines):
            if at == level:
                m = margin[:, k]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                sums[:, a] += m
                sums[:, b] -= m
        return np.argmax(votes + 1e-3 * np.tanh(sums), axis=1)

    return vote(-1, len(model.families)), [vote(k, len(x)) for k, x in enumerate(model.members)]


def predict(texts: pa.Array, model: LanguageModel) -> tuple[list[str | None], list[str | None]]:
    """Family and language of each text; None without a trigram, and of all texts by a model that was fitted on none."""
    if not model.families:
        return [None] * len(texts), [None] * len(texts)
    margin, known = margins(texts, model)
    family, within = decide(margin, model)
    return (
        [model.families[f] if ok else None for f, ok in zip(family, known, strict=True)],
        [model.members[f][within[f][i]] if known[i] else None for i, f in enumerate(family)],
    )


def fit(texts: Sequence[str], languages: Sequence[str], families: Mapping[str, Sequence[str]] = FAMILIES) -> LanguageModel:
    """A language of no given family is a family of its own."""
    of = {x: f for f, members in families.items() for x in members}
    seen = sorted(set(languages))
    names = tuple(sorted({of.get(x, x) for x in seen}))
    members = tuple(tuple(x for x in seen if of.get(x, x) == f) for f in names)
    rows = []
    for text in texts:
        at, n = np.unique(trigrams(np.frombuffer(text.lower().encode(), dtype=np.uint8)), return_counts=True)
        rows.append((np.r_[at, 1 << BITS].astype(np.int64), np.r_[SCALE * n / n.sum(), 1.0] if len(n) else np.r_[1.0]))
    family = np.array([names.index(of.get(x, x)) for x in languages])
    language = np.array([seen.index(x) for x in languages])
    machines, weights = [], []

    def machine(level: int, a: int, b: int, positive: np.ndarray, negative: np.ndarray) -> None:
        chosen = np.flatnonzero(positive | negative)
        machines.append((level, a, b))
        weights.append(hinge_dual([rows[i] for i in chosen], np.where(positive[chosen], 1.0, -1.0), (1 << BITS) + 1, C))

    for a, b in combinations(range(len(names)), 2):
        machine(-1, a, b, family == a, family == b)
    for k, group in enumerate(members):
        for a, b in combinations(range(len(group)), 2):
            machine(k, a, b, language == seen.index(group[a]), language == seen.index(group[b]))
    stacked = np.stack(weights, axis=1) if weights else np.zeros(((1 << BITS) + 1, 0))
    return LanguageModel(names, members, tuple(machines), stacked[:-1].astype(np.float32), stacked[-1])


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, families: Mapping[str, Sequence[str]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on at most ``per_language`` documents of each labelled language, the first in a hashed order. Rows with a null id, text or language, or a text below three bytes, aren't used. Without any that are, the model knows no language, and :func:`identify` gives nulls."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and length(text) >= 3")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order_key("language", "id"), "id"))
    chosen = rows.select("id", "lang").distinct().withColumn("place", place).where(F.col("place") <= per_language).select("id", "lang")
    # at most per_language rows of a language
    found = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["id"], r["lang"], r["text"]))
    return fit([r["text"] for r in found], [r["lang"] for r in found], families)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, family, language) of each document.

    Nulls: family and language of a null text, or one of fewer than three bytes, are null; a null id stays null.
    Long texts are read whole. Ties of votes and margins go to the class that comes first in the alphabet. Repeated
    rows get a row each. An empty table gives an empty result. Other columns, such as a given language, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 2 << 20):
                family, language = predict(batch.column("text"), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(family, pa.string()), pa.array(language, pa.string())], ["doc_id", "family", "language"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, family string, language string")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
