"""Quality by a support vector machine over naive Bayes features.

A document is the set of its hashed byte n-grams. Each n-gram's indicator is multiplied by the logarithm of the ratio
of its smoothed shares in good and bad training documents; the products, scaled to unit length, go into a linear hinge-loss model
that dual coordinate descent fits. The weights are then drawn towards their mean magnitude.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, first_labelled, labelled_texts
from .linear import hinge_dual

#: Bound of the labelled sample that the model is fitted on: documents of either label.
TRAIN_PER_LABEL = 1500
BITS = 18
#: Bytes of a text that are read at a time.
PIECE = 1 << 20
NGRAMS = (2, 3)
ALPHA = 1.0
C = 1.0
BETA = 0.5


@dataclass(frozen=True)
class QualityModel:
    ratio: np.ndarray  # float32, of each n-gram
    weight: np.ndarray  # float32, of each n-gram: model weight times ratio
    bias: float


def ngram_set(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of the bytes of one text, in ascending order. ``place`` is scratch of 2**BITS integers. A long text is read in pieces that overlap by an n-gram less a byte."""
    if len(data) <= PIECE:
        return np.sort(_ngrams(data, place))
    seen = np.zeros(1 << BITS, dtype=bool)
    for start in range(0, len(data) - max(NGRAMS) + 1, PIECE):
        seen[_ngrams(data[start : start + PIECE + max(NGRAMS) - 1], place)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def _ngrams(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    parts = []
    for n in NGRAMS:
        if len(x) >= n:
            h = x[: len(x) - n + 1].copy()
            for i in range(1, n):
                h *= np.uint32(65599)
                h += x[i : len(x) - n + 1 + i]
            h += np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            parts.append((h * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    if not parts:
        return np.zeros(0, np.uint32)
    grams = np.concatenate(parts)
    order = np.arange(len(grams), dtype=np.int64)
    place[grams] = order
    return grams[place[grams] == order]


def _scratch() -> np.ndarray:
    return np.zeros(1 << BITS, dtype=np.int64)


def fit(texts: Sequence[str], good: Sequence[int]) -> QualityModel:
    """Texts of fewer than two bytes have no n-gram and teach nothing; if only one label is left, the model calls all texts that, and bad if none is."""
    long = [len(t.encode()) >= min(NGRAMS) for t in texts]
    texts, good = [t for t, k in zip(texts, long, strict=True) if k], np.asarray(good, dtype=bool)[np.array(long, dtype=bool)]
    place = _scratch()
    sets = [ngram_set(np.frombuffer(t.encode(), dtype=np.uint8), place).astype(np.int64) for t in texts]
    if good.all() or not good.any():
        return QualityModel(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 1.0 if len(good) and good.all() else -1.0)
    counts = np.full((2, 1 << BITS), ALPHA)
    for s, g in zip(sets, good, strict=True):
        counts[int(g)][s] += 1
    seen = counts.sum(0) > 2 * ALPHA
    ratio = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
    rows = []
    for s in sets:
        x = ratio[s]
        rows.append((np.r_[s, 1 << BITS], np.r_[x / max(np.sqrt(x @ x), 1e-9), 0.3]))
    w = hinge_dual(rows, np.where(good, 1.0, -1.0), (1 << BITS) + 1, C)
    bias, w = 0.3 * w[-1], w[:-1]
    mean = np.abs(w[seen]).mean() if seen.any() else 0.0
    w = np.where(seen, (1 - BETA) * mean + BETA * w, 0.0)
    # the bias that separates the training scores best after the weights have moved
    scores = np.array([float((w[s] * ratio[s]).sum() / max(np.sqrt((ratio[s] ** 2).sum()), 1e-9)) for s in sets])
    order = np.argsort(scores)
    wrong = np.r_[0, np.cumsum(np.where(good[order], 1 / good.sum(), -1 / (~good).sum()))]
    k = int(np.argmin(wrong))
    ranked = np.r_[scores[order[0]] - 1, scores[order], scores[order[-1]] + 1]
    return QualityModel(ratio.astype(np.float32), (w * ratio).astype(np.float32), float(-(ranked[k] + ranked[k + 1]) / 2))


def score(texts: pa.Array, model: QualityModel, place: np.ndarray | None = None) -> np.ndarray:
    """Signed distance from the boundary; above 0 is good. A text without an n-gram gets minus infinity."""
    place = _scratch() if place is None else place
    out = np.full(len(texts), -np.inf)
    for i, text in enumerate(pc.fill_null(texts, "")):
        s = ngram_set(np.frombuffer(text.as_buffer(), dtype=np.uint8), place) if text.as_buffer().size else ()
        if len(s):
            r = model.ratio[s]
            out[i] = float(model.weight[s].sum(dtype=np.float64)) / max(float(np.sqrt(r @ r)), 1e-9) + model.bias
    return out


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits on at most ``per_label`` documents of each label, the first in a hashed order. Rows with a null label, id or text aren't used."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fit(*labelled_texts(docs, first_labelled(known, "quality", "quality", per_label, (0, 1)), "quality", id_col, text_col))


def quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, is_good) of each document.

    Nulls: a null text, or one of fewer than two bytes, has the score minus infinity and isn't good; a null id
    stays null. Long texts are read whole. A score of exactly 0 isn't good. Repeated rows get a row each. An empty
    table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _scratch()
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                s = score(batch.column("text"), model, place)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(s > 0)], ["doc_id", "score", "is_good"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double, is_good boolean")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
