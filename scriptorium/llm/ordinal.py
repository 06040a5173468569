"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 .. G-1 are predicted from the set of a text's words and of their beginnings. All thresholds share one weight vector:
P(grade > g) = sigmoid(w.x - theta[g]) with theta ascending. Weights are held sparse by an L1 penalty, so that long
texts don't gather noise. The output is the expected grade.

Labels only say whether a document is toxic. The grades of toxic training documents come from how dense the
words are that the labels point to (those with the highest smoothed log-odds): below the median of toxic documents is grade 1,
from it on grade 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, first_labelled, hash_words, labelled_texts

#: Bound of the labelled sample that the model is fitted on: documents of either label.
TRAIN_PER_LABEL = 1200
GRADES = 3
#: A document is toxic if a grade above 0 has at least this probability. Training weighs toxic and clean documents alike, as if they were equally many; they aren't.
TOXIC_FROM = 0.6
L1 = 1e-3
ROUNDS = 300
MIN_DOCS = 3
BEGINNINGS = (4, 6)
NOT_WORD = r"[^\p{L}\p{N}_]+"


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and word number of each word, and the words."""
    lists = pc.split_pattern_regex(pc.fill_null(pc.utf8_lower(texts), ""), NOT_WORD)
    words = lists.flatten().dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def features_of(words: pa.Array) -> list[pa.Array]:
    """Each word, and its beginnings of some lengths with a dash, which inflected forms share; null for empty words and those that aren't longer."""
    length = pc.utf8_length(words)
    null = pa.scalar(None, pa.string())
    out = [pc.if_else(pc.greater(length, 0), words, null)]
    for k in BEGINNINGS:
        out.append(pc.if_else(pc.greater(length, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), "-", ""), null))
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _pairs(owner: np.ndarray, ids: np.ndarray, numbers: list[np.ndarray], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs. ``numbers`` hold the feature's number of each word, for each kind of feature; -1 for none."""
    keys = []
    for number in numbers:
        f = number[ids]
        has = f >= 0
        keys.append(owner[has] * n_features + f[has])
    key = _distinct(np.concatenate(keys))
    return key // max(n_features, 1), key % max(n_features, 1)


def _training_features(texts: list[str], min_docs: int, at_once: int = 300) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Distinct (text, feature) pairs, the features and each text's number of words, of features that ``min_docs`` texts have.

    The texts are read some at a time; features go by 64 bits until the rare ones, which are most, have been left out.
    """
    docs, found, vocabularies, n_words = [], [], [], np.zeros(len(texts), dtype=np.int64)
    for start in range(0, len(texts), at_once):
        owner, ids, words = _tokens(pa.array(texts[start : start + at_once], pa.string()))
        np.add.at(n_words, owner + start, 1)
        names = pa.concat_arrays(features_of(words)).dictionary_encode()
        numbers = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(words))
        doc, feature = _pairs(owner, ids, list(numbers), len(names.dictionary))
        hashes, _ = hash_words(names.dictionary)
        docs.append((doc + start).astype(np.int32))
        found.append(hashes[feature])
        vocabularies.append((hashes, names.dictionary))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [], n_words
    kinds, index, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts >= min_docs)
    number = np.full(len(kinds), -1)
    number[often] = np.arange(len(often))
    name = {}
    for hashes, dictionary in vocabularies:
        at = np.minimum(np.searchsorted(kinds, hashes), len(kinds) - 1)
        mine = np.flatnonzero((kinds[at] == hashes) & (number[at] >= 0))
        name.update(zip(number[at[mine]].tolist(), dictionary.take(pa.array(mine)).to_pylist(), strict=True))
    doc, feature = np.concatenate(docs).astype(np.int64), number[index]
    kept = feature >= 0
    return doc[kept], feature[kept], [name[i] for i in range(len(often))], n_words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[str], toxic: list[int], grades: int = GRADES, l1: float = L1, rounds: int = ROUNDS, min_docs: int = MIN_DOCS) -> OrdinalModel:
    """Accelerated proximal gradient descent on the mean negative log likelihood with an L1 penalty on the weights."""
    toxic = np.asarray(toxic, dtype=np.int64)
    n = len(texts)
    if n == 0 or toxic.min() == toxic.max():
        return OrdinalModel({}, tuple(float(12 + g) for g in range(grades - 1)))
    doc, word, names, n_words = _training_features(texts, min_docs)
    m = len(names)

    hit = np.bincount(word, weights=toxic[doc], minlength=m)
    miss = np.bincount(word, weights=1 - toxic[doc], minlength=m)
    bad, good = toxic.sum(), n - toxic.sum()
    odds = np.log((hit + 0.5) / (bad + 1)) - np.log((miss + 0.5) / (good + 1))
    pointed = (odds > 2) & (hit >= 0.02 * bad)
    density = np.bincount(doc, weights=pointed[word], minlength=n) / np.maximum(1, n_words)
    grade = np.zeros(n, dtype=np.int64)
    cuts = np.quantile(density[toxic == 1], [g / (grades - 1) for g in range(1, grades - 1)])
    grade[toxic == 1] = 1 + (density[toxic == 1][:, None] >= cuts[None, :]).sum(1)

    # both labels weigh the same in all
    mass = np.where(toxic == 1, 0.5 / bad, 0.5 / good)
    above = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    share = np.clip(mass @ above, 1 / n, 1 - 1 / n)
    theta = -np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades - 1))

    def forward(w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = np.bincount(doc, weights=w[word], minlength=n)
        p = _sigmoid(s[:, None] - t[None, :])  # P(grade > g)
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        like = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        lower, upper = slope[rows, grade], slope[rows, grade + 1]
        ds = -(lower - upper) / like * mass
        dt = np.zeros(grades + 1)
        np.add.at(dt, grade, lower / like * mass)
        np.add.at(dt, grade + 1, -upper / like * mass)
        return float(-(mass * np.log(like)).sum()), np.bincount(word, weights=ds[doc], minlength=m), dt[1:-1]

    w, z, zt, step, pace = np.zeros(m), np.zeros(m), theta.copy(), 1.0, 1.0
    for _ in range(rounds):
        loss, gw, gt = forward(z, zt)
        while True:
            nw = z - step * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
            nt = np.maximum.accumulate(zt - step * gt)
            d2 = ((nw - z) ** 2).sum() + ((nt - zt) ** 2).sum()
            if forward(nw, nt)[0] <= loss + gw @ (nw - z) + gt @ (nt - zt) + d2 / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        z, zt = nw + (pace - 1) / faster * (nw - w), np.maximum.accumulate(nt + (pace - 1) / faster * (nt - theta))
        w, theta, pace = nw, nt, faster
    return OrdinalModel({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)}, tuple(map(float, theta)))


def score(texts: pa.Array, model: OrdinalModel) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity and P(grade > 0)."""
    owner, ids, words = _tokens(texts)
    names = pa.array(list(model.weights), pa.string())
    numbers = [pc.index_in(f, value_set=names, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False) for f in features_of(words)]
    doc, feature = _pairs(owner, ids, numbers, len(names))
    s = np.bincount(doc, weights=np.array(list(model.weights.values()), dtype=float)[feature], minlength=len(texts))
    p = _sigmoid(s[:, None] - np.array(model.thresholds)[None, :])
    return p.sum(1), p[:, 0]


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most ``per_label`` documents of each label, the first in a hashed order. Rows with a null label, id or text aren't used."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(*labelled_texts(docs, first_labelled(known, "toxic", "toxicity", per_label, (0, 1)), "toxic", id_col, text_col))


def _scored(texts: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc, text) to (doc, severity, p_toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                severity, p = score(batch.column("text"), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(severity), pa.array(p)], ["doc", "severity", "p_toxic"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc {kind}, severity double, p_toxic double")


def toxicity(docs: DataFrame, model: OrdinalModel, threshold: float = TOXIC_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, is_toxic) of each document: the expected grade, and whether a grade above 0 has the probability ``threshold``.

    Nulls: a null text counts as one without words, which isn't toxic unless most training documents were; a null id stays
    null. Empty texts likewise. Long texts are scored whole. Repeated rows get a row each, with equal scores. An empty
    table gives an empty result. Other columns are not read.
    """
    scored = _scored(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), model)
    return scored.select(F.col("doc").alias("doc_id"), "severity", (F.col("p_toxic") >= threshold).alias("is_toxic"))


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = TOXIC_FROM, text_col: str = "text") -> DataFrame:
    """``docs`` without the toxic documents; same columns. Edge cases as in :func:`toxicity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, text_col):
                yield batch.filter(pa.array(score(batch.column(text_col), model)[1] < threshold))

    # rows pass through the scorer: one scan, no join
    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
