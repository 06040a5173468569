"""Quality rules by line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

A document is its sequence of lines. A line's score of being content is linear in features of the line alone
(its length, how its characters divide into letters, capitals, digits and signs, its end, notices of
rights, whether it repeats an earlier line); a chain of two labels with transition scores joins the lines. Viterbi decoding gives
the best labels, and a document stays if content lines hold enough of its characters.

No line is labelled by hand. The field learns from documents whose quality is known: the lines of bad ones count as boilerplate, those of
good ones as content, notices of rights aside. What makes a line boilerplate is thus found in the labels, not in a list of
rules; the field weighs the signs against each other and carries them over to neighbouring lines. That other documents share a line says
nothing here: copies of a good document share all of theirs.
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

#: Bound of the labelled sample that the field is fitted on: documents.
TRAIN_DOCS = 1500
MIN_CONTENT_SHARE = 0.5
L2 = 1e-3
ROUNDS = 200
NOTICE = r"(?i)licen[sc]ed? under|all rights reserved|copyright|\(c\) ?\d{4}|terms of (use|service)|privacy policy|cookies?\b|subscribe|sign up|log ?in\b|click here|MIT License|General Public License|derechos reservados|droits r.serv.s|alle rechte vorbehalten"
FEATURES = 25
#: Bytes that are told apart at a time.
PIECE = 1 << 21
NOTICE_FEATURE = 16


@dataclass(frozen=True)
class LineField:
    emit: np.ndarray  # (FEATURES,) towards content
    move: np.ndarray  # (2, 2) from label to label; 1 is content
    start: np.ndarray  # (2,)


def lines_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """First line of each text with the end, and all lines. A null text has no line, an empty one has an empty line."""
    lists = pc.split_pattern(texts, "\n")
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(counts)].astype(np.int64), lists.flatten()


def features(edges: np.ndarray, lines: pa.Array) -> np.ndarray:
    """(lines, FEATURES)."""
    n = len(lines)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if not n:
        return out

    def ints(x: pa.Array) -> np.ndarray:
        return x.to_numpy(zero_copy_only=False).astype(np.float64)

    size = ints(pc.binary_length(lines)).astype(np.int64)
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, n], lines), "")[0].as_buffer(), dtype=np.uint8) if size.sum() else np.zeros(0, np.uint8)
    code = np.arange(256)
    lower = ((code >= 97) & (code <= 122)) | (code >= 128)
    upper = (code >= 65) & (code <= 90)
    digit = (code >= 48) & (code <= 57)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    plain = np.isin(code, [ord(x) for x in ".,;:'-?()\""])
    kind = np.select([lower, upper, digit, plain, space], [0, 1, 2, 4, 5], 3)  # 3: other signs
    counts, ends, first = np.zeros((n, 6)), np.cumsum(size), 0
    while first < n:  # lines of about PIECE bytes at a time
        begin = int(ends[first] - size[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        which = kind[raw[begin : ends[last - 1]]]
        if last - first > 1:
            which = which + np.repeat(6 * np.arange(last - first), size[first:last])
        counts[first:last] = np.bincount(which, minlength=6 * (last - first)).reshape(-1, 6)
        first = last
    sl, su, sd, ss, sp, sw = (counts / np.maximum(size, 1)[:, None]).T
    notice = ints(pc.match_substring_regex(lines, NOTICE)) > 0
    ends = ints(pc.match_substring_regex(lines, r"[.!?]\s*$")) > 0
    bars = ints(pc.match_substring_regex(lines, r"\|.*\||\t.*\t")) > 0
    link = ints(pc.match_substring_regex(lines, r"https?://|www\.|@[a-z0-9-]+\.")) > 0
    lists = pc.utf8_split_whitespace(lines)
    word = lists.flatten().dictionary_encode()
    where = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(where[ids >= 0], minlength=n)
    key = np.sort(where * max(len(word.dictionary), 1) + ids)
    distinct = np.bincount(key[np.r_[True, key[1:] != key[:-1]]] // max(len(word.dictionary), 1), minlength=n) if len(key) else np.zeros(n)
    follows = np.flatnonzero((ids[1:] == ids[:-1]) & (where[1:] == where[:-1]) & (ids[1:] >= 0)) + 1
    stutter = np.bincount(where[follows], minlength=n) / np.maximum(n_words, 1)  # words that say the one before again
    words = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    _, first = np.unique(owner * (words.max() + 1) + words, return_index=True)
    again = np.ones(n, dtype=bool)
    again[first] = False
    columns = [
        np.ones(n), size == 0, (size > 0) & (size < 20), (size >= 20) & (size < 60), (size >= 60) & (size < 200), size >= 200,
        sl > 0.6, su > 0.2, su > 0.5, sd > 0.1, sd > 0.3, ss > 0.02, ss > 0.1, ss > 0.2, sp > 0.2, sw > 0.3,
        notice, ends & (size > 0), bars | link, again, (n_words >= 8) & (distinct <= np.maximum(2, 0.1 * n_words)),
        stutter > 0.1, stutter > 0.4, (n_words >= 8) & (distinct <= 0.6 * n_words), (n_words >= 8) & (distinct <= 0.3 * n_words),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _by_place(edges: np.ndarray) -> Iterator[np.ndarray]:
    """Documents that have a line at place 0, 1, ...; longest documents first, so that each is a prefix of the one before."""
    n = np.diff(edges)
    order = np.argsort(-n, kind="stable")
    ranked = n[order]
    for t in range(int(ranked[0]) if len(ranked) else 0):
        yield order[: int(np.searchsorted(-ranked, -t, side="left"))]


def viterbi(edges: np.ndarray, emit: np.ndarray, field: LineField) -> np.ndarray:
    """Best label of each line; ``emit`` is each line's score of being content. All documents advance together, line by line."""
    label = np.zeros(len(emit), dtype=np.int8)
    back = np.zeros((len(emit), 2), dtype=np.int8)
    best = np.zeros((len(edges) - 1, 2))
    places = list(_by_place(edges))
    for t, docs in enumerate(places):
        at = edges[docs] + t
        own = np.stack([np.zeros(len(docs)), emit[at]], axis=1)
        if t == 0:
            best[docs] = field.start + own
            continue
        reach = best[docs][:, :, None] + field.move[None]
        back[at] = np.argmax(reach, axis=1)
        best[docs] = reach.max(axis=1) + own
    last = np.argmax(best, axis=1).astype(np.int8)
    for t in range(len(places) - 1, -1, -1):
        docs = places[t]
        at = edges[docs] + t
        label[at] = last[docs]
        last[docs] = back[at, last[docs]]
    return label


def _expectations(edges: np.ndarray, emit: np.ndarray, field: LineField) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of log partition functions; P(content) of each line; expected transitions and starts."""
    places = list(_by_place(edges))
    scores = np.stack([np.zeros(len(emit)), emit], axis=1)
    fore, back = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    for t, docs in enumerate(places):
        at = edges[docs] + t
        fore[at] = scores[at] + (field.start if t == 0 else np.logaddexp.reduce(fore[at - 1][:, :, None] + field.move[None], axis=1))
    for t in range(len(places) - 1, 0, -1):
        at = edges[places[t]] + t
        back[at - 1] = np.logaddexp.reduce(field.move[None] + (scores[at] + back[at])[:, None, :], axis=2)
    has = np.diff(edges) > 0
    firsts = edges[:-1][has]
    z = np.logaddexp.reduce(fore[firsts] + back[firsts], axis=1)
    zs = np.repeat(z, np.diff(edges)[has])
    p = np.exp(fore + back - zs[:, None])
    inner = np.ones(len(emit), dtype=bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    pair = np.exp(fore[at - 1][:, :, None] + field.move[None] + (scores[at] + back[at])[:, None, :] - zs[at][:, None, None])
    return float(z.sum()), p[:, 1], pair.sum(0), p[firsts].sum(0)


def fit_labelled(edges: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, l2: float = L2) -> LineField:
    """Maximises the mean conditional log likelihood of the labels ``y`` by Adam."""
    n = max(len(y), 1)
    firsts = edges[:-1][np.diff(edges) > 0]
    inner = np.ones(len(y), dtype=bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    true_move, true_start = np.zeros((2, 2)), np.bincount(y[firsts], minlength=2).astype(float)
    np.add.at(true_move, (y[at - 1], y[at]), 1)
    true_emit = x.T @ y
    w = np.zeros(x.shape[1] + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        field = LineField(w[:-6], w[-6:-2].reshape(2, 2), w[-2:])
        _, p, move, start = _expectations(edges, x @ field.emit, field)
        g = np.concatenate([(true_emit - x.T @ p), (true_move - move).ravel(), true_start - start]) / n - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineField(w[:-6], w[-6:-2].reshape(2, 2), w[-2:])


def fit(texts: Sequence[str], good: Sequence[int]) -> LineField:
    """Fits on documents whose quality is known: lines of bad ones are boilerplate, those of good ones content, except notices of rights, which stand in either."""
    edges, lines = lines_of(pa.array(texts, pa.string()))
    x = features(edges, lines)
    if not len(x):
        return LineField(np.eye(FEATURES)[0], np.zeros((2, 2)), np.zeros(2))
    content = np.repeat(np.asarray(good, dtype=bool), np.diff(edges)) & (x[:, NOTICE_FEATURE] == 0)
    return fit_labelled(edges, x.astype(np.float64), content.astype(np.int64))


def label_texts(texts: pa.Array, field: LineField) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line of each text with the end, label of each line (1 content), and characters of each line."""
    edges, lines = lines_of(texts)
    x = features(edges, lines)
    return edges, viterbi(edges, x @ field.emit, field), pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fits on ``n_docs`` labelled documents at most, the first in a hashed order. Rows with a null label, id or text aren't used; without any that are, all lines are content."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fit(*labelled_texts(docs, first_labelled(known, "quality", "lines", n_docs), "quality", id_col, text_col))


def line_quality(docs: DataFrame, field: LineField, min_content_share: float = MIN_CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content_share, is_kept) of each document: the share of its characters (line breaks aside) in content lines, and whether it reaches ``min_content_share``.

    Nulls: a null text has no line; its share is 0 and it isn't kept. A text of empty lines has share 0 as
    well. A null id stays null. Long texts are labelled whole. Equal scores of both labels mean boilerplate.
    Repeated rows get a row each. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                edges, label, size = label_texts(batch.column("text"), field)
                total, content = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(size * label)]
                share = (content[edges[1:]] - content[edges[:-1]]) / np.maximum(total[edges[1:]] - total[edges[:-1]], 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(share), pa.array((share >= min_content_share) & (share > 0))], ["doc_id", "content_share", "is_kept"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, content_share double, is_kept boolean")


def op10_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
