"""SimHash near-duplicates by a self-join of a binary trie.

A document's fingerprint has 256 bits, each the sign of a sum of hashed bits over features: 64 over its words, weighted by the square root of
their counts, and 192 over its runs of three words. Two documents are near if at most ``budget`` of the first differ and at
most ``budget_runs`` of the others. The words of near copies differ little, so that the trie's error budget can be small; but those of unrelated
long texts of a language can come close, too. Their runs don't: unrelated texts differ in half of these bits. The word bits only choose
what is compared, and their budget leaves room for short texts, in which a few other words turn many bits. A line that many texts have is a
large part of a very short one: if more than BUDGET_SHORT word bits differ, such a text is near another only within BUDGET_RUNS_SHORT.

The self-join descends a binary trie of the first 64 bits with pairs of nodes: the children of a pair differ in one more
bit or not, and a pair that has used up its error budget is dropped. Read from one end only, the trie would let all pairs through
down to a depth of some twenty bits, as all errors may come late. So it is read from ``m`` places of the ring of bits: from one of them at
least, the errors of a near pair keep in step with the depth, and the budget of a node pair grows with its depth from 1 or 2 on.
To spread this over a cluster, the tries are cut at a depth that follows the counts of their nodes: a task has a node and
those fingerprints whose paths to it turn half of the errors that a pair may have there, and starts from the pairs of node ranges that have met, with their errors so
far. Below, it descends until few pairs of members are left, which it compares one by one. The result is exact for any number of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, documents, fresh, hash_words, numbered, repeatable, without_rows

BUDGET = 13
BUDGET_RUNS = 66
#: For texts of fewer than SHORT words.
SHORT = 30
BUDGET_SHORT, BUDGET_RUNS_SHORT = 9, 44
PRINT = ["f0", "f1", "f2", "f3"]
PRINT_SCHEMA = ", ".join(f"{c} bigint" for c in PRINT)
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Depth of the nodes that tasks start from, at least; down to what depth nodes are counted; and how many fingerprints a node may be sent before the next depth is taken.
MIN_DEPTH, COUNT_DEPTH, NODE_ROWS = 6, 13, 1 << 20
#: A node that is too large at the last depth is split into 2**MOST_PART_BITS parts at most.
MOST_PART_BITS = 6
#: Pairs of nodes with at most so many pairs of members are compared member by member.
LEAF_PAIRS = 1 << 14
#: Pairs of nodes that are advanced at a time.
NODE_PAIRS = 1 << 20
#: So many edges are joined into groups by one task.
ONE_TASK_EDGES = 1 << 20
#: Rows joined at a time, pairs compared at a time, and pairs compared between two looks at the forest, in a task.
CHUNK_ROWS, CHUNK_PAIRS, LOOK_PAIRS = 60_000, 300_000, 3_000_000


# --- fingerprints ---


def _word_lanes(hashes: np.ndarray) -> np.ndarray:
    """(16, words): each word's 64 bits, in lanes of 16 bits, four to an integer."""
    return np.stack([(hashes >> np.uint64(k)) & np.uint64(0x0001000100010001) for k in range(16)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each document starts, where it or its next 60,000 items do (sums of 16 bits hold as many), and how many items it has."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[starts, len(owner)])
    inside = np.arange(len(owner)) - np.repeat(starts, sizes)
    return starts, np.flatnonzero(inside % 60_000 == 0), sizes


def _majority(h: np.ndarray, parts: np.ndarray, firsts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each document the 64 bits that more than half of its hashes have. ``parts`` start where a document or its next 60,000 hashes do, ``firsts`` are the parts that start a document."""
    wide = np.empty((len(parts), 64), dtype=np.int64)
    for shift in range(16):  # four lanes of 16 bits at a time
        sums = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0001000100010001), parts)
        wide[:, shift::16] = sums.view(np.uint16).reshape(-1, 4)
    if len(firsts) < len(parts):
        wide = np.add.reduceat(wide, firsts, axis=0)
    return np.packbits(2 * wide > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _run_bits(owner: np.ndarray, word_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents, and three times 64 bits of each, over its runs of three words; after the last word come blanks."""
    starts, parts, sizes = _parts(owner)

    def later(k: int) -> np.ndarray:
        out = np.zeros(len(owner), dtype=np.uint64)
        out[:-k] = np.where(owner[k:] == owner[:-k], word_hash[k:], np.uint64(0))
        return out

    h = _mixed(_mixed(word_hash) + np.uint64(3) * _mixed(later(1) + np.uint64(1)) + np.uint64(5) * _mixed(later(2) + np.uint64(2)))
    firsts = np.searchsorted(parts, starts)
    bits = [_majority(_mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), parts, firsts, sizes) for k in (1, 2, 3)]
    return owner[starts], np.stack(bits, axis=1)


def fingerprints_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 4) of 64 bits each, and which texts have words at all."""
    prints, words = _prints_and_words(texts)
    return prints, words > 0


def _prints_and_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 4) of 64 bits each, and the number of each text's words."""
    lists = pc.split_pattern_regex(pc.fill_null(pc.utf8_lower(texts), ""), NOT_WORD)
    words = lists.flatten().dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes, real = hash_words(words.dictionary)
    if not real.all():
        kept = real[ids]
        ids, owner = ids[kept], owner[kept]
    out = np.zeros((len(texts), 4), dtype=np.uint64)
    if len(ids):
        n = len(hashes)
        found, bits = _run_bits(owner, hashes[ids])
        out[found, 1:] = bits
        keys = np.sort(owner * n + ids)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[first, len(keys)])
        docs, ids = keys[first] // n, keys[first] % n
        weights = np.rint(4 * np.sqrt(counts)).astype(np.uint64)
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        total = np.add.reduceat(weights, starts)
        # a lane holds sums below 2**16: heavier documents are summed in pieces
        before = np.cumsum(weights) - weights
        piece = (before - before[starts].repeat(np.diff(np.r_[starts, len(docs)]))) // np.uint64(60_000)
        parts = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (piece[1:] != piece[:-1])])
        lanes = _word_lanes(hashes)
        wide = np.empty((len(parts), 64), dtype=np.int64)
        for k in range(16):
            wide[:, k::16] = np.add.reduceat(lanes[k][ids] * weights, parts).view(np.uint16).reshape(-1, 4)
        if len(starts) < len(parts):
            wide = np.add.reduceat(wide, np.searchsorted(parts, starts), axis=0)
        out[docs[starts], 0] = np.packbits(2 * wide > total[:, None].astype(np.int64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, np.bincount(owner, minlength=len(texts))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            prints, words = _prints_and_words(batch.column("text"))
            has = words > 0
            keep = pa.array(has)
            columns = [batch.column("row").filter(keep), batch.column("doc").filter(keep), *(pa.array(prints[has, k].view(np.int64)) for k in range(4)), pa.array(words[has] < SHORT)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc", *PRINT, "short"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc, f0, f1, f2, f3, short) of the documents that have words."""
    texts = numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "row").select("row", "doc", "text")
    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(_fingerprint_batches, f"row bigint, doc {kind}, {PRINT_SCHEMA}, short boolean")


# --- trie self-join ---


@dataclass(frozen=True)
class Rotation:
    """A reading order of the 64 word bits: from bit ``start`` on (counted from the highest) and around."""

    start: int
    width: int  # of the block that comes first
    errors: int  # that this block may hold
    allowed: tuple[int, ...]  # errors that the first d bits may hold


def rotations(n: int, budget: int) -> list[Rotation]:
    """One for each of ``m`` blocks; fewer, wider blocks for more fingerprints, as a wider one tells more apart.

    Block i may hold errors[i], with sum(errors + 1) = budget + 1. A pair within the budget keeps, in one rotation at least,
    within what its first block may hold, its first two, and so on (else the sums over some way around the ring would be too large).
    """
    m = min(budget + 1, 5 if n <= 1 << 28 else 4 if n <= 1 << 32 else 3)
    edges = [64 * i // m for i in range(m + 1)]
    errors = [(budget + 1) // m + (i < (budget + 1) % m) - 1 for i in range(m)]
    out = []
    for r in range(m):
        allowed, total = [0], -1
        for i in (*range(r, m), *range(r)):
            total += errors[i] + 1
            allowed += [total] * (edges[i + 1] - edges[i])
        out.append(Rotation(edges[r], edges[r + 1] - edges[r], errors[r], tuple(allowed)))
    return out


def _read(f0: np.ndarray, start: int) -> np.ndarray:
    """The bits in a rotation's order, highest first."""
    return (f0 << np.uint64(start)) | (f0 >> np.uint64(64 - start)) if start else f0


def _masks(depth: int, errors: int) -> np.ndarray:
    """Sets of bits that a fingerprint's path to a node may differ in: half of what a pair may."""
    return np.array([sum(1 << i for i in c) for k in range(-(-errors // 2) + 1) for c in combinations(range(depth), k)], dtype=np.uint64)


def _low_bit(x: np.ndarray) -> np.ndarray:
    return x & (~x + np.uint64(1))


@dataclass(frozen=True)
class Cut:
    """Where the tries are cut into tasks: at a depth, and nodes that are still ``large`` there (sorted; rotation << 32 | node) into pairs of their parts by the next ``bits``."""

    depth: int
    bits: int = 0
    large: tuple[int, ...] = ()


def node_rows(f0: np.ndarray, ways: list[Rotation], cut_at: Cut) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that each fingerprint is sent to: (index of the fingerprint, place).

    The paths of a near pair differ in k <= errors bits there. It meets at the node between: one of them turns the lower half of these
    bits, the other the rest, such that the lowest is 0 there. So each pair meets in one node of a rotation. Of a large node, a fingerprint goes to each pair of parts that has its
    own. A place holds rotation, pair of parts, node, and which bits were turned.
    """
    index, place = [], []
    depth, bits = cut_at.depth, cut_at.bits
    large = np.array(cut_at.large, dtype=np.uint64)
    for r, way in enumerate(ways):
        key = _read(f0, way.start)
        own = key >> np.uint64(64 - depth)
        masks = _masks(depth, way.errors)
        at = own[:, None] ^ masks[None, :]
        there = np.ones(at.shape, dtype=bool)
        if way.errors % 2:  # only the one that turns the lower half turns the greater one
            most = np.bitwise_count(masks) > way.errors // 2
            there[:, most] = (own[:, None] & _low_bit(masks[most])[None, :]) != 0
        rows, kind = np.nonzero(there)
        node = at[rows, kind]
        if len(large):
            split = np.isin(np.uint64(r << 32) | node, large)
            part = ((key >> np.uint64(64 - depth - bits)) & np.uint64((1 << bits) - 1))[rows[split]]
            other = np.arange(1 << bits, dtype=np.uint64)
            pair = np.minimum(part[:, None], other) << np.uint64(bits) | np.maximum(part[:, None], other)
            rows, kind, node = (np.concatenate([x[~split], np.repeat(x[split], 1 << bits)]) for x in (rows, kind, node))
            node |= np.concatenate([np.zeros(int((~split).sum()), np.uint64), pair.ravel()]) << np.uint64(16)
        index.append(rows)
        place.append(np.uint64(r << 48) | node << np.uint64(16) | kind.astype(np.uint64))
    return np.concatenate(index), np.concatenate(place).astype(np.int64)


def _meetings(depth: int, errors: int) -> tuple[np.ndarray, ...]:
    """Pairs of kinds that meet in a node: turned bits of the first and of the second, errors between them, and the bit that must be 0 in the node."""
    masks = _masks(depth, errors)
    first, second, k, low = [], [], [], []
    for i, x in enumerate(masks.tolist()):
        for j, y in enumerate(masks.tolist()):
            bits = x | y
            n = bits.bit_count()
            if x & y or n > errors or x.bit_count() != -(-n // 2) or (x and y and x.bit_length() > (y & -y).bit_length()):
                continue
            first.append(i)
            second.append(j)
            k.append(n)
            low.append(bits & -bits)
    return tuple(np.array(x, dtype=np.int64) for x in (first, second, k, low))


def _roots(place: np.ndarray, ways: list[Rotation], depth: int) -> tuple[np.ndarray, ...]:
    """Pairs of ranges of the sorted rows that start the descent: (a0, a1, b0, b1, error, rotation)."""
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    ends = np.r_[starts[1:], len(place)]
    has = place[starts]
    nodes = np.unique(has >> 16)
    out = []
    for r, way in enumerate(ways):
        mine = nodes[nodes >> 32 == r]
        first, second, k, low = _meetings(depth, way.errors)
        node, at = (x.ravel() for x in np.meshgrid(mine, np.arange(len(k)), indexing="ij"))
        ok = (node & low[at]) == 0
        node, at = node[ok], at[ok]
        x, y = node << 16 | first[at], node << 16 | second[at]
        i, j = (np.minimum(np.searchsorted(has, z), len(has) - 1) for z in (x, y))
        ok = (has[i] == x) & (has[j] == y)
        i, j, at = i[ok], j[ok], at[ok]
        out.append((starts[i], ends[i], starts[j], ends[j], k[at], np.full(len(i), r)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def trie_pairs(
    place: np.ndarray, f0: np.ndarray, runs: np.ndarray, ways: list[Rotation], depth: int, budget: int, budget_runs: int, forest: list[np.ndarray] | None = None, short: np.ndarray | None = None, seen: Counter | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices of near fingerprints that meet in a node. Rows are sorted by ``place``, and by their bits in the rotation's order within.

    Nodes below are ranges of the sorted rows. Pairs of nodes of a depth are advanced together: their children differ in the next bit or
    don't, and a pair that differs in more bits than its depth allows is dropped. Where so many pairs are alive that they would take
    memory, one half waits. With a ``forest``, whose first item holds the root of each row and is kept up by the caller, pairs of leaves that already lie in one
    tree are skipped. ``short`` tells which rows' texts are very short. ``seen`` counts node pairs that were ``visited`` and ``pruned`` by the budget, and pairs of members that were ``compared``.
    """
    seen = Counter() if seen is None else seen
    allowed = np.array([w.allowed for w in ways])
    start = np.array([w.start for w in ways], dtype=np.uint64)[place >> 48]
    bits = np.where(start > 0, f0 << start | f0 >> (np.uint64(64) - np.maximum(start, np.uint64(1))), f0)
    a0, a1, b0, b1, error, way = _roots(place, ways, depth)
    alive = (a0 != b0) | (a1 - a0 > 1)
    todo = [(depth, *(x[alive] for x in (a0, a1, b0, b1)), error[alive].astype(np.int8), way[alive].astype(np.int8))]
    while todo:
        d, a0, a1, b0, b1, error, way = todo.pop()
        seen["visited"] += len(a0)
        same = a0 == b0
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (d == 64)
        if small.any():
            yield from _leaf_pairs(a0[small], a1[small], b0[small], b1[small], same[small], f0, runs, budget, budget_runs, forest, short, seen)
        go = ~small
        if not go.any():
            continue
        a0, a1, b0, b1, error, way, same = a0[go], a1[go], b0[go], b1[go], error[go], way[go], same[go]
        if len(a0) > NODE_PAIRS:
            half = len(a0) // 2
            todo += [(d, *(x[k] for x in (a0, a1, b0, b1, error, way))) for k in (slice(half), slice(half, None))]
            continue
        ones = np.r_[0, np.cumsum(((bits >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64))]
        am = a1 - (ones[a1] - ones[a0])  # the 1s of a range come last
        bm = b1 - (ones[b1] - ones[b0])
        cross = ~same
        a0, a1, b0, b1, error, way = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[cross]),
                (am, a1, am, a1[cross]),
                (b0, bm, bm, b0[cross]),
                (bm, b1, b1, bm[cross]),
                (error, error, error + np.int8(1), error[cross] + np.int8(1)),
                (way, way, way, way[cross]),
            )
        )
        full = (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))
        within = error <= allowed[way, d + 1]
        seen["pruned"] += int((full & ~within).sum())
        alive = full & within
        if alive.any():
            todo.append((d + 1, *(x[alive] for x in (a0, a1, b0, b1, error, way))))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The members of ranges, one after the other."""
    return np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _one_tree(root: np.ndarray, a0, a1, b0, b1) -> np.ndarray:
    """Which pairs of ranges have a single root."""

    def ends(lo, hi):
        n = hi - lo
        roots, at = root[_spread(lo, n)], np.cumsum(n) - n
        return np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)

    (al, ah), (bl, bh) = ends(a0, a1), ends(b0, b1)
    return (al == ah) & (bl == bh) & (al == bl)


def _near(i, j, f0, runs, budget_runs, short) -> tuple[np.ndarray, np.ndarray]:
    """Those of pairs within the budget of word bits that are near."""
    d = np.bitwise_count(runs[i] ^ runs[j]).sum(axis=1, dtype=np.int64)
    near = d <= budget_runs
    if short is not None:
        near &= (d <= BUDGET_RUNS_SHORT) | ~(short[i] | short[j]) | (np.bitwise_count(f0[i] ^ f0[j]) <= BUDGET_SHORT)
    return i[near], j[near]


def _leaf_pairs(a0, a1, b0, b1, same, f0, runs, budget, budget_runs, forest, short, seen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    # equal fingerprints can't be told apart by the trie: strips of a large range
    strip = np.maximum(1, CHUNK_PAIRS // (b1 - b0))
    pieces = -(-(a1 - a0) // strip)
    if (pieces > 1).any():
        which = np.repeat(np.arange(len(a0)), pieces)
        k = _spread(np.zeros(len(a0), np.int64), pieces)
        lo = a0[which] + k * strip[which]
        a0, a1, b0, b1, same = lo, np.minimum(lo + strip[which], a1[which]), b0[which], b1[which], same[which]
    total = np.cumsum((a1 - a0) * (b1 - b0))
    first = 0
    while first < len(total):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + LOOK_PAIRS, side="right")))
        at = np.arange(first, last)
        first = last
        if forest:
            at = at[~_one_tree(forest[0], a0[at], a1[at], b0[at], b1[at])]
        seen["compared"] += int(((a1[at] - a0[at]) * (b1[at] - b0[at])).sum())
        found, n = [], 0
        for p, q, r, s, own in zip(a0[at].tolist(), a1[at].tolist(), b0[at].tolist(), b1[at].tolist(), same[at].tolist(), strict=True):
            hits = np.flatnonzero(np.bitwise_count(f0[p:q, None] ^ f0[None, r:s]).ravel() <= budget)
            i, j = np.divmod(hits, s - r)
            i, j = i + p, j + r
            if own:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            n += len(i)
            if n >= CHUNK_PAIRS:
                yield _near(*(np.concatenate(x) for x in zip(*found, strict=True)), f0, runs, budget_runs, short)
                found, n = [], 0
        if n:
            yield _near(*(np.concatenate(x) for x in zip(*found, strict=True)), f0, runs, budget_runs, short)


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of a forest, least members, after joining the trees of i and j pairwise."""
    while True:
        root = root.copy()
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return root
        x, y, i, j = x[apart], y[apart], i[apart], j[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _expand(ways: list[Rotation], cut_at: Cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 5_000):
                batch = whole.slice(start, 5_000)
                f0 = batch.column("f0").to_numpy(zero_copy_only=False).view(np.uint64)
                index, place = node_rows(f0, ways, cut_at)
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays([pa.array(place), *(batch.column(c).take(take) for c in (*PRINT, "vs"))], ["place", *PRINT, "vs"])

    return run


def _join(ways: list[Rotation], depth: int, budget: int, budget_runs: int):
    starts = np.array([w.start for w in ways], dtype=np.uint64)

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        place, f0, *runs, vs = rows
        f0, at = f0.view(np.uint64), starts[place >> 48]
        order = np.lexsort((np.where(at > 0, f0 << at | f0 >> (np.uint64(64) - np.maximum(at, np.uint64(1))), f0), place))
        place, f0, v, short = place[order], f0[order], vs[order] >> 1, (vs[order] & 1).astype(bool)
        runs = np.stack([x[order].view(np.uint64) for x in runs], axis=1)
        # rows of one fingerprint, in different nodes, are one tree
        _, inverse = np.unique(v, return_inverse=True)
        first = np.full(inverse.max() + 1, len(v))
        np.minimum.at(first, inverse, np.arange(len(v)))
        forest = [first[inverse]]
        for i, j in trie_pairs(place, f0, runs, ways, depth, budget, budget_runs, forest, short):
            forest[0] = _joined(forest[0], i, j)
        both = np.stack([v[forest[0]], v], axis=1)
        both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:  # sorted by place; whole nodes are joined
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", *PRINT, "vs")])
            n += batch.num_rows
            if n < CHUNK_ROWS or held[0][0][0] >> 16 == held[-1][0][-1] >> 16:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(rows[0], rows[0][-1] >> 16 << 16))  # the last node may go on
            yield pairs([x[:end] for x in rows])
            held = [[x[end:] for x in rows]]
            n = len(held[0][0])
        if n:
            yield pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def plan_cut(prints: DataFrame, n: int, ways: list[Rotation], node_rows: int = NODE_ROWS) -> Cut:
    """The least depth, from MIN_DEPTH on, at which no node is sent more than ``node_rows`` fingerprints. If some are down to the depth that is counted, they are split into parts such that a pair of even parts isn't."""
    deep = min(COUNT_DEPTH, *(w.width for w in ways))
    depth = min(MIN_DEPTH, deep)
    if n <= node_rows:  # no node can have more
        return Cut(depth)
    prefix = [F.struct(F.lit(r).alias("r"), F.shiftrightunsigned(F.shiftleft("f0", w.start).bitwiseOR(F.shiftrightunsigned("f0", 64 - w.start) if w.start else F.lit(0).cast("bigint")), 64 - deep).alias("node")) for r, w in enumerate(ways)]
    # a row for each node at most: len(ways) * 2**COUNT_DEPTH
    counts = np.zeros((len(ways), 1 << deep), dtype=np.int64)
    for row in prints.select(F.explode(F.array(*prefix)).alias("p")).groupBy("p.r", "p.node").count().collect():
        counts[row["r"], row["node"]] = row["count"]
    while True:
        at, node = counts.reshape(len(ways), 1 << depth, -1).sum(2), np.arange(1 << depth)
        sent = np.stack([sum(at[r][node ^ int(x)] for x in _masks(depth, w.errors)) for r, w in enumerate(ways)])
        if sent.max() <= node_rows:
            return Cut(depth)
        if depth == deep:
            bits = min(MOST_PART_BITS, max(1, int(np.ceil(np.log2(2 * sent.max() / node_rows)))))
            return Cut(depth, bits, tuple(int(r) << 32 | int(v) for r, v in np.argwhere(sent > node_rows)))
        depth += 1


def near_edges(prints: DataFrame, budget: int = BUDGET, budget_runs: int = BUDGET_RUNS) -> DataFrame:
    """Edges (a, b) between ``v`` of distinct rows (v, f0 .. f3, short), with the same connected components as all near pairs.

    A task passes on one edge for each fingerprint that a near pair of its nodes joins to another, and doesn't compare what
    it has joined before, so that a group of thousands of near copies costs thousands of rows, not millions.
    """
    n = prints.count()
    ways = rotations(n, budget)
    at = plan_cut(prints, n, ways)
    rows = prints.select(*PRINT, (F.col("v") * 2 + F.col("short").cast("bigint")).alias("vs")).mapInArrow(_expand(ways, at), f"place bigint, {PRINT_SCHEMA}, vs bigint")
    return rows.repartition(F.shiftright("place", 16)).sortWithinPartitions("place").mapInArrow(_join(ways, at.depth, budget, budget_runs), "a bigint, b bigint").distinct()


# --- groups ---


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        vertices, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _joined(np.arange(len(vertices)), index[: len(a)], index[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(vertices[root])], ["v", "root"])


def connected(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(v, root) for each vertex of edges (a, b): the least vertex that it is connected with. Up to ``one_task`` edges, counted, are joined by one task (some tens of MB); more by alternating large and small stars, in a logarithmic number of rounds."""
    edges = cut(edges.select("a", "b"))
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_union, "v bigint, root bigint")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a")
        edges = cut(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        seen = now


def _judged(docs: DataFrame, id_col: str, text_col: str, budget: int, budget_runs: int) -> DataFrame:
    """(row, doc, canonical, is_kept) of documents that have a near duplicate."""
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy(*PRINT).agg(F.min("row").alias("v"), F.count("*").alias("n"), F.bool_and("short").alias("short")))
    edges = near_edges(distinct, budget, budget_runs)
    alone = distinct.where("n > 1").select(F.col("v"), F.col("v").alias("root"))
    roots = connected(edges).unionByName(alone).groupBy("v").agg(F.min("root").alias("root"))
    grouped = prints.join(distinct.join(roots, "v").select(*PRINT, "root"), PRINT).select("row", "doc", "root")
    grouped = cut(grouped)
    firsts = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first"))
    return grouped.join(firsts, "root").select("row", "doc", F.col("first.doc").alias("canonical"), (F.col("row") == F.col("first.row")).alias("is_kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, budget_runs: int = BUDGET_RUNS) -> DataFrame:
    """For each document (doc_id, canonical_id, is_kept): the least id in its group of near duplicates, and whether it is the one that stays.

    Groups are the connected components of near pairs. Nulls and texts without a word have no fingerprint: such a
    row is its own group and stays. A null id counts as the greatest. Long texts count whole. Ties: of repeated
    rows, exactly one stays. An empty table gives an empty result. Other columns are not read.
    """
    docs = repeatable(docs.select(id_col, text_col))
    judged = _judged(docs, id_col, text_col, budget, budget_runs).select("row", "canonical", "is_kept")
    every = numbered(docs.select(F.col(id_col).alias("doc_id")), "row")
    return every.join(judged, "row", "left").select("doc_id", F.when(F.col("is_kept").isNull(), F.col("doc_id")).otherwise(F.col("canonical")).alias("canonical_id"), F.coalesce("is_kept", F.lit(True)).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, budget_runs: int = BUDGET_RUNS) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; same columns. Edge cases as in :func:`near_duplicates`."""
    docs = repeatable(docs)
    return without_rows(docs, fresh(docs, "row"), _judged(docs, id_col, text_col, budget, budget_runs).where("not is_kept").select("row"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
