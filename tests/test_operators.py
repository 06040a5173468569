"""Operators on small odd inputs, and invariants."""

from __future__ import annotations

import bz2
import gzip
import json
import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as X
from scriptorium.functions.fuzzy import partial_ratio_of
from scriptorium.operators import joins, ordering, quality, retrieval, sampling
from scriptorium.sources import readers, sinks
from scriptorium.streaming import ingest


def one(spark, column, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


def on(spark, f, text):
    return one(spark, f(F.col("x")), row=(text,))


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (X.clean_encoding, "a\0\x85“b”’–—", 'a"b"\'---'),
        (X.strip_html, " <p>a</p>  b<br/>", "a b"),
        (X.remove_boilerplate, "Not Reported in F.3d\nx\n*12\ny", "x y"),
        (X.citation_count, "347 U.S. 483, 12 F.3d 9, F.3d", 2),
        (X.paragraph_count, "a\n\n \n\nb", 2),
        (X.paragraph_count, "", 1),
        (X.year, "2020-01-01", "2020"),
        (X.year, "nan", "unknown"),
        (X.year, None, "unknown"),
        (X.normalize_timestamp, "on 2024-01-02T03:04:05Z.", "2024-01-02T03:04:05Z"),
        (X.normalize_timestamp, "2024-01-02T03:04:05+0200", "2024-01-02T03:04:05+02:00"),
        (X.normalize_timestamp, "2024-01-02T03:04:05.5Z", ""),
        (X.normalize_timestamp, "2024-13-02", ""),
        (X.normalize_timestamp, "none", ""),
        (X.strip_citations, "see 347 U.S. 483 (1954), id. at 5", "see , at 5"),
        (X.strip_citations, None, ""),
        (X.parse_verdict, "not faithful", "FAITHFUL"),
        (X.parse_verdict, "unfaithful", "UNKNOWN"),
        (X.parse_verdict, None, "UNKNOWN"),
        (X.char_entropy, "", 0.0),
        (X.char_entropy, "aabb", 1.0),
        (X.word_entropy, "a b a b", 1.0),
    ],
)
def test_text_functions(spark, f, text, want):
    got = on(spark, f, text)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab é\n", max_size=40))
def test_entropies_against_counts(spark, text):
    def bits(items):
        n = sum(items.values())
        return -sum(c / n * math.log2(c / n) for c in items.values()) if n else 0.0

    assert on(spark, X.char_entropy, text) == pytest.approx(bits(Counter(text)), abs=1e-9)
    assert on(spark, X.word_entropy, text) == pytest.approx(bits(Counter(text.split())), abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 28, 29, 100])
def test_chunks_cover_and_overlap(spark, n):
    words = [str(i) for i in range(n)]
    got = one(spark, X.chunks(F.col("x"), 16, 4), "x array<string>", (words,))
    want, start = [], 0
    while n and True:
        want.append(words[start : start + 16])
        if start + 16 >= n:
            break
        start += 12
    assert got == want
    parts = one(spark, X.passages(F.col("x"), 8), "x array<string>", (words,))
    assert " ".join(parts) == " ".join(words) and len(parts) == min(8, n)


def test_spans(spark):
    spans = [(5, 7), (0, 2), (1, 4), (8, 9)]
    kind = "x string, s array<struct<start:int,stop:int>>"
    assert one(spark, X.mask_spans(F.col("x"), F.col("s"), "#"), kind, ("0123456789", spans)) == "#4#7#9"
    assert one(spark, X.mask_spans(F.col("x"), F.col("s"), "#", 1), kind, ("0123456789", spans)) == "#9"
    assert one(spark, X.mask_spans(F.col("x"), F.col("s"), "#"), kind, ("abc", [])) == "abc"


def test_normalize_flags(spark):
    r = spark.createDataFrame([("<b>“a”</b>\n\n\n\nb ", "html"), ("plain", "plain_text")], "x string, s string")
    r = X.normalize(r, "x", "s").collect()
    assert (r[0].x, r[0].cleaning_flags) == ('"a" \n\nb', ["encoding_cleaned", "html_stripped", "newlines_collapsed", "whitespace_trimmed"])
    assert (r[1].x, r[1].cleaning_flags) == ("plain", [])


def test_partial_ratio():
    assert partial_ratio_of("abc", "xxabcxx") == 100
    assert partial_ratio_of("", "x") == partial_ratio_of(None, "x") == 0
    assert 60 < partial_ratio_of("abcdefgh", "xxabcdXfghxx") < 100


def brute_partial_ratio(a, b):
    """All windows, by the textbook table of the longest common subsequence."""
    short, long = sorted((a, b), key=len)
    best = 0
    for p in range(len(long) - len(short) + 1):
        row = [0] * (len(short) + 1)
        for c in long[p : p + len(short)]:
            before = row[:]
            for i, d in enumerate(short):
                row[i + 1] = before[i] + 1 if c == d else max(before[i + 1], row[i])
        best = max(best, row[-1])
    return 100 * best / len(short) if short else 0.0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=20), st.text(alphabet="abc ", min_size=1, max_size=40))
def test_partial_ratio_of_short_texts(a, b):
    assert partial_ratio_of(a, b) == pytest.approx(brute_partial_ratio(a, b))


def test_partial_ratio_of_planted_quotes():
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8)))
    for k in range(24):
        quote = " ".join(word() for _ in range(14))
        edited = list(quote)
        for _ in range(int(len(quote) * (0.02 + 0.01 * (k % 16)))):
            i = rng.randrange(len(edited))
            edited[i : i + 1] = rng.choice([[], ["z"], [edited[i], "y"]])
        text = " ".join(word() for _ in range(20)) + " " + "".join(edited) + " " + " ".join(word() for _ in range(20))
        want, got = brute_partial_ratio(quote, text), partial_ratio_of(quote, text)
        assert got <= want + 1e-9 and got > want - 3
        assert (got >= 80) == (want >= 80) or abs(want - 80) < 3
    assert partial_ratio_of(" ".join(word() for _ in range(30)), " ".join(word() for _ in range(300))) < 70


def test_equal_frequencies_are_head(spark):
    f = spark.createDataFrame([(i, 3) for i in range(7)], "k int, n int")
    assert {r.bucket for r in ordering.frequency_buckets(f, "k", "n").collect()} == {"head"}
    f = spark.createDataFrame([(i, i) for i in range(7)], "k int, n int")
    assert [r.bucket for r in ordering.frequency_buckets(f, "k", "n").orderBy("k").collect()] == ["tail"] * 3 + ["torso"] * 2 + ["head"] * 2
    assert [r.bucket for r in ordering.frequency_buckets(f, "k", "n", 2).orderBy("k").collect()] == ["tail"] * 4 + ["head"] * 3
    with pytest.raises(ValueError):
        ordering.frequency_buckets(f, "k", "n", 4)


def test_histogram_of_one_value(spark):
    assert [(r.bin, r.n) for r in ordering.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double"), "v").collect()] == [(0, 2)]


def test_entropy_holds_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["ab\u0142" * 10_000] * 500 + [None, ""])  # 20 MB
    tracemalloc.start()
    got = X._entropies(texts).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [pytest.approx(math.log2(3))] * 500 + [0.0, 0.0] and most < 2e6


@pytest.mark.parametrize("block", [3, 4096])
def test_dense_blocks_against_brute_force(spark, block):
    import numpy as np

    rng = np.random.default_rng(3)
    v, q = rng.integers(-2, 3, size=(40, 6)).astype(float), rng.integers(-2, 3, size=(7, 6)).astype(float)  # many ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "doc_id bigint, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "query_id string, query_vector array<double>").repartition(2)
    for k in (1, 5, 100):
        got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.dense(vectors, queries, k, block).collect()}
        want = {(f"q{i}", n + 1): (d, s) for i, x in enumerate(q) for n, (s, d) in enumerate(sorted(((float(x @ y), d) for d, y in enumerate(v)), key=lambda p: (-p[0], p[1]))[:k])}
        assert got == want
    assert retrieval.dense(vectors, queries.limit(0), 3, block).count() == 0 == retrieval.dense(vectors.limit(0), queries, 3, block).count()


def test_dense_products_are_bounded(spark):
    import tracemalloc

    import numpy as np

    docs, asked = (np.random.default_rng(i).normal(size=(4096, 8)) for i in (1, 2))
    tracemalloc.start()
    parts = list(retrieval._products(asked, docs, 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6  # all scores are 134 MB
    want = np.sort(asked @ docs.T, axis=1)[:, :-4:-1]
    got = {}
    for q, _, s in parts:
        for i, x in zip(q.tolist(), s.tolist()):
            got.setdefault(i, []).append(x)
    assert np.allclose([sorted(got[i])[:-4:-1] for i in range(4096)], want)
    wide = spark.createDataFrame([(i, [float(i)] * 20_000) for i in range(40)], "doc_id int, vector array<double>").coalesce(1)
    rows = retrieval._blocks(wide, "doc_id", "vector", 4096).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(40)) and max(len(r.data) for r in rows) <= 8 * retrieval.BLOCK_TERMS


@pytest.mark.parametrize("ties", [1, 3])
def test_dense_of_many_equal_vectors(spark, ties):
    vectors = spark.createDataFrame([(i, [1.0, float(i % ties)]) for i in range(500)], "doc_id bigint, vector array<float>").repartition(2)
    queries = spark.createDataFrame([(q, [0.0, 1.0]) for q in range(3)], "query_id int, query_vector array<float>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.dense(vectors, queries, 4).collect()}
    assert got == {(q, n + 1): n * ties + ties - 1 for q in range(3) for n in range(4)}


_BM25_DOCS = ["the cat sat on a mat", "Cat CAT dog", "", None, "été À la mer", "dog dog dog dog mer", "zebra " * 40 + "cat", "of the and", "Cat CAT dog"]
_BM25_QUERIES = ["cat dog cat", "the of", "ÉTÉ mer zebra", None, "unknown words", "mat cat sat mer"]


def _bm25(docs, queries, k):
    terms = lambda x: [w for w in __import__("re").findall(X.TERM, (x or "").lower()) if w not in retrieval.STOPWORDS]
    tfs = [Counter(terms(x)) for x in docs]
    mean = sum(x.total() for x in tfs) / len(docs)
    out = {}
    for q, text in enumerate(queries):
        scored = []
        for d, tf in enumerate(tfs):
            parts = [n * math.log(1 + (len(docs) - (df := sum(w in x for x in tfs)) + 0.5) / (df + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * tf.total() / mean)) for w, n in Counter(terms(text)).items() if tf[w]]
            if parts:
                scored.append((-round(sum(parts), 6), d))
        out |= {(q, i + 1): (d, pytest.approx(-x, abs=2e-6)) for i, (x, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("small", [{}, {"VOCABULARY": 2}, {"BLOCK_ROWS": 2}, {"BLOCK_TERMS": 3, "CELLS": 4}])
def test_bm25_blocks_against_brute_force(spark, monkeypatch, small):
    for name, n in small.items():
        monkeypatch.setattr(retrieval, name, n)
    docs = spark.createDataFrame(list(enumerate(_BM25_DOCS)), "doc_id bigint, text string").repartition(2)
    queries = spark.createDataFrame(list(enumerate(_BM25_QUERIES)), "query_id int, text string")
    for k in (1, 3, 20):
        got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25(docs, queries, k).collect()}
        assert got == _bm25(_BM25_DOCS, _BM25_QUERIES, k)
    assert retrieval.bm25(docs, queries.limit(0), 3).count() == 0 == retrieval.bm25(docs.limit(0), queries, 3).count()


def test_bm25_shuffles_only_the_best_of_blocks(spark):
    docs = spark.createDataFrame([(i, f"cat dog w{chr(97 + i % 26)}") for i in range(3000)], "doc_id bigint, text string").coalesce(1)
    queries = spark.createDataFrame([(q, "cat dog wa") for q in range(5)], "query_id int, text string")
    top = retrieval.bm25(docs, queries, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    assert top.count() == 10


def test_splits_sort_only_what_they_take(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("stratum"))
    out = sampling.stratified_split(df, "stratum", "id", 60, 40, "s")
    assert out.count() == 20_000 and out.columns == ["id", "stratum", "fold"]
    want = {}
    for s in ("small", "large"):
        mine = [r.id for r in df.where(F.col("stratum") == s).orderBy(ordering.hashed("s", "id"), "id").limit(100).collect()]
        n = 6 if s == "small" else 54
        want |= dict.fromkeys(mine[:n], "val") | dict.fromkeys(mine[n : n + (5 if s == "small" else 35)], "test")
    assert {r.id: r.fold for r in out.where("fold != 'train'").collect()} == want
    near, _ = sampling._by_prefix(df, "stratum", "id", "s", spark.createDataFrame([("large", 30), ("small", 3)], "stratum string, _take int"))
    assert 33 <= near.count() < 60


def test_ranks_and_metrics(spark):
    run = spark.createDataFrame([(1, 10, 5.0), (1, 11, 5.0), (1, 12, 9.0), (2, 10, 1.0)], "query_id int, doc_id int, score double")
    ranked = retrieval.rank(run, 2)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in ranked.collect()} == {(1, 12, 1), (1, 10, 2), (2, 10, 1)}
    gold = spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "query_id int, gold int")
    ranks = retrieval.gold_ranks(gold, ranked)
    assert {(r.query_id, r["rank"]) for r in ranks.collect()} == {(1, 2), (2, 0), (3, 0)}
    m = ranks.agg(*retrieval.metrics((1, 10), (10,))).first()
    assert (m.hit_1, m.hit_10, m.mrr, m.ndcg_10) == (0.0, pytest.approx(1 / 3, abs=1e-5), pytest.approx(1 / 6, abs=1e-5), pytest.approx(1 / math.log2(3) / 3, abs=1e-5))
    with pytest.raises(Exception, match="rank below 1"):
        retrieval.reciprocal_rank_fusion([spark.createDataFrame([(1, 1, 0)], "query_id int, doc_id int, rank int")]).collect()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50), min_size=1, max_size=20))
def test_hits_grow_with_k(spark, ranks):
    m = spark.createDataFrame([(r,) for r in ranks], "rank int").agg(*retrieval.metrics((1, 5, 10, 100), (10,))).first()
    assert 0 <= m.hit_1 <= m.hit_5 <= m.hit_10 <= m.hit_100 <= 1
    assert m.hit_1 <= m.mrr + 1e-6 <= m.hit_100 + 2e-6


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=60), st.integers(0, 20), st.integers(0, 20))
def test_split_sizes(spark, strata, val, test):
    df = spark.createDataFrame(list(enumerate(strata)), "id int, part string")
    out = sampling.stratified_split(df, "part", "id", val, test, "s").collect()
    folds = Counter(r.fold for r in out)
    assert len(out) == len(strata) and folds["val"] <= val
    for s, n in Counter(strata).items():
        mine = Counter(r.fold for r in out if r.part == s)
        if n >= 2 and test > 0 and n > mine["val"]:
            assert mine["test"] >= 1


def test_group_split_has_no_leak(spark):
    df = spark.createDataFrame([(i, i % 37) for i in range(500)] + [(501, None)], "id int, g int")
    out = df.join(sampling.group_split(df, "g", "s"), "g")
    assert sampling.leaks(out, "g").count() == 0
    assert Counter(r.fold for r in out.select("g", "fold").distinct().collect()) == {"train": 25, "val": 6, "test": 6}


@pytest.mark.parametrize(("n", "want"), [(90, (63, 13, 14)), (170, (119, 25, 26)), (180, (126, 27, 27))])
def test_group_split_cuts_at_decimal_shares(spark, n, want):
    folds = Counter(r.fold for r in sampling.group_split(spark.range(n), "id", "s").collect())
    assert (folds["train"], folds["val"], folds["test"]) == want


def test_positions_are_a_total_order(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = ordering.positions(df, [F.col("v"), F.col("id")], "p").orderBy("p").collect()
    assert [r.p for r in got] == list(range(1, 1001)) and [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)
    assert ordering.positions(df.limit(0), [F.col("v")], "p").count() == 0


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,), (3,)], "id int")
    o = joins.overlap(a, b).first()
    assert (o.n_left, o.n_right, o.n_both, o.n_either, o.max_left, o.max_right, o.pct, o.n_above) == (2, 2, 1, 3, 2, 3, 50.0, 0)
    assert joins.not_done(a, b, ["id"]).collect()[0].id == 1
    assert [r.n for r in joins.lookup(a, b.distinct().withColumn("v", F.lit("x")), "id", "id", "v", "n", "unknown").orderBy("id").collect()] == ["unknown", "x"]


def test_length_and_finite(spark):
    df = spark.createDataFrame([(float("nan"), "NaN"), (float("inf"), "x"), (1.0, None), (None, "y")], "v double, k string").withColumn("s", F.lit(0))
    assert quality.nan_audit(df, "s", ["v"], ["k"]).first().asDict() == {"s": 0, "n_rows": 4, "bad_v": 2, "bad_k": 1, "verdict": "HARD_FAILURE"}
    fixed = quality.nan_repair(df, ["v"], ["k"])
    assert quality.nan_audit(fixed, "s", ["v"], ["k"]).first().verdict == "CLEAN"
    off = spark.createDataFrame([(1000, 1050), (1000, 1060), (10000, 9799), (None, 5)], "a int, b int").select(quality.length_off(F.col("a"), F.col("b")).alias("o")).collect()
    assert [r.o for r in off] == [False, True, True, True]


# --- sources, sinks, streams ---


def test_csv(spark, tmp_path):
    text = 'id,name,note\n1,"a \\"q\\"\nline",x\n2,short\n3,too,many,fields\n'
    (tmp_path / "a.csv.bz2").write_bytes(bz2.compress(text.encode()))
    got = readers.read_csv(spark, str(tmp_path / "a.csv.bz2"), ["id", "name", "note"], ["id", "name"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("1", 'a "q"\nline'), ("2", "short")]
    assert readers.has_columns(got, ["id"]) and not readers.has_columns(got, ["zip"])


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2\n{"id": 3}\n')
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert sorted(r.id for r in readers.read_jsonl(spark, str(tmp_path), schema).collect()) == [1, 3]
    a = readers.audit_jsonl(spark, str(tmp_path)).first()
    assert (a.n_lines, a.n_blank, a.n_decoded, a.n_errors) == (4, 1, 2, 1)


def test_csv_by_names_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('note,id,name\nx,1,"a, \\"b\\", c"\n,2,\nz,3,too,\nz,4,too,,\ny\n"multi\nline, here",6,w,more\n"multi\nline, here",7,w\n')
    read = lambda **k: {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), ["id", "name", "note"], **k).collect()}
    kept = {("1", 'a, "b", c', "x"), ("2", None, None), (None, None, "y"), ("7", "w", "multi\nline, here")}
    assert read() == kept
    assert read(ragged="truncate") == kept | {("3", "too", "z"), ("4", "too", "z"), ("6", "w", "multi\nline, here")}
    assert readers.csv_has_columns(spark, str(tmp_path / "a.csv"), ["id", "note"]) and not readers.csv_has_columns(spark, str(tmp_path / "a.csv"), ["zip"])
    assert not readers.csv_has_columns(spark, str(tmp_path / "none.csv"), ["id"])
    with pytest.raises(ValueError, match="zip"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), ["zip"])
    (tmp_path / "b.csv").write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(100)))
    assert readers.read_csv(spark, str(tmp_path / "b.csv"), multi_line=False).count() == 100


LINES = [
    ('{"id": 1, "case_name": NaN, "p": {"k": [1, -Infinity]}}', (True, ["case_name", "p"], True, False, '{"id": 1, "case_name": null, "p": {"k": [1, null]}}', True)),
    ('{"t": "it is NaN, \\"NaN\\" or Infinity", "u": "nan-x"}', (True, [], False, False, None, False)),
    ('{"a": ["NaN"], "b": {"c": "-Inf"}}', (True, ["a", "b"], False, True, None, False)),
    ('{"a": 1} trailing', (False, [], False, False, None, False)),
    ("1, 2", (False, [], False, False, None, False)),
    ('{"a": 1}] [2', (False, [], False, False, None, False)),
    ('1, "§§ end of value §§"] x', (False, [], False, False, None, False)),
    ('{"a": 1', (False, [], False, False, None, False)),
    ('{"a": 1e999, "b": 1e-999}', (True, ["a"], True, False, '{"a": null, "b": 0.0}', True)),
    ('[NaN, {"x": 1}]', (True, [], True, False, '[null, {"x": 1}]', True)),
    ('{"caf\u00e9": "\u00fc", "n": null}', (True, [], False, False, None, False)),
    ("7", (True, [], False, False, None, False)),
    ('{"a": "\\u004eaN", "info": "financial infinity"}', (True, ["a"], False, True, None, False)),
    ('{"a": -Infinity}', (True, ["a"], True, False, '{"a": null}', True)),
    ('{"a": 2' + "0" * 400 + '}', (True, [], False, False, None, False)),  # a whole number, however large
    ('{"a": 2' + "0" * 400 + '.0}', (True, ["a"], True, False, '{"a": null}', True)),
]


def test_findings_of_json_lines(spark):
    from scriptorium.functions import jsonlines

    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "i int, line string")
    got = {r.i: r for r in df.select("i", jsonlines.findings(F.col("line")).alias("f")).select("i", "f.*").collect()}
    for i, (line, want) in enumerate(LINES):
        assert (got[i].decoded, got[i].fields, got[i].nonfinite, got[i].sentinel, got[i].repaired, got[i].changed) == (*want[:4], want[4] or line, want[5])
    fixed = jsonlines.repair(df, "line")
    assert not any(r.changed for r in jsonlines.repair(fixed.drop("changed"), "line").collect())  # once is enough
    assert jsonlines.repair(spark.createDataFrame([(None,)], "line string"), "line").first().line is None


def test_json_audit_verdicts(spark):
    from scriptorium.functions import jsonlines

    rows = [("a", x) for x in ('{"id": 1}', "", "  ", '{"case_name": NaN}', '{"case_name": "NaN", "raw_text": [Infinity]}')] + [("b", '{"id": 1}'), ("c", '{"id": NaN, "case_name": NaN}'), ("d", '{"id": 1'), ("d", '{"case_name": NaN}')]
    shards = jsonlines.audit(spark.createDataFrame(rows, "s string, line string"), "s", "line")
    got = {r.shard: (r.total_lines, r.nan_lines, r.nonfinite_lines, r.sentinel_lines, r.decode_errors, r.fields) for r in shards.collect()}
    assert got == {"a": (3, 2, 2, 1, 0, {"case_name": 2, "raw_text": 1}), "b": (1, 0, 0, 0, 0, {}), "c": (1, 1, 1, 0, 0, {"case_name": 1, "id": 1}), "d": (2, 2, 1, 0, 1, {"case_name": 1})}
    verdicts = {r.shard: r.v for r in shards.select("shard", jsonlines.verdict(F.col("nan_lines"), F.col("decode_errors"), F.col("fields")).alias("v")).collect()}
    assert verdicts == {"a": "REPAIRABLE", "b": "CLEAN", "c": "HARD_FAILURE", "d": "PARSE_FAILURE"}
    whole = jsonlines.health(shards).first()
    assert (whole.total_shards, whole.nan_shards, whole.contaminated, whole.total_lines, whole.verdict, whole.fields) == (4, 3, ["a", "c", "d"], 7, "PARSE_FAILURE", {"case_name": 4, "id": 1, "raw_text": 1})
    none = jsonlines.health(shards.limit(0)).first()
    assert (none.total_shards, none.contaminated, none.verdict) == (0, [], "CLEAN")


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.floats(), st.integers(-9, 9), st.sampled_from(["NaN", "x", "Inf y"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=12))
def test_repaired_lines_are_strict(value):
    from scriptorium.functions import jsonlines

    line = json.dumps(value)
    decoded, _, nonfinite, _, fixed, changed = jsonlines.findings_of(line)
    assert decoded and nonfinite == changed == bool([x for x in ("NaN", "Infinity") if x in json.dumps(value).replace('"NaN"', "")])

    def refuse(x):
        raise AssertionError(x)

    json.loads(fixed, parse_constant=refuse)
    assert jsonlines.findings_of(fixed)[2:] == (False, jsonlines.findings_of(line)[3], fixed, False)


def test_ids_pairs_and_maps(spark, tmp_path):
    (tmp_path / "ids.gz").write_bytes(gzip.compress(b"12\n7\n"))
    assert sorted(r.id for r in readers.read_ids(spark, str(tmp_path / "ids.gz")).collect()) == [7, 12]
    for bad in ("007", "+1", "0", "1.5", "-3"):
        (tmp_path / "bad").write_text(f"1\n{bad}\n")
        with pytest.raises(Exception, match="line 2 is not an id"):
            readers.read_ids(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "pairs").write_text('{"source_id": 1, "dest_id": 2}\n')
    assert readers.read_pairs(spark, str(tmp_path / "pairs")).first() == (1, 2)
    (tmp_path / "pairs").write_text('{"source_id": 1.0, "dest_id": true}\n')
    with pytest.raises(Exception, match="no whole number"):
        readers.read_pairs(spark, str(tmp_path / "pairs")).collect()
    for bad in ('{"source_id": 1, "dest_id": 2} x', "no json", '{"source_id": 1}', '{"source_id": "1", "dest_id": 2}'):
        (tmp_path / "pairs").write_text(bad + "\n")
        with pytest.raises(Exception, match="not JSON|no whole number"):
            readers.read_pairs(spark, str(tmp_path / "pairs")).collect()
    (tmp_path / "map.json").write_text(json.dumps({"1": "x", "2": "y"}))
    assert {tuple(r) for r in readers.read_map(spark, str(tmp_path / "map.json")).collect()} == {("1", "x"), ("2", "y")}
    assert readers.read_map(spark, str(tmp_path / "none.json")).count() == 0
    files = spark.createDataFrame([("a", "2024-01-01", "p1"), ("a", "2024-02-01", "p2")], "label string, day string, path string")
    assert readers.latest_per_prefix(files, "label", "day", "path").first().path == "p2"


def test_source_guards():
    readers.check_source("hub", "a" * 40)
    for bad in (("hub", "main", False), ("artifact", None, True), ("other", None, False)):
        with pytest.raises(ValueError):
            readers.check_source(*bad)
    names = [f"s{i:02d}" for i in range(40)]
    assert readers.pick_shards(names) == names and readers.pick_shards(names, "head") == names[:3] and len(readers.pick_shards(names, "sample")) == 8
    assert readers.pick_shards([], "sample") == []


def test_shards_and_manifest(spark, tmp_path):
    df = spark.range(25).withColumn("k", F.col("id") % 2)
    sinks.write_shards(df.coalesce(1), f"{tmp_path}/d", rows=10)
    manifest = sinks.write_manifest(spark, f"{tmp_path}/d", df.groupBy(F.lit("k").alias("field"), F.col("k").alias("value")).agg(F.count("*").alias("n")), seed="1")
    assert len(manifest["files"]) == 3 and manifest["counts"] == {"k": {"0": 13, "1": 12}}
    assert sinks.verify_manifest(spark, f"{tmp_path}/d", manifest).count() == 0
    first = sorted(p for p in (tmp_path / "d").iterdir() if p.name.startswith("part-"))[0]
    first.rename(first.with_name("part-other.parquet"))
    assert {r.state for r in sinks.verify_manifest(spark, f"{tmp_path}/d", manifest).collect()} == {"missing", "unlisted"}
    made = sinks.ingest(df, f"{tmp_path}/j", cap=25)
    assert made["rows"] == 25 and sinks.ingest(df, f"{tmp_path}/j", verify_only=True)["same"]
    assert not sinks.ingest(df.limit(20), f"{tmp_path}/j", verify_only=True)["same"]


def test_landing_is_idempotent_and_heals(spark, tmp_path):
    import pathlib

    df, path, source = spark.range(50).coalesce(2), f"{tmp_path}/landed", {"dataset": "d", "revision": "a" * 40}
    assert sinks.land(df, path, 30, source, dry_run=True) == {"rows_written": 30} and not (tmp_path / "landed").exists()
    with pytest.raises(FileNotFoundError):
        sinks.land(df, path, 30, source, verify_only=True)
    made = sinks.land(df, path, 30, source)
    assert made["rows_written"] == 30 and sinks.land(df, path, 30, source)["skipped"]
    assert sinks.land(df, path, 30, source, verify_only=True) == made
    with pytest.raises(ValueError, match="cap: 30 is not 31"):
        sinks.land(df, path, 31, source, verify_only=True)
    with pytest.raises(ValueError, match="source"):
        sinks.land(df, path, 30, {"dataset": "e"}, verify_only=True)
    (tmp_path / "landed/_manifest.json").unlink()
    with pytest.raises(ValueError, match="no manifest"):
        sinks.land(df, path, 30, source, verify_only=True)
    assert sinks.land(df, path, 30, source) == made | {"provenance_reconstructed": True}
    first = sorted(pathlib.Path(path).glob("part-*"))[0]
    first.write_text(first.read_text() + '{"id": 99}\n')
    for x in pathlib.Path(path).glob(".*.crc"):
        x.unlink()
    with pytest.raises(ValueError, match="sha256"):
        sinks.land(df, path, 30, source, verify_only=True)
    assert sinks.land(df, path, 20, source, force=True)["rows_written"] == 20
    with pytest.raises(ValueError):
        sinks.land(df, path, 0, source)


def test_shards_done_are_not_done_again(spark, tmp_path):
    names = ["a.json", "b.json", "c.json"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names[:2])], "name string, i int")
    assert sinks.pending(spark, [f"/x/{n}" for n in names], f"{tmp_path}/out") == [f"/x/{n}" for n in names]
    sinks.write_by_shard(df, "name", f"{tmp_path}/out")
    assert sinks.pending(spark, [f"/x/{n}" for n in names], f"{tmp_path}/out") == ["/x/c.json"]
    sinks.write_by_shard(spark.createDataFrame([("b.json", 7)], "name string, i int"), "name", f"{tmp_path}/out")
    assert sorted((r.shard, r.i) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a.json", 0), ("b.json", 7)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"a": 1}\n')
    (tmp_path / "j/b.json").write_text('{"a": 1}\nx\n')
    assert sorted(r.failed for r in readers.file_errors(spark, f"{tmp_path}/j").collect()) == [False, True]


def test_extraction_of_odd_rows(spark):
    from scriptorium.operators import extract

    text = "word " * 20
    rows = [(" 1 ", "7", text, "p"), ("2", "x", text, "p"), ("y", "7", text, "p"), ("3", "8", text, "p"), ("4", "7", " short ", None), ("5", "7", None, "<b>" + "<i></i>" * 20 + "</b>"), ("6", None, text, None), ("+9", "7", text, None)]
    opinions = spark.createDataFrame(rows, "id string, cluster_id string, plain_text string, html string")
    clusters = spark.createDataFrame([(7, 3, "", "nan", "Published"), (7, 3, "", "nan", "Published")], "id bigint, docket_id bigint, case_name string, date_filed string, precedential_status string")
    dockets = spark.createDataFrame([(3, "ca9", "a v. b", "2020-01-01")], "id bigint, court_id string, case_name string, date_filed string")
    courts = spark.createDataFrame([("ca9", "Ninth Circuit")], "id string, full_name string")
    records, quarantine, counts = extract.extract(opinions, extract.last_by_key(clusters, "id", "docket_id"), dockets, courts, ["plain_text", "html"])
    assert {r.outcome: r.n for r in counts.collect()} == {"kept": 2, "bad_cluster_id": 2, "bad_opinion_id": 1, "outside": 1, "empty": 1, "stub": 1}
    assert sorted((r.reason, r.id) for r in quarantine.collect()) == [("bad_cluster_id", "2"), ("bad_cluster_id", "6"), ("bad_opinion_id", "y")]
    got = records.orderBy("id").collect()
    assert len(records.columns) == 23 and [r.id for r in got] == [1, 9]
    assert (got[0].case_name, got[0].date_filed, got[0].court_name, got[0].is_precedential, got[0].text_length) == ("a v. b", "nan", "Ninth Circuit", True, 99)
    numbers = spark.createDataFrame([(x,) for x in ("12", " -3 ", "+4", "1_000", "1.0", "", None, "\u00b2", "9" * 19, "9" * 30)], "x string")
    assert [r.v for r in numbers.select(extract.safe_int(F.col("x")).alias("v")).collect()] == [12, -3, 4, 1000, None, None, None, None, None, None]


def test_contracts_of_damaged_shards(spark, tmp_path):
    from scriptorium.operators import contracts

    def of(path, manifest, **k):
        return {r.contract: (r.passed, r.n_bad) for r in contracts.corpus_contracts(spark, f"{path}", manifest, ["html"], **k).collect()}

    none = of(tmp_path / "none", None)
    assert set(none) == set(contracts.NAMES) and not any(none[c][0] for c in ("shard_dir_exists", "manifest_exists", "shards_exist", "total_count", "multiple_circuits")) and none["checksums"][0]
    good = {c: "x" for c in contracts.PROVENANCE} | {"text_source": "html", "raw_text": "t", "text": "t" * 60, "cleaning_flags": []}
    lines = [good | {"court_id": f"c{i}"} for i in range(8)] + [good | {"text": ""}, {k: v for k, v in good.items() if k != "docket_id"}, {k: v for k, v in good.items() if k != "raw_text"}, good | {"text_source": "other"}]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/part-0.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n\n")
    got = of(tmp_path / "d", {"files": {"part-0.json": {"sha256": "0"}}}, min_total=20)
    assert {c: n for c, (ok, n) in got.items() if not ok} == {"total_count": 7, "valid_json": 1, "text_present": 2, "text_substantive": 1, "provenance_fields": 2, "raw_and_normalized_text": 2, "text_source_tracked": 2, "schema_consistent": 1, "checksums": 1}
    (tmp_path / "e").mkdir()
    (tmp_path / "e/part-0.json").write_text("\n".join(json.dumps(x) for x in lines[:8]))
    assert contracts.all_passed(contracts.corpus_contracts(spark, f"{tmp_path}/e", {"files": {}}, ["html"]))


def test_enrichment_fails_over_a_rate(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 50), (3, None), (4, None)], "id int, cluster_id int")
    index = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "key int, cluster_id int")
    parts = joins.enrich(rows, index, "id", "key", "cluster_id")
    assert {(r.id, r.cluster_id) for r in parts[0].collect()} == {(1, 11), (2, 50)} and {r.id for r in parts[1].collect()} == {3, 4}
    assert joins.write_enriched(parts, f"{tmp_path}/a", 0.5)["sample_unmatched"] == [3, 4]
    with pytest.raises(RuntimeError, match="2 of 4"):
        joins.write_enriched(parts, f"{tmp_path}/b", 0.4)
    assert spark.read.json(f"{tmp_path}/b/dead").count() == 2  # the dead letters are there to look at
    whole = joins.enrich(rows.where("id < 3"), index, "id", "key", "cluster_id")
    assert joins.write_enriched(whole, f"{tmp_path}/c", 0.0)["n_unmatched"] == 0 and not (tmp_path / "c/dead").exists()


@pytest.mark.parametrize(("ids", "n_items"), [(range(200), 60), ([None] * 30 + list(range(200)), 40), ([], 60)])
def test_enrich_summary_as_its_sql(spark, tmp_path, ids, n_items):
    import duckdb

    from scriptorium.plans import registry

    spark.createDataFrame([(i,) for i in ids], "doc_id bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in range(n_items)], "item_id bigint").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES["enrich_summary"](spark, str(tmp_path)), con.sql(registry.ORACLE_SQL["enrich_summary"])
    assert repr([tuple(r) for r in got.select(*want.columns).collect()]) == repr(want.fetchall())


def test_runs_that_are_not_aligned(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.6)], "s int, d int, x double")
    b = spark.createDataFrame([(1, 3, "u"), (1, 2, "v")], "s int, d int, y string")
    assert {tuple(r) for r in joins.aligned(a, b, ["s", "d"]).collect()} == {(1, 2, 0.5, "v"), (1, 3, 0.6, "u")}
    for other in (b.limit(1), b.union(b.limit(1)), b.union(spark.createDataFrame([(9, 9, "w")], b.schema))):
        with pytest.raises(Exception, match="aren't aligned"):
            joins.aligned(a, other, ["s", "d"]).collect()
    assert tuple(joins.alignment(a, b.limit(1).union(b.limit(1)), ["s", "d"]).first()) == (2, 2, 1, 1, 0, 1)


def test_metrics_skip_queries_without_gold(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1), (3, 10, 1)], "query_id int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 10), (7, 10)], "query_id int, gold int")
    m = retrieval.evaluate(gold, run, (1, 2), (2,)).first()
    assert (m.n_queries, m.n_skipped, m.hit_1, m.hit_2, m.mrr) == (2, 1, 0.0, 0.5, 0.25)


def test_spans_are_found(spark):
    kind = "x string, n array<string>"
    text = "Roe v. Wade, 410 U.S. 113 and 12 F. Supp. 2d at 9; wade (x.y)"
    mask = lambda t, n, gap=0: one(spark, X.mask_citations(F.col("x"), F.col("n"), "#", gap), kind, (t, n))
    assert mask(text, ["Wade", "Roe", ""]) == "# v. #, # and #; # (x.y)"
    assert mask(text, ["Wade"], 2) == "Roe v. # and # (x.y)"
    assert mask(text, []) == "Roe v. Wade, # and #; wade (x.y)"
    assert mask("", ["a"]) == "" and mask("x.y and xzy", ["x.y"]) == "# and xzy"
    assert [(s.start, s.stop) for s in one(spark, X.spans_of(F.col("x"), "a+"), "x string", ("aab aaa",))] == [(0, 2), (4, 7)]


def test_remote_stores(spark, tmp_path):
    import io

    from scriptorium.sources import remote

    waits: list[float] = []
    quiet = {"sleep": waits.append}
    page = lambda keys, token: "<?xml version='1.0'?><L xmlns='http://x/'>" + "".join(f"<Contents><Key>{k}</Key><LastModified>2024-01-0{i + 1}</LastModified><Size>{i}</Size></Contents>" for i, k in enumerate(keys)) + (f"<IsTruncated>true</IsTruncated><NextContinuationToken>{token}</NextContinuationToken>" if token else "<IsTruncated>false</IsTruncated>") + "</L>"
    pages, fails = {None: page(["a", "b"], "t1"), "t1": page(["c"], None)}, [remote.Unavailable("503"), ConnectionError()]

    def fetch(token):
        if token == "t1" and fails:
            raise fails.pop()
        return pages[token]

    assert [(r.key, r.size) for r in remote.listing(spark, fetch, **quiet).collect()] == [("a", 0), ("b", 1), ("c", 0)] and len(waits) == 2
    fails += [remote.Unavailable("429")] * 3
    with pytest.raises(remote.Unavailable):
        list(remote.list_objects(fetch, **quiet))
    with pytest.raises(ValueError, match="goes round"):
        list(remote.list_objects(lambda t: page(["a"], "same")))
    assert list(remote.list_objects(lambda t: page([], None))) == []

    class Broken(io.BytesIO):
        def read(self, n=-1):
            raise ConnectionError

    streams = [io.BytesIO(b"whole"), Broken()]
    at = f"file://{tmp_path}/x.bin"
    assert remote.download(lambda: streams.pop(), at, **quiet) and not remote.download(lambda: streams.pop(), at)
    assert (tmp_path / "x.bin").read_bytes() == b"whole" and [x.name for x in tmp_path.iterdir()] == ["x.bin"]
    schema = T.StructType([T.StructField("id", T.LongType())])
    tries = [0]

    def opener(revision):
        tries[0] += 1
        for i in range(5):
            if i == 3 and tries[0] == 1:
                raise remote.Unavailable
            yield {"id": i}

    assert sorted(r.id for r in remote.land_stream(spark, opener, "a" * 40, f"file://{tmp_path}/h.jsonl", schema, 4, **quiet).collect()) == [0, 1, 2, 3] and tries == [2]
    with pytest.raises(ValueError):
        remote.land_stream(spark, opener, "main", f"file://{tmp_path}/i.jsonl", schema)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    (tmp_path / "in").mkdir()
    reason = F.when(F.length("text") < 3, "short")

    def run():
        rows = ingest.stream_files(spark, f"{tmp_path}/in", schema)
        q = ingest.ingest_stream(rows, reason, f"{tmp_path}/out", f"{tmp_path}/cp", ["id"])
        q.awaitTermination(60)

    (tmp_path / "in/a.json").write_text('{"id": 1, "text": "long"}\n{"id": 2, "text": "x"}\n')
    run()
    (tmp_path / "in/b.json").write_text('{"id": 1, "text": "again"}\n{"id": 3, "text": "other"}\n')
    run()
    assert sorted((r.id, r.text) for r in spark.read.parquet(f"{tmp_path}/out/good").collect()) == [(1, "long"), (3, "other")]
    assert [r.id for r in spark.read.json(f"{tmp_path}/out/dead").collect()] == [2]
    timed = T.StructType([*schema.fields, T.StructField("ts", T.TimestampType())])
    (tmp_path / "timed").mkdir()
    (tmp_path / "timed/a.json").write_text("".join(json.dumps({"id": i, "text": "long", "ts": f"2024-01-01T0{h}:00:00Z"}) + "\n" for i, h in ((1, 1), (1, 1), (2, 2))))
    ingest.ingest_stream(ingest.stream_files(spark, f"{tmp_path}/timed", timed), reason, f"{tmp_path}/out2", f"{tmp_path}/cp2", ["id"], "ts", "1 hour").awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out2/good").collect()) == [1, 2]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.k, r.n) for r in ingest.windowed_counts(events, "ts", "k").collect()) == [("a", 2), ("b", 1)]


def test_model_hooks(spark):
    from scriptorium.operators import hooks

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "b")], "id int, text string")

    def encoder():
        return lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]

    got = {r.id: r.vector for r in hooks.encode(df, "text", encoder).collect()}
    assert got[1] == pytest.approx([2**-0.5, 2**-0.5]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 1.0]

    def generator():
        return lambda prompts: [p.upper() for p in prompts]

    out = hooks.generate(df, "text", generator)
    assert out.columns == ["id", "text", "generation"]
    assert {r.id: r.generation for r in out.collect()} == {1: "AB", 2: None, 3: "B"}
    assert hooks.generate(df.limit(0), "text", generator).count() == 0
