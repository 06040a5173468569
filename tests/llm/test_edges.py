"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import types as T

from scriptorium.llm import exact_dedup, langid, linecrf, mixing, nbsvm, ordinal, packing, simhash, tokenbin, warc

CLASHING = ["row", "name", "n", "k", "s", "bucket", "rank", "h", "text_", "canonical", "bin", "score", "weight", "part", "chosen_id", "v", "f0", "node", "root"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])
LONG = "word and other words of a long text " * 6000
TEXTS = [
    (1, "the cat sat on the mat and looked at the moon over the hill", "en", "a"),
    (2, "the cat sat on the mat and looked at the moon over the hill", "en", "a"),
    (2, "the cat sat on the mat and looked at the moon over the hill", "en", "a"),  # repeated row
    (None, "the cat sat on the mat and looked at the moon over the hill", None, None),
    (4, None, "en", "b"),
    (5, "", "fr", "b"),
    (6, "", None, "b"),
    (7, " \t\n ", "fr", "c"),
    (8, LONG, "en", "c"),
    (9, LONG, "en", "c"),
    (10, "der hund und die katze sind nicht zusammen im haus gewesen", "de", "c"),
    (11, "\U0001f600 x", "xx", None),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, *["x"] * len(CLASHING)) for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def models(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    large = [spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels")]
    return {"toxic": ordinal.train(*large), "lang": langid.train(d), "quality": nbsvm.train(d, labels), "lines": linecrf.train(d, labels)}


OPERATORS = {
    "mix": (lambda d, m: mixing.mix_sources(d, budget_share=1.0), len(TEXTS)),
    "lang": (lambda d, m: langid.identify(d, m["lang"]), len(TEXTS)),
    "exact": (lambda d, m: exact_dedup.exact_duplicates(d), len(TEXTS)),
    "exact hot keys": (lambda d, m: exact_dedup.exact_duplicates(d, block_chars=1000, hot_rows=3), len(TEXTS)),
    "toxic": (lambda d, m: ordinal.toxicity(d, m["toxic"]), len(TEXTS)),
    "pack": (lambda d, m: packing.pack(d, capacity=64, open_bins=2), None),
    "tokens": (lambda d, m: tokenbin.token_binary(d), len(TEXTS)),
    "near": (lambda d, m: simhash.near_duplicates(d), len(TEXTS)),
    "quality": (lambda d, m: nbsvm.quality(d, m["quality"]), len(TEXTS)),
    "lines": (lambda d, m: linecrf.line_quality(d, m["lines"]), len(TEXTS)),
}
DROPS = {
    "exact": (lambda d, m: exact_dedup.drop_exact_duplicates(d), 13 - 3 - 1 - 1),
    "near": (lambda d, m: simhash.drop_near_duplicates(d), 13 - 3 - 1),
    "toxic": (lambda d, m: ordinal.drop_toxic(d, m["toxic"], threshold=1.1), 13),
    "mix": (lambda d, m: mixing.keep_mixture(d, budget_share=1.0), 13),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows(name, docs, empty, models):
    run, rows = OPERATORS[name]
    got = run(docs, models).collect()
    if rows is not None:
        assert len(got) == rows
    assert run(empty, models).collect() == []
    assert run(empty, models).columns == run(docs, models).columns


@pytest.mark.parametrize("name", DROPS)
def test_filter_on_odd_rows(name, docs, empty, models):
    run, rows = DROPS[name]
    out = run(docs, models)
    assert out.columns == docs.columns
    assert out.count() == rows
    assert run(empty, models).count() == 0


def test_toxic_rows_are_those_that_go(docs, models):
    flagged = ordinal.toxicity(docs, models["toxic"]).where("is_toxic").count()
    assert ordinal.drop_toxic(docs, models["toxic"]).count() == len(TEXTS) - flagged < len(TEXTS) + 1
    assert not any(r.is_toxic for r in ordinal.toxicity(docs.where("text is null or length(text) < 5"), models["toxic"]).collect())


def test_results_that_the_docstrings_promise(docs, models):
    exact = {(r.doc_id, r.canonical_id, r.is_kept) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert exact == {(1, 1, True), (2, 1, False), (None, 1, False), (4, 4, True), (None, None, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True), (9, 8, False), (10, 10, True), (11, 11, True)}
    lang = {(r.doc_id, r.language) for r in langid.identify(docs, models["lang"]).collect()}
    assert {(4, None), (5, None), (1, "en"), (10, "de"), (8, "en")} <= lang
    lines = {r.doc_id: r.is_kept for r in linecrf.line_quality(docs, models["lines"]).collect() if r.doc_id}
    assert not lines[4] and not lines[5] and lines[1]
    quality = {r.doc_id: r for r in nbsvm.quality(docs, models["quality"]).collect() if r.doc_id}
    assert quality[4].score == float("-inf") and not quality[5].is_good
    near = {(r.doc_id, r.canonical_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(2, 1), (9, 8), (4, 4), (5, 5), (6, 6), (7, 7), (None, None), (None, 1)} <= near
    tokens = {r.doc_id: r for r in tokenbin.token_binary(docs).collect() if r.doc_id}
    assert tokens[4].n_tokens == tokens[5].n_tokens == 0 and tokens[5].packed == b"" and tokens[8].n_tokens > 40_000
    mixed = mixing.mix_sources(docs, weights={"c": 0.0}, budget_share=1.0)
    assert mixed.where("source = 'c'").count() == 0 and mixed.where("source is null").count() == 3


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_rows(k, spark, docs, empty, sf_dir):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf_dir)
    assert out.count() > 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert stage(spark, empty, sf_dir).count() == 0


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


def test_stages_keep_the_rows_that_they_say(spark, docs, sf_dir):
    import duckdb

    stage = dict(corpus_pipeline.STAGES)
    assert ids(stage["exact_dedup"](spark, docs, sf_dir)) == [1, 4, 5, 7, 8, 10, 11, None]
    assert ids(stage["simhash_near_dedup"](spark, docs, sf_dir)) == [1, 4, 5, 6, 7, 8, 10, 11, None]
    for kept in (stage["exact_dedup"](spark, docs, sf_dir), stage["simhash_near_dedup"](spark, docs, sf_dir)):
        assert {tuple(r)[5:] for r in kept.collect()} == {("x",) * len(CLASHING)}  # clashing columns pass through
        assert [r.text for r in kept.collect() if r.doc_id is None] == [None]
    model = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(stage["toxicity"](spark, docs, sf_dir)) == ids(ordinal.toxicity(docs, model).where("not is_toxic"))
    table = docs.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("odd", table.astype({"doc_id": "Int64"}))
    want = con.sql(mixing.mixing_sql("odd", "doc_id", budget_share=corpus_pipeline.MIX_BUDGET_SHARE)).fetchall()
    assert ids(stage["mix_sources"](spark, docs, sf_dir)) == sorted((i for (i,) in want), key=lambda i: (i is None, i or 0))
    tokens: dict = {}
    for r in stage["best_fit_packing"](spark, docs, sf_dir).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {1: 14, 2: 28, None: 14, 8: 48_000, 9: 48_000, 10: 11, 11: 2}
    nothing = spark.createDataFrame([(i, None, None, None, None, *["x"] * len(CLASHING)) for i in (1, 1, None)], SCHEMA)
    assert [len(ids(f(spark, nothing, sf_dir))) for _, f in corpus_pipeline.STAGES] == [3, 3, 3, 3, 0]


def test_warc_on_odd_rows(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>", "z"), (1, "http://a/1", "<p>x</p>", "z"), (None, None, None, None), (2, "http://a/2\r\nX: y", "", "z"), (3, "http://a/3", "long " * 300_000, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record string")
    index = warc.warc_index(spark, pages, f"file://{tmp_path}/a").collect()
    assert len(index) == 5 and {r.status for r in index} == {"ok"}
    assert {r.url for r in index} == {"http://a/1", None, "http://a/2 X: y", "http://a/3"}
    for r in index:
        _, content = warc.read_record(r.file, r.offset, r.length)
        assert len(content) == r.content_length
    assert warc.warc_index(spark, pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_rows_without_a_steady_order_are_written_first(spark, sf_dir):
    from scriptorium.llm.common import repeatable

    scan = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for steady in (scan, scan.select("doc_id", "text"), scan.where("doc_id > 3").selectExpr("doc_id + 1 AS i", "text")):
        assert repeatable(steady) is steady
    for loose in (scan.limit(50), scan.orderBy("doc_id"), scan.sample(0.5, 1), scan.where("rand() < 0.5"), scan.union(scan), scan.distinct(), scan.repartition(3), spark.createDataFrame(scan.limit(5).rdd, scan.schema), scan.mapInArrow(lambda x: x, scan.schema)):
        assert repeatable(loose) is not loose
    some = scan.limit(120)
    left = exact_dedup.drop_exact_duplicates(some)
    assert 0 < left.count() == left.select("text").distinct().count()


def test_rows_are_dropped_where_they_are_read(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from scriptorium.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spread = common.cut(docs.repartition(70))  # more partitions than a group has
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # one file a partition
    try:
        spread = spark.read.parquet(spread.inputFiles()[0].rsplit("/", 1)[0])
        assert spread.rdd.getNumPartitions() > 64
        for d in (docs, spread):
            gone = common.numbered(d, "n").where("doc_id % 3 = 0").select("n")
            for reach in (common.arrow_path, None):
                if reach is None:
                    monkeypatch.setattr(common, "arrow_path", lambda uri: (_ for _ in ()).throw(OSError(uri)))
                left = common.without_rows(d, "row", gone)
                assert left.columns == d.columns
                assert ids(left) == ids(d.where("doc_id % 3 != 0"))
                assert common.without_rows(d, "row", gone.where(F.lit(False))).count() == d.count()
                assert common.without_rows(d, "row", common.numbered(d, "n").select("n")).count() == 0
                assert ("Join" in left._jdf.queryExecution().executedPlan().toString()) == (reach is None)
            monkeypatch.undo()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
