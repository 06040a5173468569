"""Operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import gzip
import io
import itertools
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import common, exact_dedup, langid, linear, linecrf, mixing, nbsvm, ordinal, packing, registry, simhash, tokenbin, warc

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql(f"SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM '{LARGE}/documents.parquet' d JOIN '{LARGE}/labels.parquet' l USING (doc_id) ORDER BY md5(d.doc_id::VARCHAR)").df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    return sorted(map(tuple, df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_against_sql(name, spark, duck, sf_dir):
    assert canonical(registry.QUERIES[name](spark, sf_dir).toPandas()) == canonical(duck.sql(registry.ORACLE_SQL[name]).df())


# --- exact dedup ---


@pytest.mark.parametrize(("block", "hot"), [(1, 2), (3, 2), (3, 10**9), (64, 1)])
def test_names_are_equal_exactly_for_equal_texts(spark, block, hot):
    texts = ["".join(x) for n in range(6) for x in itertools.product("ab", repeat=n)] + ["ab" * 50, "ab" * 51, "ab" * 50 + "c", "\U0001f600" * 7]
    texts = texts * 2 + ["aaaa"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    names = exact_dedup.identities(exact_dedup.repeatable(docs), block_chars=block, hot_rows=hot).collect()
    assert len(names) == len(texts)
    by_name = defaultdict(set)
    for r in names:
        by_name[r.name].add(texts[r.doc])
    assert all(len(x) == 1 for x in by_name.values())
    assert len(by_name) == len(set(texts))


# --- mixing ---


def test_mixture_follows_weights(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix_sources(docs, {"s0": 1.0, "s1": 2.0, "s2": 3.0}, budget_share=None, budget_tokens=6000).toPandas()
    share = out.groupby("source").n_tokens.sum() / out.n_tokens.sum()
    assert np.allclose(share[["s0", "s1", "s2"]], [1 / 6, 2 / 6, 3 / 6], atol=0.01)
    assert out.n_tokens.sum() <= 6000 and out.n_tokens.sum() > 6000 - 8
    assert sorted(out.position) == list(range(1, len(out) + 1))


# --- packing ---


def brute_pack(lengths, capacity, open_bins):
    bins, open_, out = 0, [], []  # open_: [free, bin, time]
    clock = 0
    for item, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            out.append((item, start, bins, 0))
            bins += 1
            start += capacity
        need = n - start
        if need == 0:
            continue
        fits = [x for x in open_ if x[0] >= need]
        if fits:
            best = min(fits, key=lambda x: (x[0], x[2]))
        else:
            if len(open_) == open_bins:
                open_.remove(min(open_, key=lambda x: (x[0], x[2])))
            best = [capacity, bins, 0]
            bins += 1
            open_.append(best)
        out.append((item, start, best[1], capacity - best[0]))
        best[0] -= need
        clock += 1
        best[2] = clock
        if best[0] == 0:
            open_.remove(best)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=80), st.integers(1, 32), st.integers(1, 6))
def test_best_fit_against_brute_force(lengths, capacity, open_bins):
    got = list(packing.best_fit(lengths, capacity, open_bins))
    assert got == brute_pack(lengths, capacity, open_bins)


def test_packing_holds_every_token_once(spark, sf_dir, duck):
    out = packing.op5_best_fit_packing(spark, sf_dir).toPandas()
    words = duck.sql("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n FROM documents").df()
    got = out.groupby("doc_id").n_tokens.sum()
    assert got.to_dict() == words[words.n > 0].set_index("doc_id").n.to_dict()
    for _, b in out.sort_values("bin_start").groupby(["shard", "bin"]):
        assert b.bin_start.tolist() == [0, *b.n_tokens.cumsum().tolist()[:-1]]
        assert b.n_tokens.sum() <= packing.CAPACITY


def test_packing_in_shards_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(2**53 + 1 + 2 * i if i % 10 else None, "w " * int(n)) for i, n in enumerate(rng.integers(0, 90, size=400))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = packing.pack(docs, capacity=64, open_bins=4, shard_tokens=3000).toArrow().to_pylist()
    assert {r["doc_id"] for r in out} == {i for i, t in rows if t}  # none went through a float
    shards = {r["shard"] for r in out}
    assert len(shards) > 3
    keyed = docs.selectExpr("doc_id", "cast(size(regexp_extract_all(text, 'w', 0)) as int) n", "md5(concat('pack:', coalesce(string(doc_id), ''))) k", f"pmod(xxhash64(md5(concat('pack:', coalesce(string(doc_id), '')))), {-(-sum(len(t) // 2 for _, t in rows) // 3000)}) s").collect()
    for s in shards:
        mine = sorted((r.k, r.doc_id is None, r.doc_id or 0, r.n) for r in keyed if r.s == s and r.n)
        want = [(None if mine[i][1] else mine[i][2], start, b, at) for i, start, b, at in brute_pack([r[3] for r in mine], 64, 4)]
        got = [(r["doc_id"], r["token_start"], r["bin"], r["bin_start"]) for r in out if r["shard"] == s]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# --- classifiers ---


def test_toxicity_held_out(labelled):
    a, b = labelled[:1500], labelled[1500:]
    model = ordinal.fit(a.text.tolist(), a.toxic.tolist())
    severity, p = ordinal.score(pa.array(b.text), model)
    toxic = b.toxic.to_numpy() == 1
    assert ((p >= ordinal.TOXIC_FROM) == toxic).mean() > 0.96
    assert (p[toxic] >= ordinal.TOXIC_FROM).mean() > 0.8  # 183 toxic documents to learn from; some have no toxic word
    assert severity.min() >= 0 and severity.max() <= ordinal.GRADES - 1
    assert list(model.thresholds) == sorted(model.thresholds)
    # thousand-fold text of a clean document stays clean: words count once
    clean = b.text[b.toxic == 0].iloc[0]
    assert np.allclose(*ordinal.score(pa.array([clean, " ".join([clean] * 50)]), model)[0])


def test_toxicity_query_against_brute_force(spark, duck, sf_dir):
    read = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
    model = ordinal.train(read("documents"), read("labels"))
    assert model.weights
    got = {r.doc_id: r for r in registry.QUERIES["op4_toxicity"](spark, sf_dir).collect()}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = set(re.findall(r"[^\W]+", t.lower()))
        found = words | {w[:k] + "-" for w in words for k in ordinal.BEGINNINGS if len(w) > k}
        s = sum(w for f, w in model.weights.items() if f in found)
        p = [1 / (1 + np.exp(-(s - x))) for x in model.thresholds]
        assert got[i].severity == pytest.approx(sum(p)) and got[i].is_toxic == (p[0] >= ordinal.TOXIC_FROM)


def brute_grams(text):
    data, out = text.encode(), set()
    for n in nbsvm.NGRAMS:
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h * 65599 + c) & 0xFFFFFFFF
            out.add(((h + n * 0x9E3779B1) * 2654435761 & 0xFFFFFFFF) >> (32 - nbsvm.BITS))
    return sorted(out)


def test_quality_query_against_brute_force(spark, duck, sf_dir):
    read = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
    model = nbsvm.train(read("documents"), read("labels"))
    got = {r.doc_id: r for r in registry.QUERIES["op8_quality_classifier"](spark, sf_dir).collect()}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert set(got) == set(texts)
    for i, t in texts.items():
        g = brute_grams(t)
        want = sum(float(model.weight[x]) for x in g) / max(sum(float(model.ratio[x]) ** 2 for x in g) ** 0.5, 1e-9) + model.bias if g else float("-inf")
        assert got[i].score == pytest.approx(want, abs=1e-5) and got[i].is_good == (got[i].score > 0)


def test_language_query_against_brute_force(spark, duck, sf_dir):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r.doc_id: (r.family, r.language) for r in registry.QUERIES["op2_language_id"](spark, sf_dir).collect()}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = t.lower().encode()
        if len(raw) < 3:
            assert got[i] == (None, None)
            continue
        hashes = [(((raw[k] * 65599 + raw[k + 1]) * 65599 + raw[k + 2]) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS) for k in range(len(raw) - 2)]
        margin = langid.SCALE * model.weights[hashes].astype(float).mean(0) + model.bias
        assert got[i] == brute_vote(margin, model)


def brute_vote(margin, model):
    def best(level, names):
        votes, sums = Counter(), Counter()
        for m, (at, a, b) in zip(margin, model.machines, strict=True):
            if at == level:
                votes[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        return max(range(len(names)), key=lambda k: (votes[k], sums[k], -k))

    f = best(-1, model.families)
    return model.families[f], model.members[f][best(f, model.members[f])]


def test_votes_of_many_languages():
    """Five languages in two families and one alone: machines of a level disagree, so that votes decide."""
    rng = np.random.default_rng(11)
    sounds = {k: ["".join(rng.choice(list("abcdefghij")) for _ in range(2)) for _ in range(6)] for k in "uvwxyz"}
    for k in "vw":
        sounds[k][:3] = sounds["u"][:3]  # closely related
    sounds["y"][:3] = sounds["x"][:3]
    say = lambda k: "".join(rng.choice(sounds[k]) for _ in range(40))
    languages = [k for k in "uvwxyz" for _ in range(30)]
    model = langid.fit([say(k) for k in languages], languages, {"one": ("u", "v", "w"), "two": ("x", "y")})
    assert model.families == ("one", "two", "z") and len(model.machines) == 3 + 3 + 1
    texts, true = zip(*[(say(k), k) for k in "uvwxyz" for _ in range(40)], strict=True)
    margin, _ = langid.margins(pa.array(texts), model)
    got = list(zip(*langid.predict(pa.array(texts), model), strict=True))
    assert got == [brute_vote(m, model) for m in margin]
    assert np.mean([g[1] == k for g, k in zip(got, true, strict=True)]) > 0.9


def test_long_texts_in_pieces(monkeypatch, labelled):
    lang, quality = langid.fit(labelled.text[:100].tolist(), labelled.lang[:100].tolist()), nbsvm.fit(labelled.text[:300].tolist(), labelled.quality[:300].tolist())
    texts = pa.array([*labelled.text[300:330], "x" * 64, "x" * 65, "x" * 66, "ab", "abc", "", None, "é" * 999])
    whole = langid.margins(texts, lang)[0], nbsvm.score(texts, quality)
    monkeypatch.setattr(langid, "PIECE", 64)
    monkeypatch.setattr(nbsvm, "PIECE", 64)
    assert np.allclose(langid.margins(texts, lang)[0], whole[0], atol=1e-6) and np.allclose(nbsvm.score(texts, quality), whole[1], atol=1e-6)


def test_memory_of_a_very_long_text():
    """100 MB in one text: what a scorer takes besides."""
    code = """
import resource, sys, numpy as np, pyarrow as pa
from scriptorium.llm import langid, nbsvm
text = pa.array(["and the word is not " * 5_000_000])
model = langid.LanguageModel(("a", "b"), (("a",), ("b",)), ((-1, 0, 1),), np.ones((1 << langid.BITS, 3), np.float32), np.zeros(3))
quality = nbsvm.QualityModel(np.ones(1 << nbsvm.BITS, np.float32), np.ones(1 << nbsvm.BITS, np.float32), 0.0)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
langid.margins(text, model) if sys.argv[1] == "lang" else nbsvm.score(text, quality)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    for kind in ("lang", "quality"):
        done = subprocess.run([sys.executable, "-c", code, kind], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
        assert int(done.stdout) < 500


def test_models_of_no_labels(spark):
    schema = "doc_id bigint, text string, lang string"
    docs = spark.createDataFrame([(1, "some text here", None), (None, None, None), (2, "a", None)], schema)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = langid.train(docs)
    assert model.families == () and langid.predict(pa.array(["text", None]), model) == ([None, None], [None, None])
    assert {(r.doc_id, r.language) for r in langid.identify(docs, model).collect()} == {(1, None), (2, None), (None, None)}
    assert not any(r.is_toxic for r in ordinal.toxicity(docs, ordinal.train(docs, labels)).collect())
    assert not any(r.is_good for r in nbsvm.quality(docs, nbsvm.train(docs, labels)).collect())
    assert {(r.doc_id, r.is_kept) for r in linecrf.line_quality(docs, linecrf.train(docs, labels)).collect()} == {(1, True), (2, True), (None, False)}
    one = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    short = spark.createDataFrame([(1, "", "en"), (2, "a", "en")], schema)
    for d in (docs, short):
        scores = [r.score for r in nbsvm.quality(d, nbsvm.train(d, one)).collect()]
        assert not any(np.isnan(scores))
        assert ordinal.toxicity(d, ordinal.train(d, one)).count() == linecrf.line_quality(d, linecrf.train(d, one)).count() == d.count()


def test_language_held_out(labelled):
    a, b = labelled[:600], labelled[600:]
    model = langid.fit(a.text.tolist(), a.lang.tolist())
    family, language = langid.predict(pa.array(b.text), model)
    assert np.mean(np.array(language) == b.lang.to_numpy()) > 0.98
    of = {x: f for f, m in langid.FAMILIES.items() for x in m}
    assert all(of[x] == f for f, x in zip(family, language, strict=True))


def test_language_scores_against_brute_force(labelled):
    model = langid.fit(labelled.text[:200].tolist(), labelled.lang[:200].tolist())
    texts = [*labelled.text[200:230].tolist(), None, "", "ab", "abc"]
    got, known = langid.margins(pa.array(texts), model)
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").lower().encode(), np.uint8)
        if len(raw) < 3:
            assert not known[i]
            continue
        assert np.allclose(got[i], langid.SCALE * model.weights[langid.trigrams(raw)].astype(float).mean(0) + model.bias, atol=1e-4)
    assert np.allclose(langid.margins(pa.array(texts)[5:20], model)[0], got[5:20])


def test_quality_held_out(labelled):
    a, b = labelled[:1500], labelled[1500:]
    model = nbsvm.fit(a.text.tolist(), a.quality.tolist())
    good = nbsvm.score(pa.array(b.text), model) > 0
    assert (good == (b.quality == 1)).mean() > 0.95
    assert good[(b.quality == 1).to_numpy()].mean() > 0.97


def test_hinge_dual_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.5, -1.0, 1.0)
    rows = [(np.arange(5), r) for r in x]
    w = linear.hinge_dual(rows, y, 5, c=0.3, epochs=500, tolerance=1e-8)

    def loss(w):
        return w @ w / 2 + 0.3 * np.maximum(0, 1 - y * (x @ w)).sum()

    assert all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(scale=0.05, size=(300, 5)))


# --- line field ---


def test_viterbi_and_expectations_against_enumeration():
    rng = np.random.default_rng(3)
    field = linecrf.LineField(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    edges = np.array([0, 3, 3, 4, 9])
    emit = rng.normal(size=9) * 2
    label = linecrf.viterbi(edges, emit, field)
    z, p, move, start = linecrf._expectations(edges, emit, field)
    want_z, want_p, want_move = 0.0, np.zeros(9), np.zeros((2, 2))
    for a, b in itertools.pairwise(edges):
        if a == b:
            continue
        paths = list(itertools.product([0, 1], repeat=int(b - a)))
        scores = np.array([field.start[y[0]] + sum(emit[a + i] * v for i, v in enumerate(y)) + sum(field.move[u, v] for u, v in itertools.pairwise(y)) for y in paths])
        assert tuple(label[a:b]) == paths[int(np.argmax(scores))]
        lz = np.logaddexp.reduce(scores)
        want_z += lz
        for y, s in zip(paths, np.exp(scores - lz), strict=True):
            want_p[a:b] += s * np.array(y)
            for u, v in itertools.pairwise(y):
                want_move[u, v] += s
    assert np.isclose(z, want_z) and np.allclose(p, want_p) and np.allclose(move, want_move)


def share_of_content(texts, field):
    edges, label, size = linecrf.label_texts(pa.array(texts), field)
    return np.array([(size[a:b] * label[a:b]).sum() / max(size[a:b].sum(), 1) for a, b in itertools.pairwise(edges)])


def test_lines_keep_clean_documents_and_reject_boilerplate(labelled):
    """Held-out documents, against the bare rule: signs, capitals, notices, tables and links, repeated lines, one word over and over."""
    field = linecrf.fit(labelled.text[:1500].tolist(), labelled.quality[:1500].tolist())
    held = labelled[1500:]
    good = (held.quality == 1).to_numpy()
    kept = share_of_content(held.text, field) >= linecrf.MIN_CONTENT_SHARE
    edges, lines = linecrf.lines_of(pa.array(held.text))
    rule = ~linecrf.features(edges, lines)[:, [13, 8, 16, 18, 19, 20]].any(axis=1)
    size = np.array([len(x or "") for x in lines.to_pylist()])
    ruled = np.array([(size[a:b] * rule[a:b]).sum() / max(size[a:b].sum(), 1) for a, b in itertools.pairwise(edges)]) >= linecrf.MIN_CONTENT_SHARE
    assert kept[good].mean() > max(0.998, ruled[good].mean())
    assert (~kept)[~good].mean() > max(0.98, (~ruled)[~good].mean())


def brute_features(text):
    """Features of each line of a text, from their description."""
    out, before = [], set()
    for line in text.split("\n"):
        data = line.encode()
        n = len(data)
        lower = sum(97 <= c <= 122 or c >= 128 for c in data)
        upper, digit = sum(65 <= c <= 90 for c in data), sum(48 <= c <= 57 for c in data)
        space, plain = sum(c == 32 or 9 <= c <= 13 for c in data), sum(chr(c) in ".,;:'-?()\"" for c in data)
        sl, su, sd, sp, sw, ss = (x / max(n, 1) for x in (lower, upper, digit, plain, space, n - lower - upper - digit - space - plain))
        words = re.split(r"\s+", line) if line else [""]
        k, distinct, stutter = len(words), len(set(words)), sum(a == b for a, b in itertools.pairwise(words)) / len(words)
        bars = re.search(r"\|.*\||\t.*\t", line) or re.search(r"https?://|www\.|@[a-z0-9-]+\.", line)
        out.append([
            1, n == 0, 0 < n < 20, 20 <= n < 60, 60 <= n < 200, n >= 200, sl > 0.6, su > 0.2, su > 0.5, sd > 0.1, sd > 0.3, ss > 0.02, ss > 0.1, ss > 0.2, sp > 0.2, sw > 0.3,
            bool(re.search(linecrf.NOTICE, line)), n > 0 and bool(re.search(r"[.!?]\s*$", line)), bool(bars), line in before, k >= 8 and distinct <= max(2, 0.1 * k),
            stutter > 0.1, stutter > 0.4, k >= 8 and distinct <= 0.6 * k, k >= 8 and distinct <= 0.3 * k,
        ])
        before.add(line)
    return np.array(out, dtype=float)


def brute_share(text, field):
    x = brute_features(text) @ field.emit
    best, back = [field.start + [0, x[0]]], []
    for e in x[1:]:
        reach = best[-1][:, None] + field.move
        back.append(reach.argmax(0))
        best.append(reach.max(0) + [0, e])
    label = [int(best[-1].argmax())]
    for b in reversed(back):
        label.append(int(b[label[-1]]))
    lines = text.split("\n")
    return sum(len(t) for t, y in zip(lines, reversed(label), strict=True) if y) / max(sum(map(len, lines)), 1)


def test_line_query_against_brute_force(spark, duck, sf_dir):
    read = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
    field = linecrf.train(read("documents"), read("labels"))
    got = {r.doc_id: (r.content_share, r.is_kept) for r in registry.QUERIES["op10_line_labelling"](spark, sf_dir).collect()}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = brute_share(t, field)
        assert got[i][0] == pytest.approx(want) and got[i][1] == (got[i][0] >= linecrf.MIN_CONTENT_SHARE)


# --- tokens ---


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 2**20 - 1), max_size=300), st.integers(1, 9), st.integers(0, 300), st.integers(0, 300))
def test_bits_round_trip(bits, ids, eights, start, stop):
    block = 8 * eights
    ids = np.array(ids, dtype=np.uint32) & np.uint32((1 << bits) - 1)
    packed, offsets = tokenbin.pack_ids(ids, bits, block)
    assert len(packed) == sum(-(-len(ids[i : i + block]) * bits // 8) for i in range(0, len(ids), block))
    assert tokenbin.unpack_ids(packed, offsets, len(ids), bits, block=block).tolist() == ids.tolist()
    assert tokenbin.unpack_ids(packed, offsets, len(ids), bits, start, stop, block).tolist() == ids[start:stop].tolist()


def test_ids_are_those_of_the_library(spark, sf_dir, duck):
    enc = tokenbin.encoding(tokenbin.read_ranks())
    odd = ["it's  a test,\n\n  isn't it?  ", "tab\t\tx  y　z  ", "a b 12abé ٣", " ", "\r\n\r\n x", "don't DON'T 'S", "\x1c\x1d a\x0b\x0cb"]
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall() + [(10**6 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r for r in tokenbin.token_binary(docs).collect()}
    for i, t in texts:
        r = got[i]
        assert tokenbin.unpack_ids(bytes(r.packed), r.block_offsets, r.n_tokens, r.bits).tolist() == enc.encode_ordinary(t), repr(t)


def test_ids_of_long_texts_come_as_arrays(monkeypatch):
    enc = tokenbin.encoding(tokenbin.read_ranks())
    text = "It's one  word,\n and <|endoftext|> 12 more \U0001f600 " * 50
    want = enc.encode_ordinary(text)
    assert tokenbin.ids_of(text, enc).tolist() == want
    monkeypatch.setattr(tokenbin, "LONG", 10)
    assert tokenbin.ids_of(text, enc).tolist() == want and enc.decode(want) == text


# --- near duplicates ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé\u4e00\U0001f600", max_size=60), max_size=20))
def test_word_hashes_are_those_of_the_library(words):
    got, real = common.hash_words(pa.array(words, pa.string()))
    assert got.tolist() == [xxhash.xxh64_intdigest(w) for w in words] and real.tolist() == [w != "" for w in words]


def brute_pairs(f, budget, budget_runs):
    out = set()
    for i in range(len(f)):
        d = np.bitwise_count(f[i + 1 :] ^ f[i])
        out |= {(i, i + 1 + int(j)) for j in np.flatnonzero((d[:, 0] <= budget) & (d[:, 1:].sum(1) <= budget_runs))}
    return out


def trie_of(f, ways, depth, **split):
    """Rows as a task has them: index of each row's fingerprint, and its place, in the order of the trie."""
    index, place = simhash.node_rows(f[:, 0], ways, simhash.Cut(depth, **split))
    bits = np.array([int(simhash._read(f[i : i + 1, 0], ways[p >> 48].start)[0]) for i, p in zip(index.tolist(), place.tolist(), strict=True)], dtype=np.uint64)
    order = np.lexsort((bits, place))
    return index[order], place[order]


def trie_join(f, budget, budget_runs, n=10, depth=simhash.MIN_DEPTH, seen=None):
    """Near pairs with the number of times that each is found."""
    ways = simhash.rotations(n, budget)
    index, place = trie_of(f, ways, min(depth, *(w.width for w in ways)))
    found = simhash.trie_pairs(place, f[index, 0], f[index, 1:], ways, min(depth, *(w.width for w in ways)), budget, budget_runs, seen=seen)
    return Counter((min(a, b), max(a, b)) for i, j in found for a, b in zip(index[i].tolist(), index[j].tolist(), strict=True))


@pytest.mark.parametrize(("budget", "n", "depth"), [(0, 10, 6), (3, 10, 3), (9, 10, 6), (9, 1 << 29, 8), (6, 1 << 34, 10), (13, 10, 6), (13, 10, 10), (13, 1 << 30, 7), (13, 1 << 34, 6)])
def test_trie_join_finds_each_pair(monkeypatch, budget, n, depth):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 4)
    monkeypatch.setattr(simhash, "NODE_PAIRS", 1000)
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, size=(150, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=(150, 2), dtype=np.uint64)
    rows = [base]
    for k in range(budget + 3):
        other = base[:100].copy()
        for r in other:
            for b in rng.choice(64, size=k, replace=False):
                r[0] ^= np.uint64(1) << np.uint64(b)
            for b in rng.choice(64, size=k, replace=False):
                r[1] ^= np.uint64(1) << np.uint64(b)
        rows.append(other)
    f = np.unique(np.concatenate(rows), axis=0)
    seen = Counter()
    got = trie_join(f, budget, budget + 1, n, depth, seen)
    assert set(got) == brute_pairs(f, budget, budget + 1)
    assert max(got.values(), default=0) <= len(simhash.rotations(n, budget))  # once in a rotation
    assert seen["pruned"] > 0


def test_errors_of_a_pair_keep_in_step_in_some_rotation():
    ways = simhash.rotations(10, simhash.BUDGET)
    assert [w.errors for w in ways] == [2, 2, 2, 2, 1] and sum(w.width for w in ways) == 64
    assert all(len(w.allowed) == 65 and w.allowed[-1] == simhash.BUDGET and sorted(w.allowed) == list(w.allowed) for w in ways)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        wrong = np.zeros(64, dtype=int)
        wrong[rng.choice(64, size=simhash.BUDGET, replace=False)] = 1
        assert any((np.cumsum(np.roll(wrong, -w.start)) <= np.array(w.allowed[1:])).all() for w in ways)


def test_trie_join_of_equal_halves_and_forests(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_PAIRS", 500)
    rng = np.random.default_rng(4)
    f1 = np.uint64(0) ^ (np.uint64(1) << rng.integers(0, 40, size=400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, size=400).astype(np.uint64))
    f = np.unique(np.stack([np.repeat(np.array([7, 2**63], np.uint64), 200), f1], axis=1), axis=0)
    assert set(trie_join(f, 3, 3)) == brute_pairs(f, 3, 3)
    ways = simhash.rotations(10, 3)
    index, place = trie_of(f, ways, 6)
    forest = [index]  # rows of one fingerprint are one tree
    first = {k: int(np.flatnonzero(index == k)[0]) for k in range(len(f))}
    forest = [np.array([first[k] for k in index.tolist()])]
    for i, j in simhash.trie_pairs(place, f[index, 0], f[index, 1:], ways, 6, 3, 3, forest):
        forest[0] = simhash._joined(forest[0], i, j)
    want = groups_of(len(f), brute_pairs(f, 3, 3))
    roots = {k: forest[0][first[k]] for k in range(len(f))}
    for a, b in itertools.combinations(range(len(f)), 2):
        assert (want[a] == want[b]) == (roots[a] == roots[b])


def test_budget_prunes_the_documents_trie(monkeypatch):
    """Over the sf0.1 documents, against brute force."""
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 64)
    texts = duckdb.sql(f"SELECT DISTINCT text FROM '{LARGE}/documents.parquet' WHERE text IS NOT NULL ORDER BY text").df().text
    prints, has = simhash.fingerprints_of(pa.array(texts))
    f = np.unique(prints[has], axis=0)
    seen = Counter()
    got = trie_join(f, simhash.BUDGET, simhash.BUDGET_RUNS, seen=seen)
    assert set(got) == brute_pairs(f, simhash.BUDGET, simhash.BUDGET_RUNS)
    assert seen["pruned"] > 100_000 and seen["pruned"] > seen["visited"] / 3
    assert seen["compared"] < len(f) * (len(f) - 1) / 2 / 3


@pytest.mark.parametrize("most", [10**9, 3500, 3000, 700, 1])
def test_cut_follows_the_counts_of_nodes(spark, most):
    rng = np.random.default_rng(7)
    f0 = np.unique(rng.integers(-(2**63), 2**63 - 1, size=4000) & np.int64((1 << 56) - 1))  # the first eight bits are 0
    prints = spark.createDataFrame([(int(x),) for x in f0], "f0 bigint")
    ways = simhash.rotations(len(f0), simhash.BUDGET)
    at = simhash.plan_cut(prints, len(f0), ways, most)
    sent = lambda c: np.bincount(np.unique(simhash.node_rows(f0.view(np.uint64), ways, c)[1] >> 16, return_inverse=True)[1]).max()
    assert at.depth == simhash.MIN_DEPTH or sent(simhash.Cut(at.depth - 1)) > most  # the rotation of odd errors is counted as if all were sent
    assert bool(at.large) == bool(at.bits) == (at.depth == 12 and sent(simhash.Cut(12)) > most)
    assert sent(at) <= most or at.large
    if at.large:
        assert sent(at) < sent(simhash.Cut(12)) and list(at.large) == sorted(at.large)


@pytest.mark.parametrize(("depth", "bits"), [(6, 1), (6, 3), (10, 6)])
def test_split_nodes_find_the_same_pairs(depth, bits):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, size=(60, 2), dtype=np.uint64)
    turned = [(base[rng.integers(60)][0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, size=k, replace=False).astype(np.uint64)), np.uint64(k)) for k in range(1, 20) for _ in range(12)]
    f = np.unique(np.concatenate([base, np.array(turned, dtype=np.uint64)]), axis=0)
    f[:, 1] &= np.uint64(1)
    ways = simhash.rotations(10, simhash.BUDGET)
    nodes = np.unique(simhash.node_rows(f[:, 0], ways, simhash.Cut(depth))[1] >> 16)
    for large in (nodes, nodes[::2], nodes[:1]):
        index, place = trie_of(f, ways, depth, bits=bits, large=tuple(large.tolist()))
        got = {(min(a, b), max(a, b)) for i, j in simhash.trie_pairs(place, f[index, 0], f[index, 1:], ways, depth, simhash.BUDGET, 2) for a, b in zip(index[i].tolist(), index[j].tolist(), strict=True)}
        assert got == brute_pairs(f, simhash.BUDGET, 2)
        sizes = np.bincount(np.unique(place >> 16, return_inverse=True)[1])
        assert bits == 1 or sizes.max() <= max(np.bincount(np.unique(simhash.node_rows(f[:, 0], ways, simhash.Cut(depth))[1] >> 16, return_inverse=True)[1]))


def test_groups_with_large_nodes(spark, duck, sf_dir, monkeypatch):
    """The query with nodes that are all too large, against the query as it is."""
    want = {(r.doc_id, r.canonical_id) for r in simhash.op7_simhash_neardup(spark, sf_dir).collect()}
    plan = simhash.plan_cut
    monkeypatch.setattr(simhash, "plan_cut", lambda prints, n, ways: plan(prints, n, ways, 8))
    cuts = []
    monkeypatch.setattr(simhash, "_expand", lambda ways, at, f=simhash._expand: cuts.append(at) or f(ways, at))
    got = {(r.doc_id, r.canonical_id) for r in simhash.op7_simhash_neardup(spark, sf_dir).collect()}
    assert got == want and cuts[0].large


def groups_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_groups(ids, texts):
    """Least id of each document's group of near duplicates, by comparing all pairs."""
    f, has = simhash.fingerprints_of(pa.array(texts))
    rows = np.flatnonzero(has)
    order = rows[np.argsort(np.array(ids)[rows])]
    roots = groups_of(len(order), brute_pairs(f[order], simhash.BUDGET, simhash.BUDGET_RUNS))
    out = dict(zip(ids, ids, strict=True))
    out.update({ids[order[i]]: ids[order[r]] for i, r in enumerate(roots)})
    return out


def test_near_groups_against_brute_force(spark, duck, sf_dir):
    docs = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").df()
    want = near_groups(docs.doc_id.tolist(), docs.text.tolist())
    got = {r.doc_id: (r.canonical_id, r.is_kept) for r in simhash.op7_simhash_neardup(spark, sf_dir).collect()}
    assert got == {d: (c, c == d) for d, c in want.items()}
    assert len(set(want.values())) < len(want)


def test_near_copies_are_caught_and_others_left_alone(labelled):
    rng = np.random.default_rng(5)
    clean = labelled[(labelled.quality == 1) & (labelled.text.str.len() > 600)].drop_duplicates("text").text.tolist()[:400]
    vocabulary = sorted({w for t in clean for w in t.split()})
    copies = []
    for t in clean:
        words = t.split(" ")
        for k in rng.choice(len(words), size=max(1, len(words) // 25), replace=False):
            words[k] = vocabulary[rng.integers(len(vocabulary))]
        copies.append(" ".join(words))
    f, _ = simhash.fingerprints_of(pa.array(clean + copies))
    d = np.bitwise_count(f[: len(clean)] ^ f[len(clean) :])
    assert ((d[:, 0] <= simhash.BUDGET) & (d[:, 1:].sum(1) <= simhash.BUDGET_RUNS)).mean() > 0.95
    overlaps = true_overlaps(clean)
    found = brute_pairs(f[: len(clean)], simhash.BUDGET, simhash.BUDGET_RUNS)
    assert all(overlaps.get(p, 0) >= 0.3 for p in found)
    assert len(found) < len(clean) / 2


def edited(text, share, kind, rng, vocabulary):
    """``text`` with a share of its words changed or dropped, or as many inserted."""
    words = text.split()
    for k in sorted(rng.choice(len(words), size=max(1, round(len(words) * share)), replace=False), reverse=True):
        w = vocabulary[rng.integers(len(vocabulary))]
        words[k : k + 1] = {"changed": [w], "dropped": [], "inserted": [words[k], w]}[kind]
    return " ".join(words)


@pytest.mark.parametrize("kind", ["changed", "dropped", "inserted"])
@pytest.mark.parametrize("share", [0.05, 0.1])
def test_short_near_copies_are_caught(labelled, kind, share):
    rng = np.random.default_rng(8)
    texts = [t for t in labelled.text.drop_duplicates() if 30 <= len(t.split()) < 150][:400]
    vocabulary = sorted({w for t in texts for w in t.split()})
    f, _ = simhash.fingerprints_of(pa.array(texts + [edited(t, share, kind, rng, vocabulary) for t in texts]))
    d = np.bitwise_count(f[: len(texts)] ^ f[len(texts) :])
    assert len(texts) > 200 and ((d[:, 0] <= simhash.BUDGET) & (d[:, 1:].sum(1) <= simhash.BUDGET_RUNS)).mean() > 0.93


def test_short_texts_with_a_common_line_are_left_alone(spark):
    line = "The and attion to thanedble the, anea. Eriner thanea."
    texts = [f"{line}\nHaanon a ansh.\n{line}", f"Tion was thanonontioniner. Es heonanha thou threre thre.\nHendtion ates thble a, inreor heoning.\n{line}"]
    f, _ = simhash.fingerprints_of(pa.array(texts))
    assert brute_pairs(f, simhash.BUDGET, simhash.BUDGET_RUNS) == {(0, 1)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0].upper()])], "doc_id bigint, text string")
    assert {(r.doc_id, r.canonical_id) for r in simhash.near_duplicates(docs).collect()} == {(0, 0), (1, 1), (2, 0)}


def true_overlaps(texts):
    """Run Jaccard of the pairs of texts that share a run of three words. By enumeration of their words, not by fingerprints."""
    runs, having = [], defaultdict(list)
    for k, t in enumerate(texts):
        words = re.findall(r"\w+", t.lower())
        runs.append(set(zip(words, [*words[1:], ""], [*words[2:], "", ""], strict=False)))
        for r in runs[-1]:
            having[r].append(k)
    shared = Counter(p for v in having.values() for p in itertools.combinations(v, 2))
    return {(a, b): n / (len(runs[a]) + len(runs[b]) - n) for (a, b), n in shared.items()}


def test_near_copies_against_true_overlap():
    rng = np.random.default_rng(9)
    base = [t for (t,) in duckdb.sql("SELECT DISTINCT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY text").fetchall() if 10 <= len(t.split()) < 600]
    vocabulary = sorted({w for t in base for w in t.split()})
    copies = [edited(base[k], share, kind, rng, vocabulary) for kind in ("changed", "dropped", "inserted") for share in (0.05, 0.1) for k in rng.choice(len(base), size=60, replace=False)]
    texts = list({" ".join(re.findall(r"\w+", t.lower())): t for t in base + copies}.values())
    overlaps = true_overlaps(texts)
    f, _ = simhash.fingerprints_of(pa.array(texts))
    found = brute_pairs(f, simhash.BUDGET, simhash.BUDGET_RUNS)
    words = [len(re.findall(r"\w+", t)) for t in texts]
    for least, most in ((0, 150), (150, 600)):
        near = {p for p, x in overlaps.items() if x >= 0.5 and least <= min(words[p[0]], words[p[1]]) < most}
        assert len(near) > 60 and len(near & found) / len(near) > 0.95
    long = {p for p in found if min(words[p[0]], words[p[1]]) >= simhash.SHORT}
    assert sum(overlaps.get(p, 0) < 0.3 for p in long) <= len(long) / 100


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 300, size=(170, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(400, 480)}
    want = groups_of(500, pairs)
    got = {r.v: r.root for r in simhash.connected(spark.createDataFrame(sorted(pairs), "a bigint, b bigint"), one_task).collect()}
    assert got == {v: want[v] for p in pairs for v in p}
    assert simhash.connected(spark.createDataFrame([], "a bigint, b bigint"), one_task).count() == 0


# --- WARC ---


def records(n):
    return [warc.record_bytes(i, f"http://h/{i}", f"<html>{'x' * (i * 37 % 5000)}\r\n\r\nWARC/1.0 {i}</html>") for i in range(n)]


def statuses(stream):
    out = io.BytesIO()
    rows = list(warc.normalise(io.BytesIO(stream), out))
    for r in rows:  # what the index points at can be read
        if r["status"] == "ok":
            assert zlib.decompress(out.getvalue()[r["offset"] : r["offset"] + r["length"]], 31).startswith(b"WARC/")
    return [(r["record"], r["status"]) for r in rows]


def test_stream_that_breaks_off_between_records_says_so():
    members = [gzip.compress(r) for r in records(4)]
    whole = [(k, "ok") for k in range(4)]
    damaged = b"\x00\x01" + members[2][2:]
    # reading goes on behind the damage
    assert statuses(b"".join([*members[:2], damaged, members[3]])) == [*whole[:2], (2, "corrupt"), (3, "ok")]
    assert statuses(b"".join([*members[:2], b"garbage, not zeros", *members[2:]])) == [*whole[:2], (2, "corrupt"), (3, "ok"), (4, "ok")]
    half = members[1][: len(members[1]) // 2]
    assert statuses(b"".join([members[0], half, *members[2:]]))[:2] == [(0, "ok"), (1, "corrupt")]
    assert statuses(b"".join(members)[: -len(members[3])] + members[3][:10]) == [*whole[:3], (3, "truncated")]
    assert statuses(gzip.compress(b"".join(records(4)))[:-8]) == [*whole, (4, "truncated")]
    assert statuses(b"no gzip") == [(0, "corrupt")]
    assert statuses(b"".join(members)) == statuses(b"".join(members) + bytes(700)) == whole
    assert statuses(b"") == [(0, "empty")]


@pytest.mark.parametrize("cut", range(1, 400, 7))
def test_each_cut_of_a_stream_has_a_status(cut):
    raw = gzip.compress(b"".join(records(3)))
    got = statuses(raw[:cut]) if cut < len(raw) else []
    assert cut >= len(raw) or got[-1][1] == "truncated"


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ("Content-Length: \u00b2", "malformed"), ("Content-Length: -1", "malformed"), ("Content-Length: 99999999999999999999", "malformed"), ("X: y", "malformed"), ("Content-Length: 2", "ok"),
        ("Content-Length: 2\r\nWARC-Page-Id: --5", "ok"), ("Content-Length: 2\r\nWARC-Page-Id: \u00b2", "ok"), ("Content-Length: 2\r\nWARC-Page-Id: 99999999999999999999", "ok"),
    ],
)
def test_odd_numbers_in_heads(head, want):
    stream = gzip.compress(f"WARC/1.0\r\n{head}\r\n\r\nab\r\n\r\n".encode())
    (row,) = warc.normalise(io.BytesIO(stream), io.BytesIO())
    assert row["status"] == want and row["page_id"] is None


def test_head_without_an_end_is_not_held(monkeypatch):
    monkeypatch.setattr(warc, "HEAD", 5000)
    stream = gzip.compress(b"WARC/1.0\r\n" + b"x: y\r\n" * 10**6) + gzip.compress(records(1)[0])
    assert statuses(stream) == [(0, "malformed")]


def test_files_are_normalised_in_tasks_of_their_own(spark, tmp_path):
    from pyspark.sql import functions as F

    for k in range(5):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(b"".join(records(k))))
    (tmp_path / "5.warc.gz").write_bytes(gzip.compress(records(1)[0]) + b"garbage" + gzip.compress(records(2)[1]))
    files = spark.createDataFrame([(f"file://{tmp_path}/{k}.warc.gz",) for k in (*range(6), 3)] + [(None,)], "file string")
    index = warc.normalise_files(files, f"file://{tmp_path}/out").withColumn("task", F.spark_partition_id()).collect()
    by_file = defaultdict(list)
    for r in index:
        by_file[r.file].append(r)
    assert len(by_file) == 6 == len({r.task for r in index})
    assert sorted([r.status for r in x] for x in by_file.values()) == sorted([["empty"], ["ok"], ["ok"] * 2, ["ok"] * 3, ["ok"] * 4, ["ok", "corrupt", "ok"]])
    assert all(warc.read_record(r.file, r.offset, r.length)[0]["warc-target-uri"] == r.url for r in index if r.status == "ok")


@pytest.mark.parametrize("members", [1, 3, 40])
def test_normaliser_round_trip(members):
    rs = records(40)
    raw = b"".join(gzip.compress(b"".join(rs[i::1][: 40 // members] if False else rs[i * 40 // members : (i + 1) * 40 // members])) for i in range(members))
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(raw), out))
    data = out.getvalue()
    assert [r["record"] for r in index] == list(range(40)) and {r["status"] for r in index} == {"ok"}
    assert sum(r["length"] for r in index) == len(data)
    for r, want in zip(index, rs, strict=True):
        assert zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31) == want
    assert gzip.decompress(data) == b"".join(rs)


def test_normaliser_on_broken_files():
    rs = records(5)
    raw = gzip.compress(b"".join(rs))
    whole = list(warc.normalise(io.BytesIO(raw), io.BytesIO()))
    short = list(warc.normalise(io.BytesIO(raw[: len(raw) - 60]), io.BytesIO()))
    assert short[-1]["status"] == "truncated" and short[:-1] == whole[: len(short) - 1]
    bad = list(warc.normalise(io.BytesIO(gzip.compress(rs[0] + b"WARC/1.0\r\nX: y\r\n\r\n")), io.BytesIO()))
    assert [r["status"] for r in bad] == ["ok", "malformed"]


def test_warc_pages_round_trip(spark, duck, sf_dir):
    html = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    index = registry.QUERIES["op9_warc_normalise"](spark, sf_dir).collect()
    assert {r.page_id for r in index} == set(html)
    for r in index[::7]:
        head, content = warc.read_record(r.file, r.offset, r.length)
        assert content.partition(b"\r\n\r\n")[2].decode() == html[r.page_id] and head["warc-target-uri"] == r.url


# --- pipeline ---


def test_pipeline_against_brute_force(spark, duck, sf_dir):
    d = duck.sql("SELECT * FROM documents ORDER BY doc_id").df()
    model = ordinal.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = d[ordinal.score(pa.array(d.text), model)[1] < ordinal.TOXIC_FROM]
    d = d.drop_duplicates("text")
    near = near_groups(d.doc_id.tolist(), d.text.tolist())
    d = d[[near[i] == i for i in d.doc_id]]
    con = duckdb.connect()
    con.register("left_over", d)
    kept = con.sql(mixing.mixing_sql("left_over", "doc_id, n_tokens, md5('pack:' || doc_id) AS key", budget_share=corpus_pipeline.MIX_BUDGET_SHARE)).df()
    kept = kept[kept.n_tokens > 0].sort_values(["key", "doc_id"]).reset_index(drop=True)
    want = {(int(kept.doc_id[i]), s, b, t) for i, s, b, t in brute_pack(kept.n_tokens.tolist(), packing.CAPACITY, packing.OPEN_BINS)}
    got = {(r.doc_id, r.token_start, r.bin, r.bin_start) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
