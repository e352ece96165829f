"""The models against plain loops, and the pipeline's stages against what their operators decide."""

import math
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import exact_dedup, language_id, line_dedup, packing, paragraph_sketch, quality, simhash, simhash_similar

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def loop_probabilities(net, raw):
    """A document's distribution, byte by byte, one window after the other, in plain numbers."""
    hidden, kinds = net.u.shape[1], len(net.labels)
    x, u, v, c = (w.tolist() for w in net.weights)
    total = [0.0] * kinds
    for at in range(0, len(raw), language_id.WINDOW):
        piece = raw[at : at + language_id.WINDOW]
        window = piece + b"\0" * (language_id.WINDOW - len(piece))
        seen = []
        for way, read in enumerate((window, window[::-1])):
            h, states = [0.0] * hidden, []
            for byte in read:
                a = x[way][byte]
                hu = [sum(h[i] * u[way][i][j] for i in range(hidden)) for j in range(3 * hidden)]
                z = [sigmoid(a[j] + hu[j]) for j in range(hidden)]
                r = [sigmoid(a[hidden + j] + hu[hidden + j]) for j in range(hidden)]
                n = [math.tanh(a[2 * hidden + j] + r[j] * hu[2 * hidden + j]) for j in range(hidden)]
                h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(hidden)]
                states.append(h)
            seen.append(states if way == 0 else states[::-1])
        for t in range(len(piece)):
            logits = [c[k] + sum(seen[0][t][j] * v[0][j][k] + seen[1][t][j] * v[1][j][k] for j in range(hidden)) for k in range(kinds)]
            e = [math.exp(y - max(logits)) for y in logits]
            total = [s + y / sum(e) for s, y in zip(total, e)]
    return [s / max(1, len(raw)) for s in total]


@pytest.fixture(scope="module")
def short(docs):
    """Documents that a plain loop gets through, whole texts, with odd ones."""
    return docs.where("length(text) < 1500").limit(40).unionByName(docs.sparkSession.createDataFrame([(-1, None, "en", "x", 0), (-2, "", None, "x", 0), (-3, "123 ...", "de", "x", 7), (-4, "ä", "de", "x", 1)], docs.schema))


def test_language_against_a_loop(docs, short):
    net = language_id.fit(docs)
    found = short.select("doc_id", "text", language_id.identify(F.col("text"), net).alias("p")).select("doc_id", "text", "p.*").collect()
    assert len(found) == 44
    for r in found:
        text = r["text"] or ""
        if not any(ch.isalpha() for ch in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        p = loop_probabilities(net, text.encode())
        assert net.labels[p.index(max(p))] == r["lang_pred"] and abs(max(p) - r["score"]) < 1e-4


def test_language_is_fitted_alike(docs):
    """The same rows give the same network, however they are dealt."""
    a, b = language_id.fit(docs), language_id.fit(docs.repartition(7))
    assert all((x == y).all() for x, y in zip(a.weights, b.weights))


def test_language_stage(spark, docs):
    """What the stage keeps is what the network tells of all rows, by the stage's threshold."""
    told = language_id.predictions(docs).collect()
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= 0.35} and 0 < len(kept)
    assert kept >= {r["doc_id"] for r in docs.where("lang is not null and length(text) > 200").collect()}


def loop_score(model, text):
    raw = (text or "").encode()
    if not raw:
        return 1 / (1 + math.exp(-model.intercept))
    import zstandard

    def size(dictionary):
        total = 0
        for i in range(0, len(raw), quality.BLOCK):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(c.compress(raw[i : i + quality.BLOCK]))
        return total

    saved = (size(model.bad) - size(model.good)) / len(raw)
    return 1 / (1 + math.exp(-max(-60, min(60, model.slope * saved + model.intercept))))


def test_quality_against_a_loop(docs, labels, short):
    model = quality.fit(docs, labels)
    for r in short.select("doc_id", "text", quality.score(F.col("text"), model).alias("s")).collect():
        assert abs(loop_score(model, r["text"]) - r["s"]) < 1e-12


def test_quality_stage(spark, docs, labels):
    told = quality.scores(docs, labels).collect()
    kept = {r["doc_id"] for r in corpus_pipeline.good(spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in told if r["score"] >= 0.5} and 0 < len(kept) < len(told)


# stages in odd cases

ODD = [(1, "some words in a row that say nothing at all", "en"), (1, "some words in a row that say nothing at all", "en"), (2, None, None), (3, "", "en"), (4, " \n", "fr"), (None, "without an id but with words in it", "en"), (5, "ein Satz mit Wörtern, die nichts sagen", "de"), (6, "word " * 20000, "en")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_in_odd_cases(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    odd = odd.withColumns({c: F.lit(c) for c in ("row", "p", "s", "fp", "root", "node", "digest", "quality", "source", "key", "cells")})
    got = stage(spark, odd, SF)
    rows = got.collect()
    if name == "packing":
        # every row has at least its end token, and nothing is lost
        assert sum(r["length"] for r in rows) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] * sum(x["doc_id"] == r["doc_id"] and x["start"] == 0 and x["doc_tokens"] == r["doc_tokens"] for x in rows) for r in rows}.values())
        assert {r["doc_id"] for r in rows} == {r[0] for r in ODD}
    else:
        assert got.columns == odd.columns
        assert all(tuple(r)[:3] in [(i, t, g) for i, t, g in ODD] for r in rows)
    if name == "near_dedup":
        assert sorted((r["doc_id"] for r in rows), key=repr) == sorted([1, 2, None, 5, 6], key=repr)
    if name == "exact_dedup":
        # of the texts without characters the longest stays
        assert sorted((r["doc_id"] for r in rows), key=repr) == sorted([1, 4, None, 5, 6], key=repr)
    if name == "language":
        assert {2, 3, 4} & {r["doc_id"] for r in rows} == set()
    empty = stage(spark, odd.limit(0), SF)
    assert empty.collect() == [] and (name == "packing" or empty.columns == odd.columns)


def test_string_ids(spark):
    """Ids need not be numbers."""
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    df = spark.createDataFrame([("b", words), ("a", words + " "), ("c", "quite another text of its own kind here"), ("d", words.replace("ten", "ten "))], "doc_id string, text string")
    # the longest text stays, of equal ones the smallest id
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.decisions(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "a"}
    assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == {"a", "c"}
    assert {r["doc_id"] for r in simhash_similar.keep_first(df).collect()} == {"a", "c"}
    assert {(r["doc_id"], r["copies"]) for r in line_dedup.near_lines(df).collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", 1)}


def test_pack_examples_odd(spark):
    schema = "id long, tokens long, loss long, sequence_id string"
    df = spark.createDataFrame([(1, 100, 50, "x"), (2, None, None, "x"), (3, 3000, 10, "x"), (4, 2000, 2000, "x"), (4, 2000, 2000, "x"), (None, 1, 1, "x")], schema)
    got = packing.pack_examples(df, "id", "tokens", "loss").collect()
    assert len(got) == 6 and {r["id"] for r in got if r["oversize"]} == {3}
    assert packing.pack_examples(df.limit(0), "id", "tokens", "loss").collect() == []


def test_sketch_way_out(monkeypatch):
    """Digests that fall into the same cells of every table are told apart without one."""
    monkeypatch.setattr(paragraph_sketch, "_places", lambda keys, owner, cells: [owner * (paragraph_sketch.PARTS * cells) + i * cells for i in range(paragraph_sketch.PARTS)])
    old, new = (paragraph_sketch.paragraph_digests(t) for t in ("one. two. three.", "one. two. four. five."))
    ((removed, added),) = paragraph_sketch.differences([old], [new])
    assert set(removed.tolist()) == set(old.tolist()) - set(new.tolist()) and set(added.tolist()) == set(new.tolist()) - set(old.tolist())
