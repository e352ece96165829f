"""The training-data operators against brute force, and their defined results in odd cases."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import exact_dedup, language_id, line_dedup, packing, paragraph_sketch, quality, queries, sentencepiece_fst, simhash, simhash_similar, url_filter, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
#: Nulls, empty and blank texts, a long text, repeated rows and an id twice.
ODD = [
    (1, "alpha beta gamma delta epsilon", "en"), (2, "alpha  beta gamma delta epsilon", "en"), (3, "alpha beta gamma delta epsilon", None), (4, None, "en"), (5, "", None), (6, " \n\t", "fr"),
    (7, "word " * 30000, "en"), (8, "ein Wort und noch ein Wort", "de"), (8, "ein Wort und noch ein Wort", "de"), (9, "1234 !!", "en"), (None, "no id here but text", "fr"), (10, "héllo 😀 wörld ▁ <|endoftext|>", "de"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(c) for c in ("row", "digest", "fp", "root", "p", "s", "id", "norm", "keep_id", "line", "key", "score")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# exact dedup


def test_exact_dedup_odd(odd):
    got = rows(exact_dedup.decisions(odd))
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault((t or "").translate(SPACE), []).append((-len(t or ""), i is None, i))
    assert len(got) == len(ODD)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = by_sha[r["text_sha256"]]
        assert r["keep_id"] == min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2] and r["group_size"] == len(members)
    kept = rows(exact_dedup.deduplicate(odd))
    assert len(kept) == len(groups) and set(kept[0]) == set(odd.columns)
    assert {r["doc_id"] for r in kept} == {1 + 1, 6, 7, 8, 9, 10, None}


def test_exact_dedup_empty(empty):
    assert rows(exact_dedup.decisions(empty)) == [] and rows(exact_dedup.deduplicate(empty)) == []


def test_exact_dedup_collisions(spark, monkeypatch):
    """Contents with one digest stay apart: every content is compared."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab" * 32))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact_dedup.decisions(df))) == [(1, 3, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 2, 2, False)]
    assert sorted(r["doc_id"] for r in rows(exact_dedup.deduplicate(df))) == [2, 3]


# near duplicates


def brute_components(prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    values = {0}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << bit
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["a"], r["b"]) for r in rows(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")))}
    wanted = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == wanted and wanted


def test_simhash_documents(docs):
    import xxhash

    got = rows(simhash.components(docs))
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}

    def slow(text):
        words = (text or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = {i: slow(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == prints
    of = brute_components(set(prints.values()))
    lowest = {}
    for i, f in prints.items():
        lowest[of[f]] = min(lowest.get(of[f], i), i)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: lowest[of[f]] for i, f in prints.items()}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in rows(kept)) == sorted(lowest.values())


def test_simhash_grids_are_not_broadcast(spark):
    """A table of fingerprints small enough to broadcast has many times its rows in the grids: none is sent to the driver, before or during the run."""
    signed = [int(v) for v in np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 300)]
    found = simhash.links(spark.createDataFrame([(v,) for v in [*signed, signed[0] ^ 5]], "fp long"))
    assert [(r["a"], r["b"]) for r in found.collect()] == [tuple(sorted((signed[0], signed[0] ^ 5)))]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_odd(odd, empty):
    got = rows(simhash.components(odd))
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["fp"] == 0} == {4}
    assert set(rows(simhash.keep_first(odd))[0]) == set(odd.columns)
    assert len(rows(simhash.keep_first(odd))) == len({r["root"] for r in got})
    assert rows(simhash.components(empty)) == [] and rows(simhash.keep_first(empty)) == []


# near dedup


def brute_jaccard(texts):
    """Pairs of places in ``texts`` at a five-word Jaccard similarity of 0.8 or more."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def brute_kept(ids, pairs):
    of = {i: i for i in range(len(ids))}
    for a, b in sorted(pairs):
        of = {k: of[a] if v == of[b] else v for k, v in of.items()}
    return sorted({min(ids[k] for k in of if of[k] == c) for c in of.values()})


def test_near_stage_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(5)
    texts = []
    for size in (12, 40, 90, 200):
        for _ in range(6):
            # a passage that all share, and copies with words changed at places
            base = ["common"] * 2 + [f"passage{i}" for i in range(10)] + [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (0, 1, 1, 2, 3, 4, 5):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(copy).upper() if changes == 0 else " ".join(copy))
    texts += ["", "  ", "one two", "one  two"]
    near = brute_jaccard(texts)
    wanted = brute_kept(list(range(len(texts))), near)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in rows(corpus_pipeline.near(spark, df, SF))) == wanted and len(wanted) > 24


def test_near_asks_a_component_once(spark):
    """A text that is near many members of a component has one link to it, not one to each."""
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base[:at] + [f"x{at}"] + base[at + 1 :]) for at in range(5, 145, 10)] + ["quite another text of its own kind here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketch = simhash_similar.prints(F.col("text"), simhash_similar.AXES, 2)
    found = df.select("doc_id", sketch.alias("p")).select("doc_id", "p.node", *[f"p.{w}" for w in simhash_similar.WORD_NAMES]).cache()
    nodes = {r["doc_id"]: r["node"] for r in found.collect()}
    hub, asking = nodes[0], [nodes[12], nodes[13], nodes[14]]
    members = spark.createDataFrame([(nodes[i], hub) for i in range(12)], "node long, hub long")
    asked = simhash_similar._asked(spark.createDataFrame([(n, hub) for n in asking], "node long, hub long"), members, df, found, "doc_id", "text", simhash_similar.WORDS, simhash_similar.SIMILARITY)
    assert sorted((r["a"], r["b"]) for r in asked.collect()) == sorted((min(n, hub), max(n, hub)) for n in asking[:2])


def test_near_crowded_against_brute_force(spark):
    """Cells that many near texts, some of them linked only through others, and texts just under the similarity share."""
    rng = random.Random(7)
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for changes in (1, 2, 3, 4, 5, 6) * 12:
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    wanted = brute_kept(list(range(len(texts))), brute_jaccard(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in rows(simhash_similar.keep_first(df))) == wanted and len(wanted) < len(texts)


def test_near_odd(odd, empty):
    got = rows(simhash_similar.components(odd))
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (4, 5, 6)} == {4}
    kept = rows(simhash_similar.keep_first(odd))
    assert set(kept[0]) == set(odd.columns) and len(kept) == len({r["root"] for r in got})
    assert rows(simhash_similar.components(empty)) == [] and rows(simhash_similar.keep_first(empty)) == []


# lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    lines = []
    for _ in range(40):
        s = "".join(rng.choice("abcé") for _ in range(rng.choice((5, 6, 7, 9, 12, rng.randint(16, 22)))))
        lines.append(s)
        for _ in range(rng.randint(0, 3)):
            t = list(s)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 1)] = [rng.choice("abcé")] * rng.randint(0, 1)
            lines.append("".join(t))
    texts = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(-(-len(lines) // 4))] + [(90, None), (91, ""), (92, "short\n short \n\n")]
    got = rows(line_dedup.near_lines(spark.createDataFrame(texts, "doc_id long, text string")))
    places = {}
    for i, t in texts:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                places.setdefault(line.strip(), []).append((i, n))
    distinct = list(places)
    near = [(a, b) for a, b in itertools.combinations(distinct, 2) if min(len(a), len(b)) >= 6 and edits(a, b) <= 2]
    counts = {d: sum(d in pair for pair in near) for d in distinct}
    parent = {d: d for d in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[find(a)] = find(b)
    first = {}
    for d in distinct:
        first[find(d)] = min(first.get(find(d), (1 << 60, 0)), min(places[d]))
    wanted = {(i, n, len(p), counts[d], *first[find(d)]) for d, p in places.items() for i, n in p}
    assert {(r["doc_id"], r["line_no"], r["copies"], r["links"], r["class_doc_id"], r["class_line_no"]) for r in got} == wanted and near


def test_lines_of_repeated_places(spark):
    """Several null ids, and one id with different texts: a place names no line."""
    one, other, third = "the quick brown fox jumps", "an altogether different line", "nothing like any of the others"
    texts = [(None, f"{one}\n{third}"), (None, f"{other}\n{third}!"), (None, f"{one}s"), (5, f"{other}?"), (5, f"{third}?\nsome line that stands alone"), (5, "one more line that stands alone")]
    got = rows(line_dedup.near_lines(spark.createDataFrame(texts, "doc_id long, text string")))
    found = sorted(((r["doc_id"], r["line_no"], r["copies"], r["links"], r["class_doc_id"], r["class_line_no"], r["kept"]) for r in got), key=repr)
    wanted = [
        (None, 0, 1, 1, None, 0), (None, 0, 1, 1, None, 0),  # one, one + s
        (None, 0, 1, 1, 5, 0), (5, 0, 1, 1, 5, 0),  # other, other?
        (None, 1, 1, 2, 5, 0), (None, 1, 1, 2, 5, 0), (5, 0, 1, 2, 5, 0),  # third, third!, third?
        (5, 1, 1, 0, 5, 1), (5, 0, 1, 0, 5, 0),
    ]
    assert [r[:6] for r in found] == sorted(wanted, key=repr)
    assert sum(r[6] for r in found) == 5


def test_lines_odd(odd, empty):
    assert len(rows(line_dedup.near_lines(odd))) == sum(bool((t or "").translate(SPACE)) for _, t, _ in ODD)
    assert rows(line_dedup.near_lines(empty)) == []


# packing


def check_pieces(pieces, ids_of, limits):
    used, segments, parts = {}, {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == used.get(p["sequence_id"], 0) and p["length"] > 0
        used[p["sequence_id"]] = p["offset"] + p["length"]
        segments[p["sequence_id"]] = segments.get(p["sequence_id"], 0) + 1
        parts.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    assert max(used.values()) <= limits.tokens and max(segments.values()) <= limits.segments
    for doc, found in parts.items():
        ids, at = ids_of[doc], 0
        for start, length, crc, total in sorted(found):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    return used


def test_packing_documents(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids_of = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows(docs)}
    used = check_pieces(rows(packing.pack_documents(docs, path)), ids_of, packing.Limits())
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values())


def test_packing_odd(odd, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    got = rows(packing.pack_documents(odd, path))
    assert {r["doc_id"] for r in got} == {i for i, _, _ in ODD} and [r["doc_tokens"] for r in got if r["doc_id"] in (4, 5, 6)] == [1, 1, 1]
    assert rows(packing.pack_documents(empty, path)) == []


def test_packing_examples(spark):
    rng = random.Random(1)
    data = [(i, rng.randint(1, 900), 0) for i in range(500)] + [(900, 5000, 10), (901, None, None), (902, 100, 3000)]
    data = [(i, t, None if t is None else l or rng.randint(0, t)) for i, t, l in data]
    limits = packing.Limits(2048, 8, 700)
    got = rows(packing.pack_examples(spark.createDataFrame(data, "id long, t long, l long"), "id", "t", "l", limits))
    assert sorted(r["id"] for r in got) == sorted(i for i, _, _ in data)
    sums = {}
    for r in got:
        s = sums.setdefault(r["sequence_id"], [0, 0, 0, False])
        s[0], s[1], s[2], s[3] = s[0] + r["tokens"], s[1] + 1, s[2] + r["loss_tokens"], s[3] or r["oversize"]
    assert all(over or (t <= 2048 and n <= 8 and l <= 700) for t, n, l, over in sums.values())
    assert {r["id"] for r in got if r["oversize"]} == {i for i, t, l in data if (t or 0) > 2048 or (l or 0) > 700}


# URL rules


def test_url_rules_odd(spark):
    urls = [None, "", "no scheme", "http://com", "http://COM/x", "https://www.example.com/en/1?a#b", "http://a.example.com/en/", "http://example.com/en", "http://xcom/", "ftp://b.net/es/1", "http://b.net#/es/", "a://b://c.com/d"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(3, "http://com", "x"), (None, "http://q.com/", "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((r["page_id"] if r["page_id"] is not None else 99, r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter.judge(pages, rules)) if r["page_id"] != 3)
    assert got == [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (4, "com", "/x", "com/", "allow"), (5, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (6, "a.example.com", "/en/", "example.com/en/", "block"), (7, "example.com", "/en", "com/", "allow"), (8, "xcom", "/", None, "allow"), (9, "b.net", "/es/1", "net/es/", "block"),
        (10, "b.net", "", None, "allow"), (11, "b:", "//c.com/d", None, "allow"), (99, "q.com", "/", "com/", "allow"),
    ]
    assert {r["verdict"] for r in rows(url_filter.judge(pages, rules.limit(0)))} == {"allow"} and rows(url_filter.judge(pages.limit(0), rules)) == []


def test_blocked_filter_loses_nothing(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.blocked_filter(keys.where("key <> 'k5'"), "key", 2048)
    assert bloom.count() <= 2048 and url_filter.possible_hits(keys, "key", bloom, 2048).count() >= 19999
    other = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert url_filter.possible_hits(other, "key", bloom, 2048).count() < 4000


# archives


def test_warc_odd(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/", "same"), (5, "http://b/", "same"), (5, "http://b/", "same"), (None, None, "same"), (7, "u", None), (8, "u\r\nX: y", ""), (9, "u", "ends\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", "é" * 70000)],
        "page_id long, url string, html string",
    )
    raw, clean, strict = (str(tmp_path / x) for x in ("raw", "clean", "strict"))
    warc.write_pages(pages, raw, file_records=3)
    back = rows(warc.read_records(spark, raw))
    assert sorted(bytes(r["payload"]) for r in back) == sorted((h or "").encode() for _, _, h in [tuple(r) for r in pages.collect()])
    warc.deduplicate(spark, raw, clean)
    got = sorted((r["page_id"] or 0, r["warc_type"], r["refers_to"], r["payload_bytes"]) for r in rows(warc.read_records(spark, clean)))
    assert [g for g in got if g[0] not in (5,)] == [(0, "revisit", 5, 4), (1, "revisit", 5, 4), (7, "revisit", 8, 0), (8, "response", None, 0), (9, "response", None, 20), (10, "response", None, 140000)]
    assert sorted(g[1] for g in got if g[0] == 5) == ["response", "revisit"]
    warc.deduplicate(spark, clean, strict)  # revisits of an archive that has them stay
    assert sorted((r["page_id"] or 0, r["warc_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in rows(warc.read_records(spark, strict))) == [(a, b, c or 0, d) for a, b, c, d in got]
    warc.deduplicate(spark, raw, str(tmp_path / "most"), min_bytes=5)
    assert {r["warc_type"] for r in rows(warc.read_records(spark, str(tmp_path / "most")))} == {"response"}
    warc.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert rows(warc.read_records(spark, str(tmp_path / "none"))) == []


# sketches


def test_sketches_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    data = [(i * 7 % 41, t) for i, t in enumerate(texts)] + [(100, None), (101, "")]
    got = {r["doc_id"]: r for r in rows(paragraph_sketch.sketch_documents(spark.createDataFrame(data, "doc_id long, text string"), buckets=5))}
    ordered = sorted(((i, t or "") for i, t in data), reverse=True)
    assert len(got) == len(data)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        sets = [set(paragraph_sketch.paragraph_digests(t).tolist()) for t in (text, edited, after)]
        like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(sets[0], sets[1])) and r["near_next"] == pytest.approx(like(sets[0], sets[2]))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited or sets[0] == sets[1])


def test_sketch_differences(spark, empty, odd):
    pair = spark.createDataFrame([(1, "a\nb\nb", "b\na\nc"), (2, None, "x")], "id long, old string, new string")
    got = {r["id"]: r for r in rows(paragraph_sketch.compare_versions(pair, "id", "old", "new"))}
    assert (len(got[1]["removed"]), len(got[1]["added"]), len(got[2]["added"])) == (1, 1, 1)
    assert len(rows(paragraph_sketch.sketch_documents(odd))) == len(ODD) and rows(paragraph_sketch.sketch_documents(empty)) == []


# tokens


def test_transducer_is_the_model(odd, empty, docs):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdetinorsh .,éñß▁ \n日本0😀") for _ in range(rng.randint(0, 16))) for _ in range(3000)] + [r["text"] for r in rows(docs)][:40]
    for text, ids in zip(texts, fst.encode(texts)):
        assert ids == model.encode(text) and fst.decode(ids) == model.decode(ids)
    got = rows(sentencepiece_fst.digest_documents(odd, path))
    assert len(got) == len(ODD) and [r["round_trip"] for r in got if r["doc_id"] == 10] == [False]
    assert rows(sentencepiece_fst.encode_documents(empty, path)) == []


# models


def test_language_gradients():
    net = language_id.Network.fresh(["a", "b", "c"], 4)
    net.x, net.u, net.v, net.c = (w.astype(np.float64) for w in net.weights)
    rng = np.random.default_rng(0)
    windows, mask, goal = rng.integers(97, 101, (6, 5)).astype(np.uint8), np.ones((6, 5)), rng.integers(0, 3, 5)
    _, grads = net.gradients(windows, mask, goal)
    for w, g, at in zip(net.weights, grads, [(1, 98, 5), (0, 1, 2), (1, 2, 1), (2,)]):
        was = w[at]
        w[at] = was + 1e-3
        up, _ = net.gradients(windows, mask, goal)
        w[at] = was - 1e-3
        down, _ = net.gradients(windows, mask, goal)
        w[at] = was
        assert (up - down) / 2e-3 == pytest.approx(g[at], abs=1e-5)


def test_language_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in rows(language_id.predictions(docs))}
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in rows(docs) if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([a == b for a, b in held]) > 0.97
    told = {r["doc_id"]: r for r in rows(language_id.predictions(odd))}
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 for i in (4, 5, 6, 9)) and None in told
    assert language_id.keep_known(odd).columns == odd.columns and rows(language_id.predictions(empty)) == []


def test_quality_held_out(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in rows(quality.scores(docs, labels))}
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in rows(labels) if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.93 and all(0 <= r["score"] <= 1 for r in got.values())
    few = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 5)], "doc_id long, quality int")
    assert len(rows(quality.scores(odd, few))) == len(ODD)
    assert {r["score"] for r in rows(quality.scores(odd, few.limit(0)))} == {0.5}
    assert quality.keep_good(odd, few).columns == odd.columns and rows(quality.scores(empty, few)) == []


def test_near_grids_join_by_range(spark):
    """Counts of two-bit segments are the coordinates; texts a step apart in a grid meet, those of an equal cell are the fewer."""
    rng = random.Random(11)
    left = [[f"w{rng.randrange(10**6)}" for _ in range(180)] for _ in range(150)]
    # two changed words of 180, five shingles each: a similarity of some 0.8 for four of them
    right = [[f"x{i}" if i in {20, 60, 100, 140} else w for i, w in enumerate(t)] for t in left]
    texts = [" ".join(t) for t in left + right]
    grids = simhash_similar.grids_for()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", simhash_similar.prints(F.col("text"), simhash_similar.AXES, grids)["cells"].alias("cells"))
    reached = F.flatten(F.transform("cells", lambda c: simhash_similar.cells_within(c, simhash_similar.AXES)))
    found = {r["doc_id"]: (set(r["cells"]), set(r["reached"])) for r in df.withColumn("reached", reached).collect()}
    digits = lambda c: [c >> 2 * i & 3 for i in range(simhash_similar.AXES)]
    assert {d for own, _ in found.values() for c in own for d in digits(c)} == {0, 1, 2}
    for i in range(len(left)):
        (own, reach), (other, reach_other) = found[i], found[i + len(left)]
        for a in own:
            for b in other:
                if a >> 26 == b >> 26 and sum(abs(x - y) for x, y in zip(digits(a), digits(b))) <= 1:
                    assert reach & reach_other
    equal, met = (sum(bool(found[i][k] & found[i + len(left)][k]) for i in range(len(left))) for k in (0, 1))
    assert met > 0.95 * len(left) > 1.5 * equal


def test_near_mates_of_cells(monkeypatch):
    """Every near pair of a cell is told, or both of it are members of a crowded cell; a member's mate is the smallest one near it."""
    rng = np.random.default_rng(13)
    monkeypatch.setattr(simhash_similar, "EACH", 60)
    monkeypatch.setattr(simhash_similar, "LEADERS", 5)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    sizes = [1, 2, 3, 9, 20, 40, 60, 61, 90, 1]
    cell = np.repeat(np.arange(len(sizes)), sizes)
    node = np.concatenate([np.sort(rng.choice(10**6, n, False)) for n in sizes])
    # cells of six families, and some whose members are all alike
    word = base[rng.integers(0, 6, len(cell))] ^ (np.uint64(1) << rng.integers(0, 64, len(cell), np.uint64))
    word[cell == 3] = word[cell == 3][0]
    one, other, member, smallest = simhash_similar.mates_of(cell, node, word, 21)
    near = {(i, j) for i, j in itertools.combinations(range(len(cell)), 2) if cell[i] == cell[j] and bin(int(word[i] ^ word[j])).count("1") <= 21}
    pairs, members = {(int(j), int(i)) for i, j in zip(one, other)}, set(member.tolist())
    assert len(pairs) == len(one) and pairs <= near and all((i in members and j in members) for i, j in near - pairs) and not {cell[i] for i, _ in pairs} & {cell[i] for i in members}
    assert {int(cell[i]) for i in members} >= {3, 7, 8} and {i for i in range(len(cell)) if cell[i] in (7, 8)} <= members
    for i, mate in zip(member.tolist(), smallest.tolist()):
        lower = [j for j in range(i) if (j, i) in near and (sizes[cell[i]] <= 60 or j < np.searchsorted(cell, cell[i]) + 5)]
        assert mate == min(lower, default=-1)
    assert all(len(x) == 0 for x in simhash_similar.mates_of(cell[:0], node[:0], word[:0], 21))


def test_near_chance_leaves_no_rows(spark, monkeypatch):
    """Texts that share cells by chance alone, many in each as in a large table, are compared in their cells: none is written as a member of a crowded one."""
    rng, written = random.Random(17), {}
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(400)]
    texts.append(" ".join([*texts[0].split()[:-1], "other"]))

    def noted(df, label, into=None, keep=simhash_similar.materialize):
        df = keep(df, label, into)
        written[label] = written.get(label, 0) + df.count()
        return df

    monkeypatch.setattr(simhash_similar, "materialize", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.components(df, axes=4).collect()}
    assert got == {i: i for i in range(400)} | {400: 0}
    assert written["similar-posts"] == 0 and written["similar-met"] < 0.05 * 400 * 400
