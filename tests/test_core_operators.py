"""Operators of the core against brute force, and in odd cases."""

import difflib
import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import metadata, rewrites
from folioscope.functions import text as T
from folioscope.operators import blocks, coverage, figures, regions, sequences, similar, spatial, verify

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# strings of a high ratio


def brute_pairs(left, right, least):
    return {(a, b) for a in left for b in right if a and b and difflib.SequenceMatcher(None, a, b).ratio() >= least}


def variants(rng, words, n):
    out = []
    for _ in range(n):
        s = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randrange(2)] = rng.choice(["", "a", "bb", " "])
        if rng.random() < 0.2:
            k = rng.randrange(len(s) + 1)
            s = s[k:] + s[:k]
        out.append("".join(s))
    return out


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95, 1.0])
def test_similar_pairs(spark, least):
    rng = random.Random(int(least * 100))
    words = ["".join(rng.choice("abcd e") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 30, 60)] + ["aaaaaaaaaa", "abababababab", "é😀ü", "a"]
    left, right = variants(rng, words, 150), variants(rng, words, 150)
    df = lambda texts: spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], "text string")
    got = similar.similar_pairs(df(left), df(right), least).collect()
    assert {(r["left"], r["right"]) for r in got} == brute_pairs(set(left), set(right), least) and len(got) == len({(r["left"], r["right"]) for r in got})
    assert all(abs(r["ratio"] - difflib.SequenceMatcher(None, r["left"], r["right"]).ratio()) < 1e-12 for r in got)
    assert similar.similar_pairs(df(left).limit(0), df(right), least).collect() == []


def test_similar_pairs_of_pages(spark):
    """Titles, headings and links of the pages: every pair of the ratio, none other."""
    found = blocks.page_elements(spark.read.parquet(f"{SF}/pages.parquet"), tags=("title", "h1", "a")).select("tag", T.normalize(F.col("text")).alias("text")).collect()
    left, right = {r["text"] for r in found if r["tag"] != "a"}, {r["text"] for r in found if r["tag"] != "title"}
    df = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    got = similar.similar_pairs(df(left), df(right)).collect()
    assert {(r["left"], r["right"]) for r in got} == brute_pairs(left, right, 0.85)


def test_few_pairs_are_measured(spark):
    """Of strings over the same letters hardly any pair is measured, though most share rare bigrams; repeats and characters of any plane count."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("etaoinshrdlu ", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 18], k=60)) for _ in range(300)] + ["😀😀😀😀😀é", "😀😀😀😀é", "x" * 90, "x" * 80]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    met = {(r["left"], r["right"]) for r in similar.candidates(df, df, 0.85, []).collect()}
    assert len(met) < 0.05 * len(texts) ** 2
    assert {(r["left"], r["right"]) for r in similar.similar_pairs(df, df).collect()} == brute_pairs(set(texts), set(texts), 0.85) <= met
    assert similar.common("abcde", "xbxde") == 3


def test_similar_within_keys(spark):
    left = spark.createDataFrame([(1, "one title"), (2, "one title"), (None, "one title")], "doc_id long, text string")
    right = spark.createDataFrame([(1, "one titles"), (2, "another"), (None, "one title")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in similar.similar_pairs(left, right, keys=["doc_id"]).collect()] == [(1, "one title", "one titles")]
    with pytest.raises(ValueError):
        similar.similar_pairs(left, right, 0.5)


def test_heading_matches(spark):
    titles = spark.createDataFrame([(1, 0, "general remarks"), (1, 1, "mapping rules of class"), (1, 2, "nothing like it"), (1, 3, ""), (2, 0, "general remarks")], "doc_id long, title_no int, title_key string")
    headings = spark.createDataFrame([(1, 0, "mapping rule of clas"), (1, 1, "the general remarks here"), (1, 2, "mapping rules of class"), (2, 0, "other")], "doc_id long, heading_no int, heading_key string")
    assert rows(figures.heading_matches(titles, headings)) == rows(spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, None), (1, 3, None), (2, 0, None)], "a long, b int, c int"))
    assert rows(figures.heading_matches(titles, headings, by_ratio=False).where("title_no = 1")) == [(1, 1, 2)]


# sequences


def brute_longest(values):
    best = [0] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
    return max(best, default=0)


def test_longest_runs(spark):
    rng = random.Random(4)
    data = [(rng.choice([1, 2, 3, None]), rng.randrange(50), rng.choice([None, *map(float, range(40))]), "x") for _ in range(600)] + [(9, 1, None, "x"), (10, 1, 5.0, "x"), (10, 1, 5.0, "x")]
    df = spark.createDataFrame(data, "k long, ts long, v double, __value string")
    wanted = set()
    for k in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2] is not None, d[2] or 0))
        wanted.add((k, len(own), brute_longest([d[2] for d in own if d[2] is not None])))
    assert set(map(tuple, sequences.longest_runs(df.drop("__value"), "k", ["ts"], "v").collect())) == wanted
    assert sequences.longest_runs(df.limit(0), "k", ["ts"], "v").collect() == []
    arrays = [[rng.randrange(20) for _ in range(rng.randrange(30))] for _ in range(50)] + [[], [1, None, 2]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)] + [(99, None)], "i int, a array<int>")
    got = {r[0]: r[1] for r in df.select("i", sequences.longest_increasing(F.col("a"))).collect()}
    assert got == {i: brute_longest([x for x in a if x is not None]) for i, a in enumerate(arrays)} | {99: None}


# coverage


def test_short_lines_anywhere(spark):
    """Every needle in every output, against the rule written out for one pair."""
    rng = random.Random(8)
    outputs = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(120))]) for i in range(60)] + [(100, []), (101, list("abcde") * 3)]
    needles = [(i, [rng.choice("abcdefghz") for _ in range(rng.randint(5, 7))]) for i in range(40)] + [(70, list("abcde"))]
    n, o = spark.createDataFrame(needles, "needle_id long, tokens array<string>"), spark.createDataFrame(outputs, "doc_id long, output array<string>")
    wanted = n.crossJoin(o).where(coverage.short_covered(F.col("tokens"), F.col("output"))).select("needle_id", "doc_id")
    got = coverage.short_lines_anywhere(n, o)
    assert rows(got) == rows(wanted) and got.count() > 20
    assert coverage.short_lines_anywhere(n, o.limit(0)).collect() == [] and coverage.short_lines_anywhere(n.limit(0), o).collect() == []


def test_covered_fraction(spark):
    """A box without a cover on its page, one beside its cover, one half covered, one wholly; an empty box counts as covered."""
    boxes = [(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 50.0, 50.0, 60.0, 60.0), (1, 1, 3, 0.0, 0.0, 10.0, 10.0), (1, 0, 4, 2.0, 2.0, 4.0, 4.0), (1, 0, 5, 3.0, 3.0, 3.0, 9.0)]
    box = "x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame(boxes, f"doc_id int, page_no int, box_id int, {box}")
    covers = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 10.0)], f"doc_id int, page_no int, {box}")
    got = {r["box_id"]: r["fraction"] for r in spatial.covered_fraction(df, covers).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0}
    assert {r["box_id"] for r in spatial.covered_fraction(df, covers.limit(0)).where("fraction > 0").collect()} == {5}


# text


def test_fold(spark):
    texts = ["plain", "Café RÉSUMÉ", "ﬁne ﬃ ½ ㎏ ﷺ", "漢字", "", None, "é" * 1000, "ﬁ" * 500 + "x", "😀 ① ⅷ ⒜"] + ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0x80, 0x3400, 64)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold_ascii(F.col("t")).alias("f"))
    for t, f in df.collect():
        assert f == (None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()), t
    plan = spark.range(1).select(T.fold_ascii(F.col("id").cast("string")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 60_000


def brute_breaks(text):
    lines, out, inside, n = text.split("\n"), [], False, 0
    front = 0
    if lines[0].strip() == "---":
        front = next((i + 1 for i in range(1, len(lines)) if lines[i].strip() in ("---", "...")), 0)
    for i, line in enumerate(lines):
        if i >= front:
            if line.lstrip(" \t").startswith("```"):
                inside = not inside
            elif not inside and re.fullmatch(r"\s*-{3,}\s*", line):
                line, n = "***", n + 1
        out.append(line)
    return "\n".join(out), n


def test_thematic_breaks(spark):
    rng = random.Random(2)
    bits = ["---", " ---- ", "```", "  ```py", "text", "", "...", "--", "--- x", "***", "a ```"]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)] + ["---\n" + "x: y\n" * 5000, "---", "---\n---", "---\n---\n---"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rewrites.thematic_breaks(F.col("t")).alias("r"))
    for t, r in df.collect():
        assert tuple(r) == brute_breaks(t), t


def test_balanced_and_replies(spark):
    texts = ["[1] {a} [[2] {b}]", "}{ ] [", "[", "", None, "{ {} } {[}]", "x" * 50000 + "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(metadata.balanced(F.col("t"))).collect()]
    assert got == [["[1]", "[[2] {b}]", "{a}", "{b}"], ["{ ] ["][:0], [], [], None, ["[}]", "{ {} }", "{[}"], ["[1]"]]
    replies = ['see [1] and {"bbox": [1, 2, 3, 4], "type": "chart",} now', '[{"bbox": [1,2,3,4]}]', "none", None, '{"tables": [{"bbox": [1]}], "more": [{"bbox": "x", "caption": 5}]}']
    df = spark.createDataFrame([(t,) for t in replies], "t string")
    boxes = [r[0] for r in df.select(metadata.reply_boxes(metadata.reply_json(F.col("t")))).collect()]
    assert [[(b["bbox"], b["type"], b["caption"]) for b in x or []] for x in boxes] == [[([1.0, 2.0, 3.0, 4.0], "chart", None)], [([1.0, 2.0, 3.0, 4.0], None, None)], [], [], [(None, None, "5")]]


def test_divs_and_tables(spark):
    rng = random.Random(6)
    bits = ["::: {.a}", ":::: b", ":::", "::::", "text", ":::c", ""]
    texts = [(i, "\n".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(60)] + [(98, ""), (99, None)]
    wanted = []
    for i, t in texts:
        depth = 0
        for n, line in enumerate((t or "").split("\n")):
            change = 1 if re.match(r":::+ +\S", line.strip()) else -1 if re.fullmatch(":::+", line.strip()) else 0
            depth = max(0, depth + change)
            wanted.append((i, n, depth))
    assert rows(regions.div_depths(spark.createDataFrame(texts, "doc_id long, text string"))) == sorted(wanted, key=repr)
    html = "a</table><table x><TABLE>1</TABLE></table>b<table>2</table><table><table></table>"
    (got,) = spark.createDataFrame([(html,)], "t string").select(regions.outermost_tables(F.col("t"))).first()
    assert got == ["<table x><TABLE>1</TABLE></table>", "<table>2</table>"]


# elements


def told(page, *with_text):
    return [(e.tag, e.depth, e.nth, e.closed, None if e.words is None else "".join(e.words)) for e in blocks.elements(page, frozenset(with_text))]


def test_elements():
    assert told("<ul><li>a<li>b<ul><li>c</ul></ul><li>d", "li") == [("ul", 0, 0, True, None), ("li", 1, 0, False, "a"), ("li", 1, 1, False, "bc"), ("ul", 2, 0, True, None), ("li", 3, 0, False, "c"), ("li", 0, 0, False, "d")]
    assert told("<p>a<b>c<p>d</b></p>", "p") == [("p", 0, 0, False, "ac"), ("b", 1, 0, False, None), ("p", 0, 1, True, "d")]
    table = "<table><tr><td>1<td>2<table><tr><td>3</table><tr><th>4</table>"
    assert [(t, d, n) for t, d, n, *_ in told(table)] == [("table", 0, 0), ("tr", 1, 0), ("td", 2, 0), ("td", 2, 1), ("table", 3, 0), ("tr", 4, 0), ("td", 5, 0), ("tr", 1, 1), ("th", 2, 0)]
    assert told("<script>if (a<b) '<p>x</p>'</script><p>y", "p") == [("script", 0, 0, True, None), ("p", 0, 0, False, "y")]
    assert told("<!-- <p> --><!DOCTYPE html><br/><img src='a>b'>t</x></p>", "br") == [("br", 0, 0, True, ""), ("img", 0, 0, True, None)]
    assert told("") == [] and told("< p>no <1>") == [] and told("<p <b>") == [("p", 0, 0, False, None)]
    (a,) = blocks.elements('<A HREF="x&amp;y" href=z disabled data-q=\'1"\'>', frozenset())
    assert a.tag == "a" and a.attributes == {"href": "x&y", "disabled": "", "data-q": '1"'}


def test_offsets(spark):
    pages = spark.createDataFrame([(1, "é<p>x&lt;y <b>z</b></p>t"), (2, None), (2, ""), (None, "<li>\n a  b\n"), (3, "<a>" * 20000)], "page_id long, html string")
    got = rows(blocks.page_elements(pages, texts=("p", "li")).where("page_id is null or page_id < 3").select("page_id", "tag", "begin", "end", "text"))
    assert got == sorted([(1, "p", 1, 23, "x<y z"), (1, "b", 11, 19, None), (None, "li", 0, 11, "a b")], key=repr)
    assert blocks.page_elements(pages).where("page_id = 3").agg(F.max("depth")).first()[0] == 19999


def test_list_order(spark):
    found = blocks.page_elements(spark.createDataFrame([(1, "<ol><li>a</li><li>b</li></ol><ul><li>c</li></ul>")], "page_id long, html string"))
    assert rows(blocks.list_items(found)) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 3, 0, "c")]


# sources of the coverage checks


def test_source_text(spark):
    schema = "doc_id int, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"
    line = lambda d, p, n, t, y: (d, p, n, t, 50.0, y, 300.0, y + 10)
    rows_ = [line(1, p, 0, "Annual Report", 10.0) for p in range(3)] + [line(1, p, 9, f"Page {p + 1}", 800.0) for p in range(3)]
    rows_ += [line(1, 0, 1, "The cover's title", 100.0), line(1, 1, 1, "A sentence that has to be there.", 100.0), line(1, 1, 2, "inside the figure", 300.0), line(1, 2, 1, "42", 100.0), line(1, 2, 2, None, 120.0), line(2, 0, 1, "No cover here.", 100.0), line(3, 0, 1, "7", 100.0)]
    lines = spark.createDataFrame(rows_, schema)
    boxes = spark.createDataFrame([(1, 1, 0.0, 290.0, 400.0, 320.0)], "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double")
    covers = spark.createDataFrame([(1,), (1,)], "doc_id int")
    got = {r["doc_id"]: r["text"] for r in verify.source_text(lines, boxes, covers).collect()}
    assert got == {1: "A sentence that has to be there.\n", 2: "No cover here."}
    # a source whose running lines the output rightly lacks is covered
    outputs = spark.createDataFrame([(1, "A sentence that has to be there."), (2, "other words"), (3, "x")], "doc_id int, text string")
    checks = {(r["doc_id"], r["status"], r["metric"]) for r in verify.run(verify.DocSet(outputs, source_lines=lines, exclusions=boxes, covers=covers), ["text_coverage"]).collect()}
    assert (1, "ok", "100.0") in checks
    plain = {r["doc_id"]: r["text"] for r in verify.source_text(lines).collect()}
    assert plain[1].startswith("The cover's title\nA sentence") and "inside the figure" in plain[1]
    assert verify.source_text(lines.limit(0)).collect() == []


def test_source_tables(spark):
    header = [["Head", "Page"], [None, "1"]]
    grids = [(1, i, header) for i in range(4)] + [(1, 8, [["a", ""], ["b", "ç"]]), (1, 9, [["x"] * 50]), (1, 10, [["", None]]), (2, 1, [["a", "b"]]), (2, 2, [])]
    df = spark.createDataFrame(grids, "doc_id int, table_no int, grid array<array<string>>")
    pages = spark.createDataFrame([(1, 6), (2, 1)], "doc_id int, total_pages int")
    assert rows(verify.source_tables(df, pages)) == [(1, 8, "a b c"), (2, 1, "a b")]


# figures of larger tables


def test_sentence_coverage_moves_texts_alone(spark):
    """The two texts of a document are shuffled, no row for each shingle or token."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = coverage.coverage_summary(coverage.sentence_coverage(docs, docs))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("SortMergeJoin") and "Window" not in plan


def test_short_covered_without_output(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], []), (["a", "b", "c", "d", "e"], ["e", "d", "x", "b", "a", "c"]), ([], ["a"])], "n array<string>, o array<string>")
    assert [r[0] for r in df.select(coverage.short_covered(F.col("n"), F.col("o"))).collect()] == [False, True, True]


def test_normalize(spark):
    """As the single steps say, with every ASCII character beside others; no pattern tries what is not in a class."""
    texts = [None, "", " ", "a-\n b", "a - \n\n b-c", "x  ,y", ", ,", "É-\nß ﬁ9", *["A" + chr(c) + " b" + chr(c) * 2 + "c" for c in range(128)]]

    def plain(t):
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub(r"[ \t\n\v\f\r]+", " ", re.sub("[^a-z0-9 ]+", " ", re.sub(r"-[ \t\n\v\f\r]*\n[ \t\n\v\f\r]*", "", t).lower())).strip(" ")

    normal = T.normalize(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normal.alias("n"))
    assert all(n == (None if t is None else plain(t)) for t, n in df.collect())
    assert "[^" not in df._jdf.queryExecution().analyzed().toString()


def test_heading_matches_of_copies(spark):
    """Copies of a text don't meet one by one: candidates are pairs of different texts."""
    titles = spark.range(300).selectExpr("1L as doc_id", "int(id) as title_no", "concat('title of ', id % 3) as title_key")
    headings = spark.range(300).selectExpr("1L as doc_id", "int(id) as heading_no", "concat('the title of ', id % 5) as heading_key")
    got = figures.heading_matches(titles, headings, by_ratio=False)
    assert rows(got) == rows(spark.createDataFrame([(1, i, i % 3) for i in range(300)], "a long, b int, c int"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(heading_key" not in plan and "Contains(title_key" not in plan


def test_quota_code(spark):
    from folioscope.operators import accounting

    told = {"Error 429": "quota", "429 Too many": "quota", "http 429 sent": "quota", "no answer in 429 s": "other", "no answer in 1429 s": "other", "wait 429.5 seconds": "other", "user 14290": "other", "(429)": "quota", "429.": "quota"}
    df = spark.createDataFrame(list(told.items()), "m string, c string")
    assert [r["m"] for r in df.where(accounting.error_class(F.lit(500), F.col("m")) != F.col("c")).collect()] == []


def test_chrome_is_dealt_by_document_once(spark):
    """The chrome steps over tables shuffle only where line items are dealt; pages without elements, null keys and repeated pages stand as joins would have them."""
    from folioscope.operators import chrome
    from folioscope.plans import QUERIES

    for name in ("chrome_keys_fixture", "chrome_regions_fixture", "content_extent_median"):
        plan = QUERIES[f"{name}_on_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffles and all("hashpartitioning(l_orderkey" in s and "l_linenumber" not in s.split("REPARTITION")[0] and "REPARTITION_BY_NUM" in s for s in shuffles), plan
    box = lambda page, sig, band, y0, y1, doc=1: (doc, page, sig, band, 0.0, y0, 9.0, y1)
    elements = [box(p, "run", "top", 5.0 + p, 9.0) for p in (0, 1, 2, 3)] + [box(p, None, None, 20.0 + p, 80.0 + p) for p in (0, 1, 2)]
    elements += [box(None, "run", "top", 0.0, 1.0), box(1, "run", "top", 0.0, 1.0, None), box(9, "run", "top", 0.0, 1.0), box(1, "run", None, 30.0, 40.0)]
    elements = spark.createDataFrame(elements, "doc_id int, page_no int, sig string, band string, x0 double, y0 double, x1 double, y1 double")
    # page 0 has no vote, page 3 no element but chrome and two rows, page 9 no row, page 5 no element
    pages = [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, False), (1, 3, False), (1, 5, False), (1, None, None), (None, 1, False)]
    pages = spark.createDataFrame([(d, p, 50.0, 100.0, skip) for d, p, skip in pages], "doc_id int, page_no int, width double, height double, skip boolean")
    assert [tuple(r) for r in chrome.running_keys(elements, pages).collect()] == [(1, "run", "top", 3, 5)]
    assert [tuple(r) for r in chrome.content_extent(elements, pages).collect()] == [(1, 21.5, 81.5)]
    found = sorted(tuple(r) for r in chrome.regions(elements, pages).collect())
    assert found == [(1, p, "top", 0.0, 5.0 + p, 50.0, 9.0) for p in (0, 1, 2, 3, 3)]
