"""Rewrites of captions, figures and headers, and small text functions."""

import logging

import pytest
from pyspark.sql import functions as F

from folioscope.functions import markup_rewrites as M
from folioscope.functions import text as T
from folioscope.operators import accounting, regions
from folioscope.operators import table_rewrites as R

TABLE = "| No | Name |\n|----|------|\n| 1 | oak |"
BLOCK = "::: {.tbl-caption}"


def once(spark, rewrite, text):
    """The text and count of a rewrite, and that a second time changes nothing."""
    (first,) = rewrite(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    (second,) = rewrite(spark.createDataFrame([(1, first["text"])], "doc_id int, text string")).collect()
    assert second["n"] == 0 and second["text"] == first["text"]
    return first["text"], first["n"]


def div(caption):
    return f'{BLOCK}\n```{{=typst}}\n#set text(size: 9pt, fill: rgb("#3E6893"))\n```\n{caption}\n:::'


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        (f"Table 1: trees\n\n{TABLE}\n", f"{div('Table 1: trees')}\n\n{TABLE}\n"),
        (f"{TABLE}\n\n*Table 2: trees again*\n", f"{div('Table 2: trees again')}\n\n{TABLE}\n"),
        (f"Table 3: one\nand more\n\n{TABLE}", f"{div('Table 3: one and more')}\n\n{TABLE}"),
        ("Table 4: drawn\n![](media/t4.png){width=3in}\n", f"{div('Table 4: drawn')}\n\n![](media/t4.png){{width=3in}}\n"),
        ("![](media/f.png){width=3in}\n\nFigure 5: a tree [old]\n", "![Figure 5: a tree \\[old\\]](media/f.png){width=3in}\n"),
        ("![](a.png)\n\nFigure 6: left\n\n![Figure 7: right](b.png)\n", "![Figure 6: left](a.png)\n\n![Figure 7: right](b.png)\n"),
        (f"{TABLE}\n\n{TABLE}\n\nTable 8: the lower\n\nProse.\n", f"{TABLE}\n\n{div('Table 8: the lower')}\n\n{TABLE}\n\nProse.\n"),
    ],
)
def test_promoted(spark, text, wanted):
    assert once(spark, R.promoted_captions, text) == (wanted, 1)


@pytest.mark.parametrize(
    "text",
    [
        "![](a.png)\n\n![](b.png)\n\n*Table 1: of which*\n\nProse.\n",
        f"Table 1: a\n\nTable 2: b\n\nTable 3: c\n\n{TABLE}\n",
        f"Table 5 shows it all.\n\n{TABLE}\n",
        f"{div('Table 1: done')}\n\n{TABLE}\n",
        "![Figure 1: named](a.png)\n\nFigure 2: stray\n",
        "Table 1: nothing near\n\nProse\n",
        "```\nTable 1: code\n```\n\n" + TABLE,
        "",
    ],
)
def test_not_promoted(spark, text):
    assert once(spark, R.promoted_captions, text) == (text, 0)


def test_migrated(spark):
    fence = "```{=html}\n<table><tr><td>x</td></tr></table>\n```"
    old = f"before\n::: {{#tbl-one}}\n\n{fence}\n\nTable 1: of\n the sea\n\n:::\nafter"
    assert once(spark, R.migrated_captions, old) == (f"before\n{div('Table 1: of the sea')}\n\n{fence}\nafter", 1)
    nested = f"::: {{#tbl-a}}\n{div('Inner')}\n\n{fence}\n\nOuter words\n:::\n::: {{#tbl-b}}\nno table here\n:::"
    assert once(spark, R.migrated_captions, nested) == (f"{div('Outer words')}\n\n{div('Inner')}\n\n{fence}\n::: {{#tbl-b}}\nno table here\n:::", 1)
    bare = f"::: {{#tbl-c}}\n{fence}\n:::"
    assert once(spark, R.migrated_captions, bare) == (fence, 1)
    unclosed = f"text\n::: {{#tbl-d}}\n{fence}\nlast words"
    assert once(spark, R.migrated_captions, unclosed) == (f"text\n{div('last words')}\n\n{fence}", 1)
    reset = "```{=typst}\n#set page(flipped: false)\n```"
    assert once(spark, R.migrated_captions, f"{TABLE}\n{reset}\n\n\n: Cut off\nrest") == (f"{TABLE}\n: Cut off\n\n{reset}\nrest", 1)
    for text in (f"{reset}\nwords\n: caption", "```{=typst}\n#other\n```\n: caption", "plain", ""):
        assert once(spark, R.migrated_captions, text) == (text, 0)


def test_passes_are_isolated(spark, caplog):
    docs = spark.createDataFrame([(1, f"Table 1: x\n\n{TABLE}\n"), (2, None)], "doc_id int, text string")

    def broken(df):
        return df.select("doc_id", "text", F.raise_error(F.lit("no such table")).cast("int").alias("n"))

    with caplog.at_level(logging.WARNING):
        got = R.fix_tables(docs, passes=[("bad", broken), ("captions_promoted", R.promoted_captions), ("worse", lambda df: 1 / 0)]).collect()
    assert {(r["doc_id"], r["bad"], r["captions_promoted"], r["worse"]) for r in got} == {(1, None, 1, None), (2, None, 0, None)}
    assert any("bad" in m for m in caplog.messages) and any("worse" in m for m in caplog.messages)
    whole = {r["doc_id"]: r for r in R.fix_tables(docs).collect()}
    assert whole[1]["captions_promoted"] == 1 and whole[1]["text"].startswith(BLOCK) and whole[2]["text"] == ""


def test_resolved_figures(spark):
    figures = [("FIG_1", "a.png", "A"), ("FIG_2", None, "B"), ("FIG_3", "c.png", None), (None, "n.png", "N"), ("FIG_4", "old.png", "D"), ("FIG_4", "d.png", "")]
    text = '![one](FIG_1) and ![two] (FIG_2 ) then <img class="x" src="FIG_1"> <img src=\'FIG_9\'> ![no](other.png)  \n'
    df = spark.createDataFrame([(1, text, figures), (2, "none", []), (3, None, None)], "i int, t string, f array<struct<fig_id:string,file:string,caption:string>>")
    got = {r["i"]: r["r"] for r in df.select("i", M.resolved_figures(F.col("t"), F.col("f"), "media").alias("r")).collect()}
    body = '![one](media/a.png) and *⚠ figure not found: two* then <img class="x" src="media/a.png"> <img src=\'FIG_9-NOT-FOUND\'> ![no](other.png)'
    notes = "<!-- figures detected in Phase 1 but not placed by the converter\n     (review and place manually if any is a real figure):\n       FIG_3: (no caption) -> media/c.png\n       FIG_4: (no caption) -> media/d.png\n-->"
    assert got[1]["text"] == f"{body}\n\n{notes}\n"
    assert (got[1]["resolved"], got[1]["hallucinated"], got[1]["unreferenced"]) == (["FIG_1", "FIG_1"], ["FIG_2", "FIG_9"], ["FIG_3", "FIG_4"])
    assert got[2]["text"] == "none" and got[3]["text"] == ""


def test_uncentred(spark):
    inner = '<table><tr><td style="text-align:center">in</td></tr></table>'
    text = f'a<table><tr><th style="text-align: center">h</th><th style="color:red;text-align:center;">i</th></tr><tr><td style="text-align:center">{inner}</td></tr></table>b<table>x</table></table><TABLE><TR><td style=\'text-align:center\'></TR></TABLE>'
    df = spark.createDataFrame([(text,), (None,), ("",), ("<table><tr",)], "t string")
    got = [r[0] for r in df.select(M.uncentred_headers(F.col("t"))).collect()]
    wanted = f'a<table><tr><th >h</th><th style="color:red;">i</th></tr><tr><td style="text-align:center">{inner}</td></tr></table>b<table>x</table></table><TABLE><TR><td ></TR></TABLE>'
    assert tuple(got[0]) == (wanted, 3) and [tuple(r) for r in got[1:]] == [(None, 0), ("", 0), ("<table><tr", 0)]


def test_small_functions(spark):
    texts = ["", "short", "x" * 48, "a name that is far too long for the column it has to go into, 2024", "é😀" * 40, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, clip, fit, seed, cut in df.select("t", T.clipped(F.col("t"), 10), T.fitted(F.col("t"), 48), T.stable_seed(F.col("t")), T.chunks(F.col("t"), 7)).collect():
        if t is None:
            assert clip is None and fit is None and seed is None
            continue
        assert clip == (t if len(t) <= 10 else t[:9] + "…") and seed == sum(map(ord, t)) and cut == [t[i : i + 7] for i in range(0, len(t), 7)]
        assert fit == (t.ljust(48) if len(t) <= 48 else t[:24] + "…" + t[-23:])
    messages = {"Retry after 2.5 please": 2.5, "retry_in: 7": 7.0, "wait 30s": 30.0, "in 12 seconds": 12.0, "no idea": 60.0, None: 60.0}
    got = spark.createDataFrame([(m,) for m in messages], "m string").select("m", accounting.retry_delay(F.col("m"))).collect()
    assert dict(map(tuple, got)) == messages
    row = spark.range(1).select(T.filled(F.lit("{{A}} and {{B}} {{C}}"), {"A": F.lit("x"), "B": F.lit(None).cast("string")}), accounting.usd(F.lit(0.92)), accounting.usd(F.lit(None).cast("double"))).first()
    assert tuple(row) == ("x and  {{C}}", 1.0, None)


def test_rates_are_one_row(spark):
    jobs = spark.createDataFrame([(1, 3, 1)], "doc_id int, pages int, candidate_pages int")
    rate = spark.createDataFrame([(0.005, 0.1, 0.2)], "cover_usd double, detect_usd_per_candidate double, convert_usd_per_page double")
    assert accounting.estimates(jobs, rate).count() == 1
    with pytest.raises(Exception, match="one row"):
        accounting.estimates(jobs, rate.unionAll(rate)).collect()


def test_figure_regions(spark):
    df = spark.createDataFrame([(1, "figure", "a.png"), (1, "table", "b.png"), (2, None, None)], "doc_id int, rtype string, file string")
    assert [tuple(r) for r in regions.figure_regions(df, "media").collect()] == [(1, "figure", "a.png", "media/a.png")]


def test_reply_json_parses_once(spark):
    """Each candidate of a reply is parsed as it stands and, where that fails, relaxed; all cores share a file of one row group."""
    from folioscope.functions import metadata
    from folioscope.plans import QUERIES

    replies = spark.createDataFrame([("so {a} then [1,] ```json\n{\"k\": 1,}\n```",), ("{\"bbox\": [1],}",), ("none {",), (None,)], "reply string")
    told = replies.select(metadata.reply_json(F.col("reply")).alias("json"))
    assert [r["json"] for r in told.collect()] == ['{"k": 1}', '{"bbox": [1]}', None, None]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 2
    assert QUERIES["props_replies"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
