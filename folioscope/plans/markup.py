"""Queries on converted markup and on the table ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup
from .registry import Inline, query, table
from .text import norm

PAGE_DOCS = ("page_id", "html")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


HREF = "regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1)"


@query(
    "links_extracted",
    f"""WITH r AS (SELECT page_id, replace(html, 'href="/', 'href="' || regexp_extract(coalesce(url, ''), '^(https?://[^/]+)', 1) || '/') AS html FROM pages), u AS (SELECT page_id, trim(unnest({HREF})) AS uri FROM r)
    SELECT DISTINCT page_id, uri FROM u WHERE regexp_matches(lower(uri), '^(http://|https://|ftp://|mailto:|www\\.)')""",
)
def links_extracted(spark, sf_dir):
    """The addresses of each page's anchors, relative ones made whole by the page's own."""
    origin = F.regexp_extract(F.coalesce("url", F.lit("")), "^(https?://[^/]+)", 1)
    whole = pages(spark, sf_dir).select("page_id", F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), origin, F.lit("/"))).alias("html"))
    return markup.links(whole, *PAGE_DOCS)


@query("html_tag_counts", "WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)\\b', 1))) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL")
def html_tag_counts(spark, sf_dir):
    return markup.tag_counts(pages(spark, sf_dir), *PAGE_DOCS)


DOCS = Inline("docs", "doc_id int, text string", [
    (1, "---\ntitle: a\n---\n# One  \n\ntext [^1] and [^2]\n\n## 2. Two words\n\n[^1]: first\n[^3]: third\n```python\n# comment\nx = 1\n```\n$$a+b$$ and $c$ and $5\n"),
    (2, "```{=html}\n<table><tr><td><table></table></td></tr></table>\n```\n\n![cap](media/img-1.png){width=50%} ![](img-2.png)\n</table><TABLE>\n</table >\n| a | b |\n|---|:-:|\n| 1 | 2 |\n"),
    (3, "no markup here\n```\nopen fence\n# inside"),
    (4, ""),
])
MD_LINES = f"""WITH {DOCS.cte}, s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs), l AS (SELECT doc_id, (i - 1)::INTEGER AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
    f AS (SELECT *, starts_with(ltrim(line), '```') AS is_fence FROM l), md AS (SELECT *, is_fence OR sum(is_fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS inside FROM f)"""


@query("fence_state", f"{MD_LINES} SELECT * FROM md")
def fence_state(spark, sf_dir):
    return markup.md_lines(DOCS.df(spark))


@query("code_blocks", f"{MD_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS nth FROM md WHERE is_fence) SELECT doc_id, count(*) FILTER (nth % 2 = 1 AND NOT starts_with(trim(substr(ltrim(line), 4)), '{{=')) AS n_blocks FROM n GROUP BY doc_id")
def code_blocks(spark, sf_dir):
    return markup.code_blocks(markup.md_lines(DOCS.df(spark)))


@query(
    "headings",
    rf"""WITH {DOCS.cte}, b AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?s)\A---\s*\n.*?\n---\s*\n', ''), '(?m)^(#{{1,6}})\s+(.+?)\s*$', 0) AS h FROM docs),
    e AS (SELECT doc_id, (i - 1)::INTEGER AS position, h[i] AS raw FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM b)),
    t AS (SELECT doc_id, position, length(regexp_extract(raw, '^(#{{1,6}})', 1))::INTEGER AS level, regexp_extract(raw, '(?s)^#{{1,6}}\s+(.+?)\s*\z', 1) AS title FROM e)
    SELECT *, {norm('title')} AS normal FROM t WHERE {norm('title')} <> ''""",
)
def headings(spark, sf_dir):
    return markup.headings(DOCS.df(spark))


@query("image_refs", rf"""WITH {DOCS.cte}, b AS (SELECT doc_id, regexp_extract_all(text, '!\[([^\]]*)\]\(([^)\s]*)[^)]*\)', 1) AS c, regexp_extract_all(text, '!\[([^\]]*)\]\(([^)\s]*)[^)]*\)', 2) AS t FROM docs)
    SELECT doc_id, (i - 1)::INTEGER AS position, c[i] AS caption, t[i] AS target FROM (SELECT doc_id, c, t, unnest(range(1, len(c) + 1)) AS i FROM b)""")
def image_refs(spark, sf_dir):
    return markup.image_refs(DOCS.df(spark))


@query("footnote_match", rf"""WITH {DOCS.cte}, a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[\^([^\]\s]+)\](:?)', 1)) AS note, unnest(regexp_extract_all(text, '\[\^([^\]\s]+)\](:?)', 2)) AS c FROM docs),
    r AS (SELECT DISTINCT doc_id, note FROM a WHERE c = ''), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?m)^\[\^([^\]\s]+)\]:', 1)) AS note FROM docs)
    SELECT coalesce(r.doc_id, d.doc_id) AS doc_id, coalesce(r.note, d.note) AS note, CASE WHEN d.note IS NULL THEN 'dangling' WHEN r.note IS NULL THEN 'orphaned' ELSE 'resolved' END AS state FROM r FULL JOIN d ON r.doc_id = d.doc_id AND r.note = d.note""")
def footnote_match(spark, sf_dir):
    return markup.footnotes(DOCS.df(spark))


@query("top_level_tables", f"""WITH RECURSIVE {DOCS.cte}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '<table\\b|</table\\s*>', 0) AS tags FROM docs),
    w AS (SELECT doc_id, tags, 0 AS i, 0 AS depth, 0 AS closed FROM t UNION ALL SELECT doc_id, tags, i + 1, greatest(0, depth + CASE WHEN starts_with(tags[i + 1], '</') THEN -1 ELSE 1 END), closed + (starts_with(tags[i + 1], '</') AND depth = 1)::INT FROM w WHERE i < len(tags))
    SELECT doc_id, closed::INTEGER AS n_tables FROM w WHERE i = len(tags)""")
def top_level_tables(spark, sf_dir):
    return DOCS.df(spark).select("doc_id", markup.top_level_tables(F.col("text")).alias("n_tables"))


@query("table_constructs", rf"WITH {DOCS.cte} SELECT doc_id, (len(regexp_extract_all(text, '(?i)<table\b')) + len(regexp_extract_all(text, '(?m)^\s*\|?[ \t]*:?-{{3,}}:?[ \t]*(\|[ \t]*:?-{{3,}}:?[ \t]*)+\|?[ \t]*$')))::INTEGER AS n FROM docs")
def table_constructs(spark, sf_dir):
    return DOCS.df(spark).select("doc_id", markup.table_constructs(F.col("text")).alias("n"))


@query("math_blocks", "SELECT * FROM (VALUES (1, 2), (2, 0), (3, 0), (4, 0)) t(doc_id, n)")
def math_blocks(spark, sf_dir):
    return DOCS.df(spark).select("doc_id", markup.math_blocks(F.col("text")).alias("n"))


@query("math_regions", rf"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), l AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
    m AS (SELECT doc_id, i, contains(line, '$') OR length(regexp_replace(line, '[^{markup.T.MATH_SYMBOLS}]', '', 'g')) >= 2 AS m FROM l), w AS (SELECT doc_id, m, lag(m, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM m)
    SELECT doc_id, count(*) FILTER (m AND NOT was) AS n_regions FROM w GROUP BY doc_id""")
def math_regions(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return markup.math_regions(lines)


NOTES = Inline("notes", "doc_id int, line_no int, text string", [(1, 0, "title¹"), (1, 15, "a note¹ and ²³ and x^2"), (1, 16, "²²⁷₉₀Th⁺ ∑∑∑"), (1, 17, "plain³."), (2, 20, "none")])


@query("source_footnotes", "SELECT * FROM (VALUES (1, 3::BIGINT), (2, 0)) t(doc_id, n_marks)")
def source_footnotes(spark, sf_dir):
    return markup.source_footnotes(NOTES.df(spark))


SPANS = Inline("spans", "doc_id int, page_no int, text string, flags int, font string", [(1, 0, "x", 8, "A")] * 3 + [(1, 0, "y", 0, "Courier New"), (1, 0, " ", 8, "A"), (1, 1, "z", 8, "B"), (2, 0, "q", 0, "Times")])


@query("code_pages", f"WITH {SPANS.cte} SELECT doc_id, page_no, count(*) AS n_mono FROM spans WHERE trim(text) <> '' AND ((flags & 8) <> 0 OR regexp_matches(font, '(?i)mono|courier|consol|code')) GROUP BY ALL HAVING count(*) >= 4")
def code_pages(spark, sf_dir):
    return markup.code_pages(SPANS.df(spark))


URIS = Inline("uris", "doc_id int, uri string", [(1, "https://a.example/x/"), (1, "http://b.example"), (2, "www.c.example"), (3, "https://d.example")])
TEXTS = Inline("texts", "doc_id int, text string", [(1, "see HTTPS://A.example/x and more"), (2, "C.example is WWW.C.EXAMPLE"), (1 + 3, "none")])


@query("link_preservation", f"""WITH {URIS.cte}, {TEXTS.cte} SELECT doc_id, uri, coalesce(contains(lower(text), rtrim(lower(uri), '/')) OR contains(lower(text), regexp_replace(rtrim(lower(uri), '/'), '^\\w+://', '')), false) AS preserved FROM uris LEFT JOIN texts USING (doc_id)""")
def link_preservation(spark, sf_dir):
    return markup.link_preserved(URIS.df(spark), TEXTS.df(spark))
