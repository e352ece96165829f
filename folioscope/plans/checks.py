"""Queries on the single checks of the registry, over inline documents, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verify
from ..operators.markup import T
from .markup import norm
from .registry import Inline, query

OUT = Inline("out_", "doc_id int, text string", [
    (1, "---\ntitle: a\n---\n# 1. Scope of work\n\ntext[^1] and $x$ with $$\na\n$$\n\n![one](media/img-1.png)\n\n## 2 Methods\n\n```python\nx\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n[^1]: note"),
    (2, "# Methods\n\n# Scope of work\n\n<img src=\"media/img-9.png\"> (FIG_3)\n\n#set text(size: 6pt)\n#set text(size: 5pt)\n#set text(size: 6pt)\n```\na\n```\n```{=html}\n<table><tr>" + "<td>x</td>" * 45 + "</tr></table>\n```\n```\nb\n```\n```\nc\n```"),
    (3, "nothing here[^7][^7]\n\n[^8]: never used\n$a$ $b$ $c$\n#### Scope of works"),
    (4, None),
])
SPANS = Inline("spans", "doc_id int, page_no int, text string, flags int, font string", [(1, 0, "x", 8, "A")] * 4 + [(2, 3, "y", 0, "Courier")] * 5 + [(3, p, "z", 8, "A") for p in (0, 1, 2) for _ in range(4)] + [(4, 0, "z", 8, "A"), (4, 0, " ", 8, "A")])
LINES = Inline("lines_", "doc_id int, line_no int, text string", [
    (1, 20, "E = m ∑ ∏ c"), (1, 21, "∫∂ more"), (1, 22, "plain² text"), (1, 23, "α β"), (2, 0, "no formula¹"), (2, 16, "one¹ two² three³ four⁴"), (3, 16, "$"), (3, 17, None), (4, 30, "a ∞∞ b"), (4, 31, "x"), (4, 32, "≤≥"), (4, 33, "y"), (4, 34, "$$"),
])
TITLES = Inline("titles", "doc_id int, title_no int, title string", [(1, 0, "Scope of work"), (1, 1, "Methods"), (2, 0, "1 Scope of work"), (2, 1, "2 Methods"), (2, 2, "Results"), (2, 3, "Annex A"), (3, 0, "!!"), (3, 1, "Scope of work"), (4, 0, None), (4, 1, "Lost"), (4, 2, "Lost too"), (4, 3, "And gone")])
FIGS = Inline("figs", "doc_id int, fig_id string, file string, origin string", [(1, "FIG_1", "img-1.png", "model"), (1, "FIG_2", "img-2.png", "oversized-table"), (2, "FIG_3", None, "model"), (4, "FIG_1", "img-1.png", None)])
GRIDS = Inline("grids", "doc_id int, table_no int, n_rows int, n_columns int", [(1, 0, 2, 46), (1, 1, 2, 2), (2, 0, 60, 44), (3, 0, 50, 50), (3, 1, 1, 1), (4, 0, 3, 3)])


def grids(spark):
    grid = F.array_repeat(F.array_repeat(F.lit("x"), F.col("n_columns")), F.col("n_rows"))
    return GRIDS.df(spark).select("doc_id", "table_no", grid.alias("grid"))


def docs(spark) -> verify.DocSet:
    return verify.DocSet(OUT.df(spark), figures=FIGS.df(spark), spans=SPANS.df(spark), lines=LINES.df(spark), titles=TITLES.df(spark), grids=grids(spark))


def one(name: str, sql: str) -> None:
    """A query ``check_<name>``: doc_id, status, metric, n_findings of one check; ``sql`` gives doc_id, status, metric, n_findings where it applies."""

    @query(
        f"check_{name}",
        f"WITH {OUT.cte}, {SPANS.cte}, {LINES.cte}, {TITLES.cte}, {FIGS.cte}, {GRIDS.cte}, {sql} "
        "SELECT o.doc_id, coalesce(r.status, 'skipped') AS status, r.metric, coalesce(r.n_findings, 0)::INTEGER AS n_findings FROM out_ o LEFT JOIN r ON o.doc_id = r.doc_id",
    )
    def run(spark, sf_dir):
        return verify.run(docs(spark), [name]).select("doc_id", "status", "metric", F.size("findings").alias("n_findings"))


ASYMMETRY = "CASE WHEN o * 2 < s THEN 'warn' ELSE 'ok' END AS status, least(s, o)::VARCHAR || '/' || s::VARCHAR || ' {} preserved' AS metric, (o * 2 < s OR o > 2 * s)::INT AS n_findings"
one(
    "code_block_presence",
    r"""p AS (SELECT doc_id, page_no FROM spans WHERE trim(text) <> '' AND ((flags & 8) <> 0 OR regexp_matches(font, '(?i)mono|courier|consol|code')) GROUP BY ALL HAVING count(*) >= 4),
    s AS (SELECT doc_id, count(*) AS s FROM p GROUP BY doc_id), f AS (SELECT doc_id, list_filter([ltrim(x) FOR x IN string_split(text, chr(10))], lambda x: starts_with(x, '```')) AS f FROM out_),
    b AS (SELECT doc_id, len(list_filter(f, lambda x, i: i % 2 = 1 AND NOT starts_with(trim(substr(x, 4)), '{='))) AS n FROM f),
    r AS (SELECT doc_id, """ + ASYMMETRY.format("code blocks") + " FROM (SELECT doc_id, s, coalesce(n, 0) AS o FROM s LEFT JOIN b USING (doc_id)) WHERE doc_id <> 4)",
)
one(
    "math_presence",
    rf"""l AS (SELECT doc_id, line_no, coalesce(contains(text, '$') OR length(regexp_replace(text, '[^{T.MATH_SYMBOLS}]', '', 'g')) >= 2, false) AS m FROM lines_),
    w AS (SELECT doc_id, m, lag(m, 1, false) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM l), s AS (SELECT doc_id, count(*) AS s FROM w WHERE m AND NOT was GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(text, '') AS t, '(?s)\$\$.+?\$\$' AS p FROM out_), n AS (SELECT doc_id, len(regexp_extract_all(t, p)) + len(regexp_extract_all(regexp_replace(t, p, ' ', 'g'), '\$[^\n$]+\$')) AS o, t FROM d),
    r AS (SELECT doc_id, """ + ASYMMETRY.format("equations") + " FROM s JOIN n USING (doc_id) WHERE t <> '')",
)
KEY = r"trim(regexp_replace(regexp_replace({x}, '\d+', ' ', 'g'), '\s+', ' ', 'g'))"
one(
    "heading_hierarchy",
    rf"""t AS (SELECT doc_id, title_no, {norm('title')} AS n FROM titles WHERE title IS NOT NULL), k AS (SELECT doc_id, title_no, {KEY.format(x='n')} AS k FROM t WHERE n <> ''),
    h0 AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?s)\A---\s*\n.*?\n---\s*\n', ''), '(?m)^#{{1,6}}\s+(.+?)\s*$', 1) AS h FROM out_),
    h1 AS (SELECT doc_id, h[i] AS title, i FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM h0)), h2 AS (SELECT doc_id, i, {norm('title')} AS n FROM h1), h AS (SELECT doc_id, i, {KEY.format(x='n')} AS k FROM h2 WHERE n <> ''),
    m AS (SELECT k.doc_id, k.title_no, min(h.i) AS i FROM k LEFT JOIN h ON k.doc_id = h.doc_id AND k.k <> '' AND h.k <> '' AND (k.k = h.k OR (least(length(k.k), length(h.k)) >= 6 AND (contains(k.k, h.k) OR contains(h.k, k.k)))) GROUP BY ALL),
    u AS (SELECT doc_id, count(*) AS n_titles, count(*) FILTER (i IS NULL) AS missing, list(i ORDER BY title_no) FILTER (i IS NOT NULL) AS seq FROM m GROUP BY doc_id),
    -- the longest increasing run of at most two matches, all that these documents have
    v AS (SELECT u.doc_id, n_titles, missing, coalesce(len(seq) = 2 AND seq[1] >= seq[2], false)::INT AS moved, (SELECT count(*) FROM h WHERE h.doc_id = u.doc_id) AS n_heads FROM u WHERE doc_id IN (SELECT doc_id FROM out_ WHERE text <> '')),
    w AS (SELECT *, missing + moved + (abs(n_heads - n_titles) > greatest(1, floor(n_titles * 0.25)))::INT AS n_findings FROM v),
    r AS (SELECT doc_id, CASE WHEN n_findings > 0 THEN 'warn' ELSE 'ok' END AS status, n_heads::VARCHAR || ' headings, ' || moved::VARCHAR || ' reordered' AS metric, n_findings FROM w)""",
)
one(
    "figure_placement",
    r"""i AS (SELECT DISTINCT doc_id, regexp_replace(unnest(list_concat(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]*)\)', 1), regexp_extract_all(text, '<img\b[^>]*\bsrc\s*=\s*["'']([^"'']+)["'']', 1))), '.*/', '') AS file FROM out_),
    p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM i WHERE i.doc_id = figs.doc_id AND i.file = figs.file)) AS placed FROM figs GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT x) AS left_over FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\(\s*(FIG_\d+)\s*\)', 1)) AS x FROM out_) GROUP BY doc_id),
    u AS (SELECT doc_id, count(*) AS odd FROM i WHERE starts_with(file, 'img-') AND NOT EXISTS (SELECT 1 FROM figs WHERE figs.doc_id = i.doc_id AND figs.file = i.file) GROUP BY doc_id),
    j AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(placed, 0) AS placed, coalesce(left_over, 0) AS lo, coalesce(odd, 0) AS odd FROM out_ LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)),
    r AS (SELECT doc_id, CASE WHEN lo > 0 THEN 'fail' WHEN n - placed + odd > 0 THEN 'warn' ELSE 'ok' END AS status, CASE WHEN n > 0 THEN round(100.0::DOUBLE * placed / n, 1)::VARCHAR END AS metric, n - placed + lo + odd AS n_findings FROM j)""",
)
one(
    "structural_counts",
    r"""f AS (SELECT doc_id, count(*) AS n FROM figs GROUP BY doc_id), o AS (SELECT doc_id, coalesce(n, 0) AS n, len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]*\)')) AS images FROM out_ LEFT JOIN f USING (doc_id) WHERE text <> ''),
    r AS (SELECT doc_id, CASE WHEN images < n THEN 'warn' ELSE 'ok' END AS status, NULL::VARCHAR AS metric, (images < n)::INT AS n_findings FROM o)""",
)
one(
    "oversized_tables",
    r"""l AS (SELECT doc_id, count(*) AS n FROM grids WHERE n_columns >= 45 OR n_rows * n_columns >= 2500 GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS crops FROM figs WHERE origin = 'oversized-table' GROUP BY doc_id),
    w AS (SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?s)<tr\b.*?</tr>'), lambda x: len(regexp_extract_all(x, '<t[dh]')) >= 45)) > 0 AS wide FROM out_),
    j AS (SELECT doc_id, coalesce(n, 0) > 0 AND coalesce(crops, 0) = 0 AND NOT wide AS gone FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
    r AS (SELECT doc_id, CASE WHEN gone THEN 'warn' ELSE 'ok' END AS status, NULL::VARCHAR AS metric, gone::INT AS n_findings FROM j)""",
)
one(
    "wide_table_legibility",
    r"""n AS (SELECT doc_id, len(regexp_extract_all(text, '#set text\(size: (5|6)pt\)')) AS n FROM out_ WHERE coalesce(text, '') <> ''),
    r AS (SELECT doc_id, CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END AS status, NULL::VARCHAR AS metric, (n > 0)::INT AS n_findings FROM n)""",
)
one(
    "footnote_placement",
    r"""a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[\^([^\]\s]+)\](:?)', 1)) AS note, unnest(regexp_extract_all(text, '\[\^([^\]\s]+)\](:?)', 2)) AS c FROM out_), u AS (SELECT doc_id, count(*) AS used FROM a WHERE c = '' GROUP BY doc_id),
    k AS (SELECT DISTINCT doc_id, note FROM a WHERE c = ''), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?m)^\[\^([^\]\s]+)\]:', 1)) AS note FROM out_),
    b AS (SELECT doc_id, count(*) FILTER (d.note IS NOT NULL AND k.note IS NOT NULL) AS res, count(*) FILTER (d.note IS NULL) AS dang, count(*) FILTER (k.note IS NULL) AS orph FROM k FULL JOIN d USING (doc_id, note) GROUP BY doc_id),
    -- these lines hold no runs of small digits
    m AS (SELECT doc_id, sum(len(regexp_extract_all(text, '[⁰¹²³⁴⁵⁶⁷⁸⁹]'))) AS marks FROM lines_ WHERE line_no >= 15 AND NOT regexp_matches(text, '[∑∏∫∂∞≤≥].*[∑∏∫∂∞≤≥]') GROUP BY doc_id),
    j AS (SELECT doc_id, coalesce(used, 0) AS used, coalesce(res, 0) AS res, coalesce(dang, 0) AS dang, coalesce(orph, 0) AS orph, coalesce(marks, 0) AS marks FROM out_ LEFT JOIN u USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)),
    w AS (SELECT *, dang + orph + (marks > 0 AND abs(marks - used) > greatest(1, marks // 5))::INT AS n FROM j WHERE used > 0 OR marks > 0),
    r AS (SELECT doc_id, CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END AS status, CASE WHEN res + dang > 0 THEN res::VARCHAR || '/' || (res + dang)::VARCHAR || ' resolved' END AS metric, n AS n_findings FROM w)""",
)
