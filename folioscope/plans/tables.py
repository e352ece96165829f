"""Queries on tables, over inline grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .registry import Inline, query
from .text import TOKENS, norm

GRIDS = Inline("grids", "doc_id int, table_no int, text string", [
    (1, 1, "name value alpha 1 beta 2 gamma 3 delta 4 epsilon 5 zeta 6 eta 7"), (1, 2, "other thing"), (2, 1, "one two three"), (2, 2, "a b"), (3, 1, "lost table here"),
])
OUT = Inline("out_", "doc_id int, table_no int, text string", [(1, 1, "Name | Value | alpha | 1 | beta | 2"), (1, 2, "name value gamma alpha 1 beta"), (1, 3, "nothing shared"), (2, 1, "three two one"), (2, 2, "b, a")])
BEST = f"""{GRIDS.cte}, {OUT.cte}, a AS (SELECT doc_id, table_no, {norm('text')} AS n FROM grids), b AS (SELECT doc_id, table_no AS match, {norm('text')} AS n FROM out_),
    w AS (SELECT doc_id, table_no, unnest(list_distinct({TOKENS.format(n='n')})) AS token FROM a), h AS (SELECT doc_id, match, unnest(list_distinct({TOKENS.format(n='n')})) AS token FROM b),
    j AS (SELECT doc_id, table_no, match, count(*) AS hits FROM w JOIN h USING (doc_id, token) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY hits DESC, match) AS rn FROM j),
    s AS (SELECT doc_id, table_no, count(*) AS n_tokens FROM w GROUP BY ALL),
    best AS (SELECT s.doc_id, s.table_no, n_tokens, coalesce(hits, 0) AS hits, match FROM s LEFT JOIN r ON s.doc_id = r.doc_id AND s.table_no = r.table_no AND rn = 1)"""


@query("table_best_match", f"WITH {BEST} SELECT doc_id, table_no, n_tokens, hits, coalesce(match, -1) AS match FROM best")
def table_best_match(spark, sf_dir):
    return tables.best_match(GRIDS.df(spark), OUT.df(spark)).fillna(-1, ["match"])


@query("table_weighted_coverage", f"WITH {BEST} SELECT doc_id, sum(hits)::BIGINT AS hits, sum(n_tokens)::BIGINT AS n_tokens, sum(hits) / sum(n_tokens) AS coverage, CASE WHEN sum(hits) / sum(n_tokens) < 0.85 THEN 'warn' ELSE 'ok' END AS status, count(*) FILTER (n_tokens >= 12 AND hits < 0.7 * n_tokens) AS thin FROM best GROUP BY doc_id")
def table_weighted_coverage(spark, sf_dir):
    return tables.weighted_coverage(table_best_match(spark, sf_dir))


CELLS = Inline("cells_", "doc_id int, table_no int, cells array<string>", [(1, i, ["Head", "", "Page", str(i)]) for i in range(4)] + [(1, 9, ["x"]), (2, 1, ["", "!"]), (2, 2, ["a", "b"])])


@query("running_table_headers", f"WITH {CELLS.cte}, f AS (SELECT doc_id, list_filter([{norm('c')} FOR c IN cells], lambda c: c <> '') AS k FROM cells_), p AS (SELECT doc_id, array_to_string(k[1:2], ' ') AS fingerprint FROM f) SELECT doc_id, fingerprint, count(*) AS n FROM p WHERE fingerprint <> '' GROUP BY ALL HAVING count(*) >= 4")
def running_table_headers(spark, sf_dir):
    pages = spark.createDataFrame([(1, 8), (2, 2)], "doc_id int, total_pages int")
    return tables.running_headers(CELLS.df(spark), pages)


BLEED = Inline("bleed", "doc_id int, text string", [(1, "annual report total cost 1"), (1, "Annual Report | total cost | 2"), (1, "see annual report total"), (1, "other words only"), (2, "annual report total"), (2, "annual report total")])


@query(
    "header_bleed_ngrams",
    f"""WITH {BLEED.cte}, w AS (SELECT row_number() OVER () AS k, doc_id, {norm('text')} AS n FROM bleed), t AS (SELECT k, doc_id, {TOKENS.format(n='n')} AS t FROM w),
    g AS (SELECT DISTINCT k, doc_id, unnest(list_concat([array_to_string(t[i:i+1], ' ') FOR i IN range(1, len(t))], [array_to_string(t[i:i+2], ' ') FOR i IN range(1, len(t) - 1)])) AS gram FROM t),
    n AS (SELECT doc_id, count(*) AS total FROM bleed GROUP BY doc_id HAVING count(*) >= 3)
    SELECT doc_id, gram, count(*) AS n_tables FROM g JOIN n USING (doc_id) WHERE length(gram) >= 8 GROUP BY doc_id, gram, total HAVING count(*) >= greatest(3, floor(0.7 * total))""",
)
def header_bleed_ngrams(spark, sf_dir):
    return tables.header_bleed(BLEED.df(spark))


def row(cells: int, tag: str = "td", span: int = 1) -> str:
    return "<tr>" + f"<{tag}{f' colspan={chr(34)}{span}{chr(34)}' if span > 1 else ''}>x</{tag}>" * cells + "</tr>"


HTML = Inline("html_", "table_id int, html string, header_width int, data_width int, uniform boolean, columns int, consistent boolean", [
    (1, f"<table><thead>{row(25, 'th')}</thead><tbody>{row(16) * 2}</tbody></table>", 25, 16, True, 0, False), (2, f"<table><thead>{row(13, 'th')}</thead><tbody>{row(15)}</tbody></table>", 13, 15, True, 0, False),
    (3, f"<table>{row(3, 'th')}{row(3)}{row(2)}</table>", 3, 3, False, 0, True), (4, f"<table><col><col><thead>{row(1, 'th', 4)}</thead><tbody>{row(4)}</tbody></table>", 4, 4, True, 2, False),
    (5, f"<table>{row(2, 'th')}{row(5)}{row(3)}{row(3)}</table>", 2, 3, False, 0, True), (6, "no table", 0, 0, False, 0, True),
])


@query("table_width_consistency", f"WITH {HTML.cte} SELECT table_id, header_width, data_width, uniform, columns, consistent FROM html_")
def table_width_consistency(spark, sf_dir):
    return tables.width_consistency(HTML.df(spark).select("table_id", "html"))


PIPES = Inline("pipes", "table_id int, text string", [
    (1, "| Number of Sample Units SC01-02 | b |\n|---|:-:|\n| 1,416 | longer words |\n"), (2, "| " + "w" * 70 + " | " + "v" * 45 + " |\n|--|--|\n"), (3, "| " + " | ".join(["abcdefghij"] * 16) + " |"), (4, "no table"),
])
PROFILE = f"""WITH {PIPES.cte}, r AS (SELECT table_id, unnest(string_split(text, chr(10))) AS row FROM pipes), d AS (SELECT table_id, string_split(regexp_replace(row, '^\\s*\\||\\|\\s*$', '', 'g'), '|') AS c FROM r WHERE regexp_matches(row, '^\\s*\\|') AND NOT regexp_matches(row, '^[\\s|:-]+$')),
    c AS (SELECT table_id, (i - 1)::INTEGER AS column_no, trim(c[i]) AS cell FROM (SELECT table_id, c, unnest(range(1, len(c) + 1)) AS i FROM d)),
    p AS (SELECT table_id, column_no, max(length(cell))::INTEGER AS max_length, max(list_max([length(x) FOR x IN string_split_regex(cell, '\\s+')]))::INTEGER AS max_token FROM c GROUP BY ALL)"""


@query("column_profile", f"{PROFILE} SELECT * FROM p")
def column_profile(spark, sf_dir):
    return tables.pipe_profile(PIPES.df(spark))


@query("page_tier", f"{PROFILE}, w AS (SELECT table_id, (sum(max_token) + count(*))::BIGINT AS width FROM p GROUP BY table_id) SELECT *, CASE WHEN width <= 75 THEN 'portrait' WHEN width <= 110 THEN 'a4-landscape' WHEN width <= 125 THEN 'a3-landscape' WHEN width <= 165 THEN 'a3-xl' ELSE 'a3-xxl' END AS tier FROM w")
def page_tier(spark, sf_dir):
    return tables.page_tiers(column_profile(spark, sf_dir))


@query("colgroup_widths", f"""{PROFILE}, w AS (SELECT *, greatest(1, max_token) + 3 + 0.3::DOUBLE * least(greatest(1, max_length), 3 * greatest(1, max_token)) AS wt FROM p), s AS (SELECT *, greatest(3.0::DOUBLE, wt * 100.0 / sum(wt) OVER (PARTITION BY table_id)) AS sh FROM w)
    SELECT table_id, column_no, round(sh * 100.0 / sum(sh) OVER (PARTITION BY table_id), 9) AS percent FROM s""")
def colgroup_widths(spark, sf_dir):
    return tables.column_widths(column_profile(spark, sf_dir)).withColumn("percent", F.round("percent", 9))


SIZES = Inline("sizes", "table_id int, n_rows int, n_columns int", [(1, 1, 45), (2, 1, 44), (3, 100, 25), (4, 99, 25), (5, 0, 0)])


@query("oversized_tables", f"WITH {SIZES.cte} SELECT table_id, n_columns >= 45 OR n_rows * n_columns >= 2500 AS oversized FROM sizes")
def oversized_tables(spark, sf_dir):
    grid = F.when(F.col("n_rows") > 0, F.array_repeat(F.array_repeat(F.lit("x"), F.col("n_columns")), F.col("n_rows"))).otherwise(F.array().cast("array<array<string>>"))
    return SIZES.df(spark).select("table_id", tables.is_oversized(grid).alias("oversized"))
