"""Queries on regions, media, chunks, code listings, front matter, replies and sidecars, over inline tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import regions
from ..sources import scan, sinks
from .registry import Inline, query

PAGES = Inline("pages_", "doc_id int, page_no int", [(1, p) for p in range(23)] + [(2, 0), (2, 1), (3, 5)])
COVERS = Inline("covers", "doc_id int, page_no int, is_cover boolean", [(1, 0, True), (1, 1, True), (2, 0, False), (3, 5, True), (1, 0, True)])


@query("candidates_without_cover", f"WITH {PAGES.cte}, {COVERS.cte} SELECT * FROM pages_ p WHERE NOT EXISTS (SELECT 1 FROM covers c WHERE c.doc_id = p.doc_id AND c.page_no = p.page_no AND is_cover AND c.page_no = 0)")
def candidates_without_cover(spark, sf_dir):
    return regions.without_cover(PAGES.df(spark), COVERS.df(spark))


@query("page_ranges", f"WITH {PAGES.cte} SELECT doc_id, page_no // 10 AS chunk, min(page_no) AS first_page, max(page_no) AS last_page FROM pages_ GROUP BY ALL")
def page_ranges(spark, sf_dir):
    return regions.page_ranges(PAGES.df(spark), 8192).withColumn("chunk", F.col("chunk").cast("int"))


BOX = "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double"
DETECTED = Inline("detected", BOX, [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 5.0, 5.0), (2, 0, None, None, None, None)])
OVERSIZED = Inline("oversized", BOX, [(1, 0, 0.0, 0.0, 10.0, 19.0), (1, 0, 0.0, 0.0, 10.0, 21.0), (1, 1, 6.0, 6.0, 9.0, 9.0), (2, 0, 1.0, 1.0, 2.0, 2.0)])


@query("regions_with_oversized", f"""WITH {DETECTED.cte}, {OVERSIZED.cte} SELECT * FROM detected UNION ALL SELECT * FROM oversized o WHERE NOT EXISTS (SELECT 1 FROM detected d WHERE d.doc_id = o.doc_id AND d.page_no = o.page_no
    AND greatest(0, least(o.x1, d.x1) - greatest(o.x0, d.x0)) * greatest(0, least(o.y1, d.y1) - greatest(o.y0, d.y0)) > 0.5 * (o.x1 - o.x0) * (o.y1 - o.y0) AND d.x0 IS NOT NULL)""")
def regions_with_oversized(spark, sf_dir):
    return regions.with_oversized(DETECTED.df(spark), OVERSIZED.df(spark))


@query("exclusion_boxes", f"WITH {DETECTED.cte}, {OVERSIZED.cte} SELECT *, 'figure' AS reason FROM detected UNION ALL SELECT *, 'chrome' FROM oversized")
def exclusion_boxes(spark, sf_dir):
    return regions.exclusion_boxes(DETECTED.df(spark), OVERSIZED.df(spark))


RASTERS = Inline("rasters", "doc_id int, page_no int, y0 double, x0 double, data string, ext string", [(1, 1, 5.0, 5.0, "aa", "png"), (1, 0, 9.0, 1.0, "aa", "png"), (1, 0, 9.0, 0.5, "bb", "jpg"), (2, 0, 0.0, 0.0, "aa", "png"), (2, 0, 0.0, 0.0, None, "png"), (1, 1, 5.0, 5.0, "aa", "png")])


@query("media_files", f"""WITH {RASTERS.cte}, r AS (SELECT *, md5(data) AS digest, row_number() OVER (PARTITION BY doc_id, data ORDER BY page_no, y0, x0) AS rn, count(*) OVER (PARTITION BY doc_id, data) AS copies FROM rasters WHERE data IS NOT NULL)
    SELECT doc_id, digest, 'img-' || digest || '.' || ext AS file, page_no, y0, x0, copies FROM r WHERE rn = 1""")
def media_files(spark, sf_dir):
    return regions.media_files(RASTERS.df(spark).withColumn("bytes", F.col("data").cast("binary")))


CHUNKS = Inline("chunks", "doc_id int, chunk int, text string", [(1, 1, "---\ntitle: b\n---\nsecond "), (1, 0, "---\ntitle: a\n---\nfirst\n"), (1, 2, None), (2, 0, "only"), (3, 0, "")])


@query("recombined", f"""WITH {CHUNKS.cte}, b AS (SELECT doc_id, chunk, trim(CASE WHEN chunk = min(chunk) OVER (PARTITION BY doc_id) THEN text ELSE regexp_replace(text, '(?s)\\A---\\s*\\n.*?\\n---\\s*\\n', '') END, ' ' || chr(10)) AS body FROM chunks)
    SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY chunk) AS text FROM b WHERE body <> '' GROUP BY doc_id""")
def recombined(spark, sf_dir):
    return regions.recombined(CHUNKS.df(spark))


TABLES = Inline("tables_", "doc_id int, page_no int, box_id int, x0 double, y0 double, x1 double, y1 double", [(1, 0, 1, 0.0, 100.0, 100.0, 200.0), (1, 0, 2, 0.0, 400.0, 100.0, 500.0), (1, 1, 3, 0.0, 0.0, 10.0, 10.0)])
NEAR = Inline("near_", "doc_id int, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double", [(1, 0, 1, "some text", 0.0, 60.0, 50.0, 70.0), (1, 0, 2, "see Table 3:  the  caption", 0.0, 210.0, 50.0, 220.0), (1, 0, 3, "Figure 9 too far", 0.0, 300.0, 50.0, 310.0), (1, 1, 1, "Table", 0.0, 0.0, 5.0, 5.0)])


@query("nearby_captions", f"""WITH {TABLES.cte}, {NEAR.cte}, b AS (SELECT t.doc_id, t.page_no, box_id, string_agg(text, chr(10) ORDER BY line_no) AS band FROM tables_ t LEFT JOIN near_ n ON t.doc_id = n.doc_id AND t.page_no = n.page_no AND n.x1 > t.x0 AND n.x0 < t.x1 AND n.y1 > t.y0 - 45 AND n.y0 < t.y1 + 45 GROUP BY ALL)
    SELECT doc_id, page_no, box_id, trim(regexp_replace(left(regexp_extract(coalesce(band, ''), '(?is)\\b(?:figure|table)\\s+\\d+\\b.*', 0), 140), '\\s+', ' ', 'g')) AS caption FROM b""")
def nearby_captions(spark, sf_dir):
    return regions.nearby_captions(TABLES.df(spark), NEAR.df(spark))


MONO = Inline("mono", "doc_id int, page_no int, y0 double, y1 double, text string, mono_spans int, spans int", [
    (1, 0, 10.0, 20.0, "def f():\n    return 1", 4, 4), (1, 0, 55.0, 60.0, "f()", 2, 3), (1, 0, 101.0, 110.0, "$ run the thing", 2, 2), (1, 0, 111.0, 112.0, "prose", 1, 9), (1, 1, 0.0, 1.0, "x", 2, 2), (2, 0, 0.0, 9.0, "present  code here", 3, 3),
])
GROUPS = f"""{MONO.cte}, c AS (SELECT *, coalesce(y0 - lag(y1) OVER w > 40, false) AS parts FROM mono WHERE mono_spans >= 2 AND mono_spans >= 0.6 * spans WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0)),
    g AS (SELECT *, sum(parts::INT) OVER (PARTITION BY doc_id, page_no ORDER BY y0)::INTEGER AS group_no FROM c), t AS (SELECT doc_id, page_no, group_no, string_agg(text, chr(10) ORDER BY y0) AS text FROM g GROUP BY ALL)"""


@query("code_groups", f"WITH {GROUPS} SELECT * FROM t")
def code_groups(spark, sf_dir):
    return regions.code_groups(MONO.df(spark))


CONVERTED = Inline("converted", "doc_id int, text string, out string, n int", [(1, "body\n\n", "body\n\n<!-- postfix: code-block recovery -->\n\n```python\ndef f():\n    return 1\nf()\n```\n\n```bash\n$ run the thing\n```\n", 2), (2, "has present code\nhere", "has present code\nhere", 0)])


@query("recover_code", f"WITH {CONVERTED.cte} SELECT doc_id, out AS text, n FROM converted")
def recover_code(spark, sf_dir):
    return regions.recover_code(CONVERTED.df(spark).select("doc_id", "text"), code_groups(spark, sf_dir))


FRONT = Inline("front", "doc_id int, text string, title string, date string, out string", [
    (1, "---\ntitle: M\ncategory: x\ndate: March 2019-05\n---\nbody", "It's C", "2020", "---\ntitle: 'It''s C'\ncategory: products\ndate: '2019-05-01'\nsubtitle: ''\n---\nbody"),
    (2, "no front", "", "2021", "---\ncategory: products\ndate: '2021-01-01'\nsubtitle: ''\n---\n\nno front"), (3, None, None, None, "---\ncategory: products\ndate: '2000-01-01'\nsubtitle: ''\n---\n\n"),
])


@query("normalized_front_matter", f"WITH {FRONT.cte} SELECT doc_id, out AS text FROM front")
def normalized_front_matter(spark, sf_dir):
    cover = F.struct("title", F.lit("").alias("subtitle"), "date", F.lit(None).cast("string").alias("version"))
    return FRONT.df(spark).select("doc_id", metadata.normalized_front_matter(F.col("text"), F.lit("products"), F.lit("2000-01-01"), cover).alias("text"))


@query("template_front_matter", f"WITH {FRONT.cte} SELECT doc_id, CASE doc_id WHEN 1 THEN '---' || chr(10) || 'kind: ''k''' || chr(10) || 'title: ''M''' || chr(10) || '---' || chr(10) || 'body' WHEN 2 THEN '---' || chr(10) || 'kind: ''k''' || chr(10) || 'title: ''''' || chr(10) || '---' || chr(10) || 'no front' ELSE '---' || chr(10) || 'kind: ''k''' || chr(10) || 'title: ''''' || chr(10) || '---' || chr(10) END AS text FROM front")
def template_front_matter(spark, sf_dir):
    return FRONT.df(spark).select("doc_id", metadata.template_front_matter(F.col("text"), ["kind", "title"], {"kind": "k"}).alias("text"))


REPLIES = Inline("replies", "reply_id int, reply string, json string, n int, body string, entries string", [
    (1, 'I think {x} so: {"figures": [{"bbox": [1, 2, 3, 4], "type": "figure"}], "excluded_tables": [{"bbox": [0, 0, 1, 1]}]} ok', '[{"bbox": [1, 2, 3, 4], "type": "figure"}]', 1, None, None),
    (2, 'body\n```json\n[{"a": 1,}]\n```', '[{"a": 1}]', 0, None, None), (3, 'text\n```json\n[{"bbox": [1, 1, 2, 2]}]\n``` end', '[{"bbox": [1, 1, 2, 2]}]', 1, "text", '[{"bbox": [1, 1, 2, 2]}]'),
    (4, '{"tables": [{"bbox": [0, 0, 1, 1]}], "deep": {"er": [{"bbox": [1, 2, 3, 4]}]}}', '{"tables": [{"bbox": [0, 0, 1, 1]}], "deep": {"er": [{"bbox": [1, 2, 3, 4]}]}}', 1, None, None), (5, "nothing", None, 0, None, None), (6, None, None, 0, None, None),
])


@query("reply_json", f"WITH {REPLIES.cte} SELECT reply_id, json, n FROM replies")
def reply_json(spark, sf_dir):
    found = REPLIES.df(spark).select("reply_id", metadata.reply_json(F.col("reply")).alias("json"))
    return found.select("reply_id", "json", F.size(metadata.reply_boxes(F.col("json"))).alias("n"))


@query("manifest_split", f"WITH {REPLIES.cte} SELECT reply_id, coalesce(body, reply) AS body, entries FROM replies")
def manifest_split(spark, sf_dir):
    return REPLIES.df(spark).select("reply_id", metadata.manifest(F.col("reply")).alias("m")).select("reply_id", "m.body", "m.entries")


GATE = Inline("gate", "doc_id int, page_no int, candidate boolean", [(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False)])


@query("phase_summary", f"WITH {GATE.cte} SELECT doc_id, count(*) AS pages_total, count(*) FILTER (candidate) AS pages_candidate, count(*) FILTER (NOT candidate) AS pages_skipped, coalesce(list(page_no ORDER BY page_no) FILTER (candidate), []) AS candidate_pages, count(*) FILTER (candidate AND doc_id = 1) AS figures FROM gate GROUP BY doc_id")
def phase_summary(spark, sf_dir):
    return sinks.phase_summary(GATE.df(spark), GATE.df(spark).where("candidate").select("doc_id"))


SAVED = Inline("saved", "doc_id int, status string, figures long, text_cov double, table_cov double", [(1, "ok", 3, 99.0, None)])
REPORTS = Inline("reports_", "doc_id int, status string, text_coverage double, table_coverage double", [(1, "fail", 1.0, 1.0), (2, "warn", 80.5, None)])


@query("results_with_fallbacks", f"WITH {GATE.cte}, {SAVED.cte}, {REPORTS.cte}, r AS (SELECT DISTINCT doc_id FROM gate UNION SELECT 3) SELECT r.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN s.status ELSE coalesce(p.status, 'ok') END AS status, coalesce(s.figures, CASE WHEN r.doc_id = 2 THEN 1 ELSE 0 END)::BIGINT AS figures, CASE WHEN s.doc_id IS NOT NULL THEN s.text_cov ELSE p.text_coverage END AS text_coverage, CASE WHEN s.doc_id IS NOT NULL THEN s.table_cov ELSE p.table_coverage END AS table_coverage FROM r LEFT JOIN saved s ON r.doc_id = s.doc_id LEFT JOIN reports_ p ON r.doc_id = p.doc_id")
def results_with_fallbacks(spark, sf_dir):
    runs = GATE.df(spark).select("doc_id").unionByName(spark.range(3, 4).select(F.col("id").cast("int").alias("doc_id")))
    detections = spark.createDataFrame([(2, ["f"])], "doc_id int, figures array<string>")
    return scan.results(runs, SAVED.df(spark), detections, REPORTS.df(spark))
