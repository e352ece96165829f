"""Queries on costs, status, dates and front matter; orders and line items stand for spend ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import accounting
from .registry import Inline, query, table

HISTORY = Inline("history", "doc_id int, pages_total int, pages_candidate int, detect_usd double, convert_usd double", [(1, 10, 4, 0.40, 1.0), (2, 0, 0, 0.1, 0.2), (3, 5, 0, 0.3, 0.25)])
RATES = f"{HISTORY.cte}, rates AS (SELECT 0.005::DOUBLE AS cover_usd, coalesce(sum(detect_usd) FILTER (pages_candidate > 0) / sum(pages_candidate) FILTER (pages_candidate > 0), 0.015)::DOUBLE AS detect_usd_per_candidate, coalesce(sum(convert_usd) FILTER (pages_total > 0) / sum(pages_total) FILTER (pages_total > 0), 0.035)::DOUBLE AS convert_usd_per_page, count(*) AS n_docs FROM history)"


@query("calibration_ratio", f"WITH {RATES} SELECT * FROM rates")
def calibration_ratio(spark, sf_dir):
    return accounting.calibration(HISTORY.df(spark))


@query("calibration_seed", "SELECT 0.005::DOUBLE AS cover_usd, 0.015::DOUBLE AS detect_usd_per_candidate, 0.035::DOUBLE AS convert_usd_per_page, 0::BIGINT AS n_docs")
def calibration_seed(spark, sf_dir):
    return accounting.calibration(HISTORY.df(spark).limit(0))


JOBS = "SELECT o_orderkey AS doc_id, count(*) AS pages, count(*) FILTER (l_returnflag = 'R') AS candidate_pages FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"
ESTIMATES = f"WITH {RATES}, jobs AS ({JOBS}), est AS (SELECT doc_id, cover_usd + candidate_pages * detect_usd_per_candidate + pages * convert_usd_per_page AS expected_usd, cover_usd + candidate_pages * detect_usd_per_candidate + 0.5 * (pages * convert_usd_per_page) AS low_usd, cover_usd + candidate_pages * detect_usd_per_candidate + 3.0 * (pages * convert_usd_per_page) AS high_usd FROM jobs, rates)"


def jobs(spark, sf_dir):
    """An order is a document, its line items are the pages."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"), F.count_if(F.col("l_returnflag") == "R").alias("candidate_pages"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return orders.join(lines, F.col("doc_id") == F.col("l_orderkey")).drop("l_orderkey")


@query("estimate_bands", f"{ESTIMATES} SELECT doc_id, round(expected_usd, 9) AS expected_usd, round(low_usd, 9) AS low_usd, round(high_usd, 9) AS high_usd FROM est")
def estimate_bands(spark, sf_dir):
    told = accounting.estimates(jobs(spark, sf_dir), accounting.calibration(HISTORY.df(spark)))
    return told.select("doc_id", *[F.round(c, 9).alias(c) for c in ("expected_usd", "low_usd", "high_usd")])


@query("budget_gate", f"{ESTIMATES} SELECT CASE WHEN expected_usd > 0.5 THEN 'skip' ELSE 'run' END AS decision, count(*) AS n FROM est GROUP BY 1")
def budget_gate(spark, sf_dir):
    told = accounting.estimates(jobs(spark, sf_dir), accounting.calibration(HISTORY.df(spark)))
    return accounting.gated(told, 0.5).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    "budget_backstop",
    """WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice AS actual_usd, 1.1 * o_totalprice AS expected_usd FROM orders),
    s AS (SELECT *, coalesce(sum(actual_usd) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM l),
    b AS (SELECT *, max((spent_before + expected_usd > 1000000)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stopped FROM s)
    SELECT o_custkey, o_orderkey, round(spent_before, 2) AS spent_before, CASE WHEN stopped = 1 THEN 'skip' ELSE 'run' END AS decision FROM b""",
)
def budget_backstop(spark, sf_dir):
    """A customer is a batch, its orders the jobs."""
    ledger = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("actual_usd"), (1.1 * F.col("o_totalprice")).alias("expected_usd"))
    return accounting.backstop(ledger, ["o_custkey"], ["o_orderkey"], 1000000.0).select("o_custkey", "o_orderkey", F.round("spent_before", 2).alias("spent_before"), "decision")


STATUS = "CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' THEN 'warn' WHEN l_linestatus = 'F' THEN 'skipped' ELSE 'ok' END"


def checks(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").when(F.col("l_linestatus") == "F", "skipped").otherwise("ok")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), status.alias("status"), (F.col("l_extendedprice") * F.col("l_discount")).alias("cost_usd"), F.col("l_returnflag").alias("phase"))


@query("status_rollup", f"WITH c AS (SELECT l_orderkey AS doc_id, {STATUS} AS status FROM lineitem) SELECT doc_id, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status FROM c GROUP BY doc_id")
def status_rollup(spark, sf_dir):
    return accounting.worst_status(checks(spark, sf_dir))


@query("status_tally", f"SELECT {STATUS} AS status, count(*) AS n, count(DISTINCT l_orderkey) AS n_docs FROM lineitem GROUP BY 1")
def status_tally(spark, sf_dir):
    return checks(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("cost_rollup", f"WITH c AS (SELECT l_returnflag AS phase, {STATUS} AS status, l_extendedprice * l_discount AS cost_usd FROM lineitem) SELECT phase, status, count(*) AS n, round(sum(cost_usd), 2) AS cost_usd FROM c GROUP BY ROLLUP (phase, status)")
def cost_rollup(spark, sf_dir):
    return accounting.cost_rollup(checks(spark, sf_dir), "phase", "status").withColumn("cost_usd", F.round("cost_usd", 2))


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return accounting.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"))


ERRORS = Inline("errors", "error_id int, status int, message string, class string", [
    (1, 402, "x", "credits"), (2, None, "You have INSUFFICIENT credits", "credits"), (3, 413, "", "too_large"), (4, 400, "Request too large", "too_large"), (5, 400, "exceeds maximum context", "context_overflow"),
    (6, 429, "429 slow", "quota"), (7, 503, "", "transient"), (8, 500, "Service Unavailable", "transient"), (9, 404, "not found", "other"), (10, None, None, "other"),
])


@query("error_class", f"WITH {ERRORS.cte} SELECT error_id, class AS error_class FROM errors")
def error_class(spark, sf_dir):
    return ERRORS.df(spark).select("error_id", accounting.error_class(F.col("status"), F.col("message")).alias("error_class"))


USAGE = Inline("usage_", "usage_id int, usage string, cost double", [(1, '{"cost": 0.25, "tokens": 3}', 0.25), (2, '{"tokens": 3}', 0.0), (3, '{"cost": "free"}', 0.0), (4, "not json", 0.0), (5, None, 0.0), (6, '{"cost": 2}', 2.0)])


@query("usage_cost", f"WITH {USAGE.cte} SELECT usage_id, cost AS cost_usd FROM usage_")
def usage_cost(spark, sf_dir):
    return USAGE.df(spark).select("usage_id", accounting.usage_cost(F.col("usage")).alias("cost_usd"))


@query("eur_format", "SELECT o_orderkey, round(o_totalprice * 0.92, 4) AS eur, '€' || printf('%.2f', round(o_totalprice * 0.92, 4)) AS text FROM orders")
def eur_format(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", accounting.eur(F.col("o_totalprice")).alias("eur"), accounting.format_eur(F.col("o_totalprice")).alias("text"))


DATES = Inline("dates", "date_id int, value string, expected string", [(1, "2011", "2011-01-01"), (2, "2019-06-15", "2019-06-15"), (3, ' "2020-03" ', "2020-03-01"), (4, "June 2015", "2015-01-01"), (5, "'n/a'", "n/a"), (6, None, ""), (7, "v2 2018-07-09T10:00", "2018-07-09")])


@query("coerce_date", f"WITH {DATES.cte} SELECT date_id, expected AS value FROM dates")
def coerce_date(spark, sf_dir):
    return DATES.df(spark).select("date_id", metadata.coerce_date(F.col("value")).alias("value"))


FRONT = Inline("front", "doc_id int, text string, missing string, valid boolean", [
    (1, "---\ntitle: 'A'\nsubtitle: \"\"\ncategory: products\ndate: 2020-01-01\n---\nbody", "", True), (2, "---\ntitle: A\ncategory: other\n---\nbody\ndate: x", "subtitle,date", False), (3, "no front", "title,subtitle,category,date", False), (4, "", "title,subtitle,category,date", False),
])


@query("frontmatter_required", f"WITH {FRONT.cte} SELECT doc_id, missing, valid FROM front")
def frontmatter_required(spark, sf_dir):
    return FRONT.df(spark).select("doc_id", F.array_join(metadata.missing_fields(F.col("text")), ",").alias("missing"), metadata.valid_category(F.col("text")).alias("valid"))


MERGE = Inline("merge_", "doc_id int, cover string, model string", [(1, "C", "M"), (2, "", "M"), (3, None, ""), (4, "C", None)])


@query("frontmatter_merge", f"WITH {MERGE.cte} SELECT doc_id, coalesce(nullif(cover, ''), nullif(model, ''), 'untitled') AS title FROM merge_")
def frontmatter_merge(spark, sf_dir):
    return MERGE.df(spark).select("doc_id", metadata.merged(F.col("cover"), F.col("model"), F.lit("untitled")).alias("title"))


REPLIES = Inline("replies", "reply_id int, reply string, strict string, title string, version string", [
    (1, '{"title": "A", "version": "1",}', '{"title": "A", "version": "1"}', "A", "1"), (2, 'Here:\n```json\n{"title": "B"}\n```\nbye', None, "B", ""), (3, 'so {"title": "C", "version": null} it is', None, "C", ""), (4, "nothing", None, "", ""), (5, "[1, 2,]", "[1, 2]", "", ""),
])


@query("json_tolerant", f"WITH {REPLIES.cte} SELECT reply_id, strict FROM replies")
def json_tolerant(spark, sf_dir):
    return REPLIES.df(spark).select("reply_id", metadata.tolerant_json(F.col("reply")).alias("strict"))


@query("cover_fields", f"WITH {REPLIES.cte} SELECT reply_id, title, version FROM replies")
def cover_fields(spark, sf_dir):
    return REPLIES.df(spark).select("reply_id", metadata.cover_fields(F.col("reply")).alias("f")).select("reply_id", "f.title", "f.version")
