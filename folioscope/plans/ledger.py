"""Queries that write what a run leaves behind and read it again: sidecars, runs as partitions, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting
from ..operators.store import scratch
from ..sources import scan, sidecars, sinks
from .registry import query, table

#: Orders of a month and priority are a document; its line items are the pages, those sent back the candidates.
MONTHS = """m AS (SELECT strftime(o_orderdate, '%Y-%m') || ' ' || o_orderpriority AS doc_id, count(*) AS pages_total, count(*) FILTER (l_returnflag = 'R') AS pages_candidate,
    sum(l_linenumber)::BIGINT AS steps FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""


def months(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM"), "o_orderpriority").alias("doc_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("doc_id").agg(F.count("*").alias("pages_total"), F.count_if(F.col("l_returnflag") == "R").alias("pages_candidate"), F.sum("l_linenumber").alias("steps"))


def sidecar_root(spark, sf_dir):
    """A root with the sidecars of all months."""
    root = scratch(spark, "sidecars")
    sidecars.register(spark)
    found = months(spark, sf_dir)
    cost = F.struct((F.col("pages_candidate") * F.lit(0.01)).alias("detect"), (F.col("steps") * F.lit(0.005)).alias("convert"))
    for name, df in (("phase1.json", found.select("doc_id", "pages_total", "pages_candidate")), ("result.json", found.select("doc_id", F.lit("ok").alias("status"), cost.alias("phase_cost")))):
        df.write.format("sidecars").option("name", name).mode("append").save(root)
    return root


def read_sidecars(spark, root, name, schema):
    return spark.read.format("sidecars").schema("doc_id string, " + schema).option("name", name).load(root)


@query("sidecar_scan", f"WITH {MONTHS} SELECT doc_id, pages_total, pages_candidate, round(pages_candidate * 0.01::DOUBLE, 6) AS detect_usd, round(steps * 0.005::DOUBLE, 6) AS convert_usd FROM m")
def sidecar_scan(spark, sf_dir):
    root = sidecar_root(spark, sf_dir)
    found = scan.history(read_sidecars(spark, root, "phase1.json", scan.PHASE_ONE), read_sidecars(spark, root, "result.json", scan.RESULT))
    return found.select("doc_id", "pages_total", "pages_candidate", F.round("detect_usd", 6).alias("detect_usd"), F.round("convert_usd", 6).alias("convert_usd"))


@query(
    "sidecar_calibration",
    f"""WITH {MONTHS} SELECT 0.005::DOUBLE AS cover_usd, coalesce(round(sum(pages_candidate * 0.01::DOUBLE) FILTER (pages_candidate > 0) / sum(pages_candidate) FILTER (pages_candidate > 0), 9), 0.015)::DOUBLE AS detect_usd_per_candidate,
    coalesce(round(sum(steps * 0.005::DOUBLE) / sum(pages_total), 9), 0.035)::DOUBLE AS convert_usd_per_page, count(*) AS n_docs FROM m WHERE doc_id >= '1996' AND NOT starts_with(doc_id, '1997-01 5') AND doc_id <> '1998-02 1-URGENT'""",
)
def sidecar_calibration(spark, sf_dir):
    """Rates from the runs since 1996, two of them left out; folders before are not opened."""
    root = sidecar_root(spark, sf_dir)
    since = lambda df: df.where("doc_id >= '1996' and not startswith(doc_id, '1997-01 5') and doc_id <> '1998-02 1-URGENT'")
    found = scan.history(since(read_sidecars(spark, root, "phase1.json", scan.PHASE_ONE)), since(read_sidecars(spark, root, "result.json", scan.RESULT)))
    rates = accounting.calibration(found)
    return rates.select("cover_usd", F.round("detect_usd_per_candidate", 9).alias("detect_usd_per_candidate"), F.round("convert_usd_per_page", 9).alias("convert_usd_per_page"), "n_docs")


@query(
    "run_partitions",
    """SELECT o_orderpriority AS run_id, o_orderstatus AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F' GROUP BY ALL""",
)
def run_partitions(spark, sf_dir):
    """Runs written as partitions; one is written a second time and replaces its first write, the others stay."""
    path, orders = scratch(spark, "runs"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("status"))
    for run in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        sinks.write_run(orders.where(F.col("o_orderpriority") == run), path, run)
    sinks.write_run(orders.where("o_orderpriority = '1-URGENT' and status = 'F'"), path, "1-URGENT")
    return spark.read.schema(orders.schema.add("run_id", "string")).parquet(path).groupBy("run_id", "status").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "report_payloads",
    """SELECT l_orderkey AS doc_id, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 2 THEN 'warn' ELSE 'ok' END AS status, count(*) AS figures, sum(l_linenumber)::DOUBLE AS total_usd,
    CASE WHEN count(*) > 1 THEN 'ok' END AS verify_status, NULL::VARCHAR AS error FROM lineitem GROUP BY l_orderkey""",
)
def report_payloads(spark, sf_dir):
    """Reports as JSON, written as a table and read back field by field."""
    told = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.when(F.count_if(F.col("l_returnflag") == "R") > 2, "warn").otherwise("ok").alias("status"), F.count("*").alias("figures"), F.sum("l_linenumber").cast("double").alias("cost_usd"), F.when(F.count("*") > 1, "ok").alias("verify_status"),
    )
    none = F.lit(None)
    results = told.withColumns({"text_coverage": none.cast("double"), "table_coverage": none.cast("double"), "error": none.cast("string")})
    path = scratch(spark, "reports")
    sinks.report(results).write.parquet(path)
    r = F.from_json("payload", "status string, cost struct<total_usd: double>, verify struct<status: string>, figures long, error string")
    read = spark.read.parquet(path).select("doc_id", r.alias("r"))
    return read.select("doc_id", "r.status", "r.figures", F.col("r.cost.total_usd").alias("total_usd"), F.col("r.verify.status").alias("verify_status"), "r.error")


@query(
    "detection_payloads",
    """SELECT o_orderkey AS doc_id, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_suppkey, l_partkey, l_linenumber) FILTER (l_returnflag = 'R') AS figures,
    count(*) FILTER (l_returnflag <> 'R') AS others FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def detection_payloads(spark, sf_dir):
    """Detections of each document as one JSON object in reading order, read back."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("is_figure"), "l_linenumber", F.col("l_suppkey").cast("int").alias("page_no"), "l_partkey")
    lines = lines.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    boxes = lines.select(
        F.col("l_orderkey").alias("doc_id"), "is_figure", F.concat(F.lit("FIG_"), "l_linenumber").alias("fig_id"), F.lit("figure").alias("rtype"), F.concat("l_linenumber", F.lit(".png")).alias("file"),
        "page_no", F.col("l_linenumber").cast("double").alias("x0"), F.col("l_partkey").cast("double").alias("y0"), F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"),
    )
    told = sinks.region_payloads(boxes)
    r = F.from_json("payload", "figures array<struct<fig_id: string, file: string, page_no: int>>, other_detections array<struct<page_no: int>>")
    numbers = F.transform("r.figures", lambda f: F.replace(f["fig_id"], F.lit("FIG_"), F.lit("")))
    return told.select("doc_id", r.alias("r")).select("doc_id", F.when(F.col("r.figures").isNotNull(), F.array_join(numbers, ",")).alias("figures"), F.greatest(F.lit(0), F.coalesce(F.size("r.other_detections"), F.lit(0))).cast("long").alias("others"))
