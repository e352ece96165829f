"""Scans of what a run reads and left behind: source files and JSON sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import stored

#: Fields of the sidecars that are read.
PHASE_ONE = "pages_total long, pages_candidate long, pages_skipped long, figures long, tables long"
RESULT = "stem string, status string, cost_usd double, figures long, verify_status string, text_cov double, table_cov double, error string, phase_cost struct<cover: double, detect: double, convert: double>"
DETECTIONS = "figures array<struct<fig_id: string, page: int, file: string, caption: string, origin: string, bbox: array<double>>>"


def documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id (file name without ending), path, size, content of the files of one folder, not of those below it.

    No file of that kind gives no rows.  Contents are read only where they are selected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select(stem.alias("doc_id"), "path", F.col("length").alias("size"), "content")


def numbered(files: DataFrame) -> DataFrame:
    """doc_id, path, size, index (from 0), total: the order by path in which a batch works through its files."""
    listed = files.select("doc_id", "path", "size").repartitionByRange("path").sortWithinPartitions("path")
    # numbers within the ranges, then those of the ranges before: one row a range
    own = listed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    own = stored(own, "files")
    before = own.groupBy("part").agg(F.count("*").alias("n"))
    ranges = before.alias("a").join(before.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("offset"))
    total = before.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return own.join(ranges, "part").join(F.broadcast(total)).select("doc_id", "path", "size", (F.col("place") + F.col("offset")).alias("index"), "total")


def sidecars(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """doc_id (the folder) and the fields of each ``<root>/<folder>/<name>``; folders that begin with ``_`` are left out.

    Fields that are missing or of another type are null; a file that isn't JSON gives nulls alone.
    """
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(folder.alias("doc_id"), *[F.col(c) for c in rows.columns]).where(~F.col("doc_id").startswith("_"))


def history(first: DataFrame, result: DataFrame) -> DataFrame:
    """doc_id, pages_total, pages_candidate, detect_usd, convert_usd of the runs that left both sidecars (``PHASE_ONE``, ``RESULT``): what a calibration sums."""
    known = first.where("pages_total is not null or pages_candidate is not null").join(result.where("status is not null or phase_cost is not null"), "doc_id")
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    return known.select("doc_id", zero("pages_total", "long").alias("pages_total"), zero("pages_candidate", "long").alias("pages_candidate"), zero("phase_cost.detect", "double").alias("detect_usd"), zero("phase_cost.convert", "double").alias("convert_usd"))


def results(runs: DataFrame, saved: DataFrame, detections: DataFrame, reports: DataFrame) -> DataFrame:
    """doc_id, status, figures, text_coverage, table_coverage of each run (doc_id): as saved, else from its detections and report.

    saved: doc_id, status, figures, text_cov, table_cov; detections: doc_id, figures (array); reports:
    doc_id, status, text_coverage, table_coverage.  A run that left nothing is ``ok`` without figures.
    """
    kept = saved.select("doc_id", F.lit(True).alias("saved"), F.col("status").alias("s_status"), F.col("figures").alias("s_figures"), F.col("text_cov").alias("s_text"), F.col("table_cov").alias("s_table"))
    counted = detections.select("doc_id", F.size(F.coalesce("figures", F.array())).cast("long").alias("d_figures"))
    told = runs.select("doc_id").distinct().join(kept, "doc_id", "left").join(counted, "doc_id", "left").join(reports, "doc_id", "left")
    pick = lambda own, derived: F.when(F.col("saved"), F.col(own)).otherwise(derived)
    return told.select(
        "doc_id",
        pick("s_status", F.coalesce("status", F.lit("ok"))).alias("status"),
        pick("s_figures", F.coalesce("d_figures", F.lit(0).cast("long"))).alias("figures"),
        pick("s_text", F.col("text_coverage")).alias("text_coverage"),
        pick("s_table", F.col("table_coverage")).alias("table_coverage"),
    )
