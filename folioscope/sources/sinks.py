"""What a run leaves behind, as tables: documents, detections, phase summaries, results and reports.

Spark's commit protocol makes each write whole or absent; rows of a run are a partition of
their table, which writing that run again replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write the rows of one run to ``path``; an earlier write of the same run is replaced, other runs stay."""
    told = df.withColumn("run_id", F.lit(run_id))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def detections(figures: DataFrame, others: DataFrame) -> DataFrame:
    """doc_id, payload: one JSON object a document with its ``figures`` and ``other_detections`` in reading order."""
    box = ("page_no", "x0", "y0", "x1", "y1")
    found = figures.select("doc_id", F.lit(True).alias("is_figure"), "fig_id", "file", F.lit(None).cast("string").alias("rtype"), *box)
    return region_payloads(found.unionByName(others.select("doc_id", F.lit(False).alias("is_figure"), "rtype", *box), allowMissingColumns=True))


def region_payloads(regions: DataFrame) -> DataFrame:
    """``detections`` of figures and others in one table (doc_id, is_figure, fig_id, file, rtype and box), grouped once.

    A document whose regions are neither (is_figure null) has an empty object.
    """

    def listed(chosen: Column, *more: str) -> Column:
        # as many as a document has regions; the fields of the order stand first
        rows = F.array_sort(F.collect_list(F.when(chosen, F.struct("page_no", "y0", "x0", *more, "x1", "y1"))))
        told = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in (*more, "page_no", "x0", "y0", "x1", "y1")]))
        return F.when(F.size(rows) > 0, told)

    both = regions.groupBy("doc_id").agg(listed(F.col("is_figure"), "fig_id", "file").alias("figures"), listed(~F.col("is_figure"), "rtype").alias("other_detections"))
    return both.select("doc_id", F.to_json(F.struct("figures", "other_detections")).alias("payload"))


def phase_summary(gate: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, pages_total, pages_candidate, pages_skipped, candidate_pages, figures from the page gate (doc_id, page_no, candidate)."""
    pages = gate.groupBy("doc_id").agg(
        F.count("*").alias("pages_total"), F.count_if("candidate").alias("pages_candidate"), F.count_if(~F.col("candidate")).alias("pages_skipped"), F.array_sort(F.collect_list(F.when(F.col("candidate"), F.col("page_no")))).alias("candidate_pages")
    )
    return pages.join(figures.groupBy("doc_id").agg(F.count("*").alias("figures")), "doc_id", "left").fillna(0, ["figures"])


def report(results: DataFrame) -> DataFrame:
    """doc_id, payload: the machine-readable report of each result (status, cost, coverage, figures, error); null fields are left out."""
    verify = F.struct(F.col("verify_status").alias("status"), "text_coverage", "table_coverage")
    cost = F.struct(F.col("cost_usd").alias("total_usd"))
    return results.select("doc_id", F.to_json(F.struct("status", cost.alias("cost"), verify.alias("verify"), "figures", "error")).alias("payload"))
