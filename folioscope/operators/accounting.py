"""Costs of a batch: calibration, estimates, budgets, status roll-ups and error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seed rates in USD, the estimate's band and the exchange rate (fixed values).
SEED_COVER, SEED_DETECT, SEED_CONVERT = 0.005, 0.015, 0.035
BAND_LOW, BAND_HIGH, USD_TO_EUR = 0.5, 3.0, 0.92
#: Words of service messages by error class (fixed values).
QUOTA = ("quota", "rate limit", "rate_limit", "too many requests")
#: The code as a number of its own that counts no seconds.
QUOTA_CODE = r"(?<!\d|\d[.,])429(?![.,]?\d|\s*s(?:ec(?:onds?)?)?\b)"
TRANSIENT, TRANSIENT_CODES = ("overloaded", "unavailable", "bad gateway", "service unavailable"), (502, 503, 529)
CONTEXT = ("maximum context", "too many tokens", "context length", "context window")
TOO_LARGE = ("payload too large", "request too large", "request entity too large")
CREDITS = ("insufficient credits", "purchased credits", "purchase more", "negative credit")


def calibration(history: DataFrame) -> DataFrame:
    """One row: rates by ratio of sums over past documents, seeds where there are none.

    history: pages_total, pages_candidate, detect_usd, convert_usd (one row a document).
    """
    detect = F.try_divide(F.sum(F.when(F.col("pages_candidate") > 0, F.col("detect_usd"))), F.sum(F.when(F.col("pages_candidate") > 0, F.col("pages_candidate"))))
    convert = F.try_divide(F.sum(F.when(F.col("pages_total") > 0, F.col("convert_usd"))), F.sum(F.when(F.col("pages_total") > 0, F.col("pages_total"))))
    return history.agg(
        F.lit(SEED_COVER).alias("cover_usd"), F.coalesce(detect, F.lit(SEED_DETECT)).alias("detect_usd_per_candidate"), F.coalesce(convert, F.lit(SEED_CONVERT)).alias("convert_usd_per_page"), F.count("*").alias("n_docs"),
    )


def estimates(jobs: DataFrame, rates: DataFrame) -> DataFrame:
    """doc_id, expected_usd, low_usd, high_usd of each job (pages, candidate_pages); the rates are one row."""
    fixed = F.col("cover_usd") + F.col("candidate_pages") * F.col("detect_usd_per_candidate")
    convert = F.col("pages") * F.col("convert_usd_per_page")
    # one row by contract: a second one is an error, not a second price
    one = rates.agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("cover_usd", "detect_usd_per_candidate", "convert_usd_per_page")])
    one = one.where(F.when(F.col("rows") == 1, True).otherwise(F.raise_error(F.lit("rates must be one row")).cast("boolean")))
    priced = jobs.join(F.broadcast(one), F.lit(True))
    return priced.select("doc_id", (fixed + convert).alias("expected_usd"), (fixed + BAND_LOW * convert).alias("low_usd"), (fixed + BAND_HIGH * convert).alias("high_usd"))


def gated(estimated: DataFrame, limit: float | None, override: bool = False) -> DataFrame:
    """Adds decision: run, or skip where the expected cost is over the limit for one document."""
    over = F.lit(limit is not None and not override) & (F.col("expected_usd") > F.lit(float(limit or 0)))
    return estimated.withColumn("decision", F.when(over, "skip").otherwise("run"))


def backstop(ledger: DataFrame, batch: list[str], order: list[str], total: float) -> DataFrame:
    """Adds spent_before and decision to each batch's jobs in order: from the first whose estimate would
    pass the total on top of what was spent before it, all are skipped.

    ledger: expected_usd and actual_usd.  A batch is one window partition: it is a run of jobs in order.
    """
    w = Window.partitionBy(*batch).orderBy(*order)
    spent = F.coalesce(F.sum("actual_usd").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    told = ledger.withColumn("spent_before", spent).withColumn("breach", (F.col("spent_before") + F.col("expected_usd") > total).cast("int"))
    stopped = F.max("breach").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1
    return told.withColumn("decision", F.when(stopped, "skip").otherwise("run")).drop("breach")


def worst_status(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status: fail over warn over ok; skipped counts as ok."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return checks.groupBy(key).agg(F.get(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.max(rank)).alias("status"))


def remaining(jobs: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Jobs without a result; all of them if forced."""
    return jobs if force else jobs.join(results.select("doc_id"), "doc_id", "left_anti")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def error_class(status: Column, message: Column) -> Column:
    """credits, too_large, context_overflow, quota, transient or other, the first that fits."""
    low, code = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(status, F.lit(0))
    return (
        F.when((code == 402) | _any(low, CREDITS), "credits")
        .when((code == 413) | _any(low, TOO_LARGE), "too_large")
        .when(_any(low, CONTEXT), "context_overflow")
        .when(_any(low, QUOTA) | low.rlike(QUOTA_CODE), "quota")
        .when(code.isin(*TRANSIENT_CODES) | _any(low, TRANSIENT), "transient")
        .otherwise("other")
    )


def eur(usd: Column, rate: float = USD_TO_EUR) -> Column:
    return F.round(F.coalesce(usd, F.lit(0.0)) * rate, 4)


def format_eur(usd: Column, rate: float = USD_TO_EUR) -> Column:
    return F.when(usd.isNotNull(), F.concat(F.lit("€"), F.format_string("%.2f", eur(usd, rate))))


def usage_cost(usage: Column) -> Column:
    """The cost in a service's usage object (JSON text), 0 where there is none or it isn't a number."""
    cost = F.try_variant_get(F.try_parse_json(usage), "$.cost", "variant")
    number = F.schema_of_variant(cost).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)")
    return F.coalesce(F.when(number, F.try_variant_get(F.try_parse_json(usage), "$.cost", "double")), F.lit(0.0))


def cost_rollup(usage: DataFrame, *keys: str) -> DataFrame:
    """Sums of cost_usd by every prefix of ``keys`` (null: all)."""
    return usage.rollup(*keys).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))


def usd(amount_eur: Column) -> Column:
    """EUR as USD; null (no limit) stays null."""
    return amount_eur / USD_TO_EUR


def retry_delay(message: Column, default: float = 60.0) -> Column:
    """Seconds to wait that a service's message tells: after ``retry after`` or ``retry in``, else before ``s``, else ``default``."""
    told = F.regexp_extract(message, r"(?i)retry[_\s]+(?:after|in)[:\s]+(\d+(?:\.\d+)?)", 1)
    other = F.regexp_extract(message, r"(?i)(\d+(?:\.\d+)?)\s*s(?:ec(?:onds?)?)?", 1)
    return F.coalesce(F.nullif(told, F.lit("")).try_cast("double"), F.nullif(other, F.lit("")).try_cast("double"), F.lit(default))
