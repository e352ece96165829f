"""Tables: grids, coverage by token overlap, running headers, width checks, column profiles and page tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Sizes, shares and widths of the rules (fixed values).
OVERSIZE_COLUMNS, OVERSIZE_CELLS, COVERAGE_MIN, THIN, DIAGNOSED_TOKENS = 45, 2500, 0.85, 0.7, 12
CELL_PADDING, WIDTH_FLOOR, LENGTH_BONUS = 3, 3.0, 0.3
TIERS = ((75, "portrait"), (110, "a4-landscape"), (125, "a3-landscape"), (165, "a3-xl"))
LARGEST_TIER = "a3-xxl"


def is_oversized(grid: Column) -> Column:
    """45 columns or 2,500 cells; the columns are those of the widest row."""
    columns = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
    return (columns >= OVERSIZE_COLUMNS) | (F.size(grid) * columns >= OVERSIZE_CELLS)


def best_match(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, table_no, n_tokens, hits, match: the output table of the same document that holds most of
    the source table's distinct tokens; the first of equals, null without a common token.

    sources, outputs: doc_id, table_no, text.  Through an equi-join on tokens.
    """
    bag = lambda df, name: df.select("doc_id", F.col("table_no").alias(name), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    wanted, held = bag(sources, "table_no"), bag(outputs, "match")
    hits = wanted.join(held, ["doc_id", "token"]).groupBy("doc_id", "table_no", "match").agg(F.count("*").alias("hits"))
    best = hits.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy(F.desc("hits"), "match"))).where("rn = 1").drop("rn")
    sizes = wanted.groupBy("doc_id", "table_no").agg(F.count("*").alias("n_tokens"))
    return sizes.join(best, ["doc_id", "table_no"], "left").select("doc_id", "table_no", "n_tokens", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "match")


def weighted_coverage(matches: DataFrame) -> DataFrame:
    """doc_id, hits, n_tokens, coverage, status, thin: summed over the document's tables."""
    thin = (F.col("n_tokens") >= DIAGNOSED_TOKENS) & (F.col("hits") < THIN * F.col("n_tokens"))
    sums = matches.groupBy("doc_id").agg(F.sum("hits").alias("hits"), F.sum("n_tokens").alias("n_tokens"), F.count_if(thin).alias("thin"))
    coverage = F.col("hits") / F.col("n_tokens")
    return sums.select("doc_id", "hits", "n_tokens", coverage.alias("coverage"), F.when(coverage < COVERAGE_MIN, "warn").otherwise("ok").alias("status"), "thin")


def running_headers(grids: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n: tables whose first two filled cells recur on half of the pages, three times at least.

    grids: doc_id, table_no, cells (array of text); pages: doc_id, total_pages.
    """
    filled = F.filter(F.transform("cells", T.normalize), lambda c: c != "")
    prints = grids.select("doc_id", F.array_join(F.slice(filled, 1, 2), " ").alias("fingerprint")).where("fingerprint <> ''")
    counts = prints.groupBy("doc_id", "fingerprint").agg(F.count("*").alias("n")).join(pages, "doc_id")
    return counts.where(F.col("n") >= F.greatest(F.lit(3.0), 0.5 * F.col("total_pages"))).select("doc_id", "fingerprint", "n")


def header_bleed(tables: DataFrame, share: float = 0.7) -> DataFrame:
    """doc_id, gram, n_tables: two- and three-word runs of 8 characters that most of a document's tables hold; three tables at least."""
    words = T.tokens(F.col("text"))
    runs = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    grams = T.let(words, lambda w: F.array_distinct(F.concat(runs(w, 2), runs(w, 3))))
    totals = tables.groupBy("doc_id").agg(F.count("*").alias("total")).where("total >= 3")
    counts = tables.select("doc_id", F.explode(grams).alias("gram")).where(F.length("gram") >= 8).groupBy("doc_id", "gram").agg(F.count("*").alias("n_tables"))
    return counts.join(totals, "doc_id").where(F.col("n_tables") >= F.greatest(F.lit(3), F.floor(share * F.col("total")))).select("doc_id", "gram", "n_tables")


def row_width(row: Column) -> Column:
    """Cells of a row's HTML, each as wide as its colspan."""
    cells = F.regexp_extract_all(row, F.lit(r"(?i)<t[dh]\b([^>]*)>"), F.lit(1))
    span = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)colspan\s*=\s*[\"']?(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return F.aggregate(F.transform(cells, span), F.lit(0), lambda a, x: a + x)


def width_consistency(tables: DataFrame, key: str = "table_id", html: str = "html") -> DataFrame:
    """key, header_width, data_width, uniform, columns, consistent: whether header and rows agree to one column.

    Only uniform data can be inconsistent: rows that span others are left alone.  The
    data width is the commonest, the first seen of equals.
    """
    rows_of = lambda part: F.filter(F.regexp_extract_all(part, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), lambda r: T.strip(r) != "")
    section = lambda name: F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    has_head = F.col(html).rlike(r"(?is)<thead\b[^>]*>.*?</thead\s*>")
    every = rows_of(F.col(html))
    cut = tables.select(
        key,
        F.when(has_head, rows_of(section("thead"))).otherwise(F.slice(every, 1, 1)).alias("head"),
        F.when(has_head, rows_of(section("tbody"))).otherwise(F.slice(every, 2, 1 << 20)).alias("body"),
        F.regexp_count(html, F.lit(r"(?i)<col\b")).alias("columns"),
    )
    widths = cut.select(key, "columns", F.transform("head", row_width).alias("head"), F.transform("body", row_width).alias("body"))
    times = lambda w: F.size(F.filter("body", lambda x: x == w))
    commonest = F.array_max(F.transform("body", lambda w, i: F.struct(times(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    told = widths.select(key, "columns", F.coalesce(F.array_max("head"), F.lit(0)).alias("header_width"), F.coalesce(commonest, F.lit(0)).alias("data_width"), (F.size(F.array_distinct("body")) == 1).alias("uniform"))
    off = lambda c: F.abs(F.col(c) - F.col("data_width")) > 1
    broken = F.col("uniform") & (F.col("header_width") > 0) & (off("header_width") | ((F.col("columns") > 0) & off("columns")))
    return told.select(key, "header_width", "data_width", "uniform", "columns", (~broken).alias("consistent"))


def pipe_profile(tables: DataFrame, key: str = "table_id", text: str = "text") -> DataFrame:
    """key, column_no, max_length, max_token of a pipe table's columns; divider rows don't count."""
    rows = tables.select(key, F.explode(F.split(text, "\n")).alias("row")).where(F.col("row").rlike(r"^\s*\|") & ~F.col("row").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace("row", r"^\s*\||\|\s*$", "")
    cells = rows.select(key, F.posexplode(F.split(inner, r"\|")).alias("column_no", "cell")).withColumn("cell", T.strip(F.col("cell")))
    return cells.groupBy(key, "column_no").agg(F.max(F.length("cell")).alias("max_length"), F.max(T.longest_word(F.col("cell"))).alias("max_token"))


def page_tiers(profile: DataFrame, key: str = "table_id") -> DataFrame:
    """key, width, tier: the narrowest page that the longest words of all columns fit."""
    sums = profile.groupBy(key).agg((F.sum("max_token") + F.count("*")).alias("width"))
    tier = F.lit(LARGEST_TIER)
    for most, name in reversed(TIERS):
        tier = F.when(F.col("width") <= most, name).otherwise(tier)
    return sums.select(key, "width", tier.alias("tier"))


def column_widths(profile: DataFrame, key: str = "table_id") -> DataFrame:
    """key, column_no, percent: by longest word and, less, by length; no column under three percent before the last scaling."""
    token = F.greatest(F.lit(1), "max_token")
    weight = token + CELL_PADDING + LENGTH_BONUS * F.least(F.greatest(F.lit(1), "max_length"), 3 * token)
    w = Window.partitionBy(key)
    first = profile.withColumn("weight", weight).withColumn("share", F.greatest(F.lit(WIDTH_FLOOR), F.col("weight") * 100.0 / F.sum("weight").over(w)))
    return first.select(key, "column_no", (F.col("share") * 100.0 / F.sum("share").over(w)).alias("percent"))
