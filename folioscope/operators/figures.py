"""Figure references against detected figures, positional zips, and the heading outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import longest_increasing
from .similar import similar_pairs

#: The token of a figure, the shortest contained title and the least similarity (fixed values).
TOKEN, CONTAINED, SIMILAR = r"\bFIG_\d+\b", 6, 0.85


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def token_report(outputs: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, fig_id, state: resolved, hallucinated (no such figure) or unreferenced.

    outputs: doc_id, text; figures: doc_id, fig_id, file.  Comments don't count.
    """
    tokens = outputs.select("doc_id", F.explode(F.regexp_extract_all(without_comments(F.col("text")), F.lit(TOKEN), F.lit(0))).alias("fig_id")).distinct()
    known = figures.where("fig_id is not null and file is not null").select("doc_id", "fig_id", F.lit(True).alias("known")).distinct()
    state = F.when(F.col("known").isNull(), "hallucinated").when(F.col("used").isNull(), "unreferenced").otherwise("resolved")
    return tokens.withColumn("used", F.lit(True)).join(known, ["doc_id", "fig_id"], "full_outer").select("doc_id", "fig_id", state.alias("state"))


def invisible(outputs: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures of which neither the token nor the file stands in the document's output, comments aside."""
    text = without_comments(F.col("text"))
    seen = F.concat(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.regexp_extract_all(text, F.lit(r"([\w.-]+\.(?:png|jpe?g|svg|gif|webp))"), F.lit(1)))
    names = outputs.select("doc_id", F.explode(seen).alias("name")).distinct()
    by_id = figures.join(names.withColumnRenamed("name", "fig_id"), ["doc_id", "fig_id"], "left_anti")
    base = by_id.withColumn("name", F.substring_index("file", "/", -1))
    return base.join(names, ["doc_id", "name"], "left_anti").select(*figures.columns)


def by_page(pages: DataFrame, figures: DataFrame) -> DataFrame:
    counts = figures.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    return pages.select("doc_id", "page_no").join(counts, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("n", F.lit(0).cast("long")).alias("n_figures"))


def zipped(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str], key: str = "doc_id") -> DataFrame:
    """The i-th row of the one beside the i-th of the other, within a document; what has no partner stays."""
    numbered = lambda df, order: df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered(left, order_left).join(numbered(right, order_right), [key, "position"], "full_outer")


def caption_zip(blocks: DataFrame) -> DataFrame:
    """doc_id, caption_no, table_no: runs of N captions followed by exactly N tables, paired in order; other runs not at all.

    blocks: doc_id, seq, kind ('caption', 'table' or other).
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    turns = blocks.withColumn("run", F.sum((F.lag("kind", 1, "").over(w) != F.col("kind")).cast("int")).over(w))
    runs = turns.groupBy("doc_id", "run", "kind").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    order = Window.partitionBy("doc_id").orderBy("run")
    paired = runs.withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_n", F.lead("n").over(order)).withColumn("next_first", F.lead("first").over(order))
    fires = paired.where("kind = 'caption' and next_kind = 'table' and n = next_n and n > 1")
    return fires.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), "first", "next_first").select("doc_id", (F.col("first") + F.col("i")).alias("caption_no"), (F.col("next_first") + F.col("i")).alias("table_no"))


def captions_of(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, owner: for each ': caption' line the table or image line next to it over blank lines, the one above first."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    filled = lines.where(F.trim("line") != "")
    kind = F.when(F.ltrim("line").startswith("|"), "table").when(F.ltrim("line").startswith("!["), "image").when(F.col("line").rlike(r"^:\s+\S"), "caption").otherwise("text")
    told = filled.withColumn("kind", kind)
    near = told.withColumn("above", F.lag("kind").over(w)).withColumn("below", F.lead("kind").over(w))
    for side in ("above", "below"):
        near = near.withColumn(side, F.when(F.col(side).isin("table", "image"), F.col(side)))
    return near.where("kind = 'caption'").select("doc_id", "line_no", F.coalesce("above", "below", F.lit("none")).alias("owner"))


def heading_matches(titles: DataFrame, headings: DataFrame, by_ratio: bool = True) -> DataFrame:
    """doc_id, title_no, heading_no: the first heading of the document that is like the title; null where there is none.

    titles: doc_id, title_no, title_key; headings: doc_id, heading_no, heading_key (normalised, without
    numbers).  Equal, contained (six characters at least) or of a high ratio.  Only different texts of a
    document meet, each text once, and a contained one meets where the rarest piece of it stands;
    ``similar_pairs`` finds those of a high ratio.
    """
    asked = titles.where("title_key <> ''").select("doc_id", "title_key").distinct()
    heads = headings.where("heading_key <> ''").groupBy("doc_id", "heading_key").agg(F.min("heading_no").alias("heading_no"))
    keyed = lambda df, c: df.select("doc_id", F.col(c).alias("text")).distinct()
    a, b = keyed(asked, "title_key"), keyed(heads, "heading_key")
    named = lambda df, left, right: df.select("doc_id", F.col(left).alias("title_key"), F.col(right).alias("heading_key"))
    alike = asked.join(b, (asked.doc_id == b.doc_id) & (asked.title_key == b.text)).select(asked.doc_id, "title_key", F.col("text").alias("heading_key"))
    alike = alike.unionByName(named(_contained(a, b), "short", "long")).unionByName(named(_contained(b, a), "long", "short"))
    if by_ratio:
        alike = alike.unionByName(named(similar_pairs(a, b, SIMILAR, ["doc_id"]), "left", "right"))
    found = alike.join(heads, ["doc_id", "heading_key"]).groupBy("doc_id", "title_key").agg(F.min("heading_no").alias("heading_no"))
    found = titles.join(found, ["doc_id", "title_key"]).groupBy("doc_id", "title_no").agg(F.min("heading_no").alias("heading_no"))
    return titles.select("doc_id", "title_no").join(found, ["doc_id", "title_no"], "left")


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """doc_id, short, long: texts (doc_id, text; distinct) of ``CONTAINED`` characters or more that stand in another text of their document."""
    places = F.sequence(F.lit(1), F.length("text") - (CONTAINED - 1))
    pieces = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("text"), i, F.lit(CONTAINED))))
    cut = lambda df, name: df.where(F.length("text") >= CONTAINED).select("doc_id", F.col("text").alias(name), F.explode(pieces).alias("piece"))
    index = cut(long, "long")
    times = index.groupBy("doc_id", "piece").agg(F.count("*").alias("n"))
    rarest = cut(short, "short").join(times, ["doc_id", "piece"]).groupBy("doc_id", "short").agg(F.min(F.struct("n", "piece")).alias("rare"))
    asked = rarest.select(F.col("doc_id").alias("of"), "short", F.col("rare.piece").alias("rare"))
    return index.join(asked, (F.col("doc_id") == F.col("of")) & (F.col("piece") == F.col("rare")) & F.contains("long", "short")).select("doc_id", "short", "long")


def outline_stats(matches: DataFrame) -> DataFrame:
    """doc_id, titles, missing, reordered: titles without a heading, and those out of order among the matched."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("heading_no").isNotNull(), F.struct("title_no", "heading_no")))), lambda s: s["heading_no"].cast("int"))
    sums = matches.groupBy("doc_id").agg(F.count("*").alias("titles"), F.count_if(F.col("heading_no").isNull()).alias("missing"), ordered.alias("order"))
    return sums.select("doc_id", "titles", "missing", (F.size("order") - longest_increasing(F.col("order"))).alias("reordered"))
