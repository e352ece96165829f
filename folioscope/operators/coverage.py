"""How much of a source text survives in an output text.

Everything is keyed by document and goes through equi-joins on shingles or tokens;
no pair of whole texts is ever compared.  A shingle of boilerplate that most
documents share is a hot join key; only distinct (document, shingle) rows meet it,
the source side is broadcast only if the planner's size limit allows, and adaptive
execution splits it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .store import stored

#: Values of the check (fixed values).
MIN_TOKENS, SHORT_TOKENS, SHINGLE_HIT, CONTAIN_HIT, WINDOW_SLACK = 5, 7, 0.5, 0.8, 5
#: Places of a text that are one block of the positional index.
BLOCK = 16
#: Sentences of a document that are looked up together.
GROUP = 16
RECOVERY = r"(?s)<!-- (?:repair|postfix): missing-text (?:recovery|rescue) -->.*"


def shingle_rows(df: DataFrame, key: str, text: str, name: str = "shingle") -> DataFrame:
    """Distinct shingles of each row, as hashes: (key, shingle)."""
    return df.select(key, F.explode(T.shingle_hashes(T.tokens(F.col(text)))).alias(name))


def containment(items: DataFrame, docs: DataFrame, least: float = SHINGLE_HIT) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds the share ``least`` of the item's shingles.

    items: item_id, text; docs: doc_id, text.  Rows: doc_id, item_id, hits, shingles.  Hashes of
    shingles find the pairs; those that have enough are counted again on the shingles themselves.
    Null texts and texts without words hold nothing and are held by none; equal rows give equal rows.
    """
    known = items.select("item_id", "text").distinct()
    wanted = shingle_rows(known, "item_id", "text")
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("least"))
    met = shingle_rows(docs, "doc_id", "text").join(wanted, "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("met"))
    met = met.join(sizes, "item_id").where(F.col("met") >= F.lit(least) * F.col("least")).select("doc_id", "item_id")
    of = lambda name: T.shingles(T.tokens(F.col("text"))).alias(name)
    met = stored(met, "containment")
    held = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", of("held"))
    pairs = met.join(held, "doc_id").join(known.select("item_id", of("asked")), "item_id")
    hits = pairs.select("doc_id", "item_id", F.size(F.array_intersect("held", "asked")).cast("long").alias("hits"), F.size("asked").cast("long").alias("shingles"))
    return hits.where((F.col("shingles") > 0) & (F.col("hits") >= F.lit(least) * F.col("shingles")))


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_TOKENS) -> DataFrame:
    """(key, sentence_no, sentence, normal, n_tokens) of the sentences worth checking."""
    cut = docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence_no", "sentence"))
    normal = cut.withColumn("normal", T.normalize(F.col("sentence"))).withColumn("n_tokens", T.token_count(F.col("normal")))
    return normal.where(F.col("n_tokens") >= least)


def short_covered(needle: Column, output: Column) -> Column:
    """Whether most of a short line's tokens stand together in the output.

    Windows are drawn around every place of any of its rarest tokens: where several
    tokens are equally rare, one of them is enough.
    """

    def of(need: Column, found: Column, window: Column) -> Column:
        # one pass over the output; what follows sees the places of the needle's tokens alone
        places = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found))).otherwise(F.array().cast("array<int>"))
        at = F.filter(places, lambda i: F.array_contains(need, F.element_at(found, i)))
        return T.let(at, lambda a: around(need, found, window, a))

    def around(need: Column, found: Column, window: Column, at: Column) -> Column:
        words = F.transform(at, lambda i: F.element_at(found, i))
        times = T.let(words, lambda w: F.transform(need, lambda t: F.size(F.filter(w, lambda o: o == t))))
        rare = T.let(times, lambda n: F.filter(need, lambda t, i: F.element_at(n, i + 1) == F.array_min(n)))
        places = T.let(rare, lambda r: F.filter(at, lambda i: F.array_contains(r, F.element_at(found, i))))

        def near(p: Column) -> Column:
            low = F.greatest(F.lit(1), p - window)
            return F.size(F.array_intersect(need, F.slice(found, low, p + window - low + 1))) >= CONTAIN_HIT * F.size(need)

        return F.when(F.size(need) == 0, True).when(F.size(found) == 0, False).otherwise(F.exists(places, near))

    bound = F.struct(F.array_distinct(needle).alias("need"), output.alias("found"), (F.size(needle) + WINDOW_SLACK).alias("window"))
    return T.let(bound, lambda s: of(s["need"], s["found"], s["window"]))


def short_lines_anywhere(needles: DataFrame, outputs: DataFrame) -> DataFrame:
    """(needle_id, doc_id) of the short lines that an output covers, by the rule of ``short_covered``, each against every output.

    needles: needle_id (unique), tokens; outputs: doc_id (unique), output (tokens).  A positional index
    holds the places of the needles' words alone.  A needle is looked up by its rarest word of all
    outputs; outputs that lack any of its words are out; then the places of the words that are
    rarest in that very output are anchors, and what stands near them is found by blocks of places.
    Needles without words are covered nowhere here, nor is anything by outputs without words.
    """
    asked = needles.select("needle_id", F.size("tokens").alias("n"), F.array_distinct("tokens").alias("need"))
    asked = asked.select("needle_id", (F.col("n") + WINDOW_SLACK).alias("window"), F.size("need").alias("needed"), F.explode("need").alias("token"))
    index = outputs.select("doc_id", F.posexplode("output").alias("place", "token")).join(asked.select("token").distinct(), "token", "left_semi")
    index = stored(index, "short-index")
    times = stored(index.groupBy("doc_id", "token").agg(F.count("*").alias("times")), "short-times")
    spread = times.groupBy("token").agg(F.count("*").alias("docs"))
    # a word that no output has rules its needle out
    rarest = asked.join(spread, "token", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "token")).alias("rare")).where("rare.docs > 0")
    near = rarest.select("needle_id", F.col("rare.token").alias("token")).join(times.select("doc_id", "token"), "token").select("needle_id", "doc_id")
    words = near.join(asked, "needle_id").join(times, ["doc_id", "token"])
    whole = words.groupBy("needle_id", "doc_id").agg(F.count("*").alias("n"), F.min("times").alias("least"), F.first("needed").alias("needed")).where("n = needed")
    anchors = words.join(whole.select("needle_id", "doc_id", "least"), ["needle_id", "doc_id"]).where("times = least")
    anchors = anchors.join(index, ["doc_id", "token"]).select("needle_id", "doc_id", "needed", "window", F.col("place").alias("at"))
    block = lambda c: F.floor(c / BLOCK).cast("int")
    around = anchors.withColumn("block", F.explode(F.sequence(block(F.col("at") - F.col("window")), block(F.col("at") + F.col("window")))))
    blocks = index.withColumn("block", block(F.col("place")))
    met = around.join(blocks, ["doc_id", "block"]).where(F.abs(F.col("place") - F.col("at")) <= F.col("window"))
    met = met.join(asked.select("needle_id", "token"), ["needle_id", "token"])
    counted = met.groupBy("needle_id", "doc_id", "at", "needed").agg(F.countDistinct("token").alias("n"))
    return counted.where(F.col("n") >= CONTAIN_HIT * F.col("needed")).select("needle_id", "doc_id").distinct()


def sentence_coverage(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """For each checked sentence of a document, whether the document's output covers it.

    sources: doc_id, text; outputs: doc_id, text (markup); a doc_id stands once in each.  A document
    without output, or with a null one, covers nothing; null sources have no sentences.  Rows:
    doc_id, sentence_no, sentence, n_tokens, covered.  Only the two texts of a document are shuffled, once;
    sentences are looked up in groups: what a group has in common with the output is a small array
    that each of its sentences is compared with.
    """
    # dealt out by document whatever the size: what follows is far more work than the join
    markup = outputs.select("doc_id", F.col("text").alias("markup")).hint("merge")
    met = sources.select("doc_id", F.col("text").alias("source")).join(markup, "doc_id", "left")
    plain = T.tokens(T.plain_text(F.regexp_replace(F.coalesce("markup", F.lit("")), RECOVERY, "")))
    cut = F.transform(T.sentences(F.col("source")), lambda s, i: F.struct(i.alias("sentence_no"), s.alias("sentence"), T.tokens(s).alias("need")))
    cut = met.select("doc_id", F.filter(cut, lambda s: F.size(s["need"]) >= MIN_TOKENS).alias("cut"), plain.alias("output")).where("size(cut) > 0")
    long = lambda s: F.size(s["need"]) > SHORT_TOKENS
    hashed = F.transform("cut", lambda s: s.withField("hashes", F.when(long(s), T.shingle_hashes(s["need"])).otherwise(F.array().cast("array<long>"))))
    told = cut.select("doc_id", hashed.alias("cut"), "output", T.shingle_hashes(F.col("output")).alias("held"))

    def covered(s: Column, hits: Column) -> Column:
        words = F.array_distinct(s["need"])
        there = F.size(F.array_intersect(s["need"], hits["words"])) == F.size(words)
        short = F.when(there, short_covered(s["need"], F.col("output"))).otherwise(False)
        return F.when(long(s), F.size(F.array_intersect(s["hashes"], hits["held"])) >= SHINGLE_HIT * F.size(s["hashes"])).otherwise(short)

    def grouped(group: Column) -> Column:
        asked = F.flatten(F.transform(F.filter(group, lambda s: ~long(s)), lambda s: s["need"]))
        held = F.array_intersect(F.flatten(F.transform(group, lambda s: s["hashes"])), F.col("held"))
        # most groups have no short line
        hits = F.struct(held.alias("held"), T.let(asked, lambda a: F.when(F.size(a) > 0, F.array_intersect(a, F.col("output"))).otherwise(a)).alias("words"))
        return T.let(hits, lambda h: F.transform(group, lambda s: F.struct(s["sentence_no"].alias("sentence_no"), s["sentence"].alias("sentence"), F.size(s["need"]).alias("n_tokens"), covered(s, h).alias("covered"))))

    firsts = F.sequence(F.lit(1), F.size("cut"), F.lit(GROUP))
    return told.select("doc_id", F.inline(F.flatten(F.transform(firsts, lambda i: T.let(F.slice("cut", i, F.lit(GROUP)), grouped)))))


def coverage_summary(sentences: DataFrame) -> DataFrame:
    """doc_id, total, covered, missing, percent, status; a document without sentences is fully covered and absent here."""
    counted = sentences.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"))
    return counted.select(
        "doc_id", "total", "covered", (F.col("total") - F.col("covered")).alias("missing"), (100.0 * F.col("covered") / F.col("total")).alias("percent"),
        F.when(F.col("covered") == F.col("total"), "ok").otherwise("warn").alias("status"),
    )


def worst(counts: DataFrame, by: str, order: list[str], top: int = 5) -> DataFrame:
    """The ``top`` rows of largest ``by``; ties by ``order``."""
    return counts.orderBy(F.desc(by), *order).limit(top)


def listed_findings(findings: DataFrame, key: str, order: str, message: str, most: int) -> DataFrame:
    """The first ``most`` messages of each key and how many more there are: a report's list."""
    ranked = findings.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    kept = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.col(message).alias("message")))))
    return ranked.groupBy(key).agg(F.transform(kept, lambda s: s["message"]).alias("messages"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
