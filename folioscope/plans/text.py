"""Queries on text and coverage, over the tables ``documents``, ``pages`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chrome, coverage, verify
from .registry import Inline, query, spread, table

#: The other engine's way to normalise ``{x}``.
NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g'), '-\s*\n\s*', '', 'g')), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace({x}, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
TOKENS = "CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END"
SHINGLES = "CASE WHEN len({t}) >= 4 THEN list_distinct([array_to_string({t}[i:i+3], ' ') FOR i IN range(1, len({t}) - 2)]) WHEN len({t}) > 0 THEN [array_to_string({t}, ' ')] ELSE []::VARCHAR[] END"


def documents(spark, sf_dir, *columns):
    """The columns of ``documents``, dealt to all cores."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def norm(x: str) -> str:
    return NORM.format(x=x)


@query("norm_text", f"SELECT doc_id, {norm('text')} AS normal FROM documents")
def norm_text(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("normal"))


@query("token_counts", f"WITH n AS (SELECT doc_id, {norm('text')} AS n FROM documents) SELECT doc_id, len({TOKENS.format(n='n')})::BIGINT AS n_tokens FROM n")
def token_counts(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("normal"))
    return docs.select("doc_id", T.token_count(F.col("normal")).cast("long").alias("n_tokens"))


@query("sentence_split", f"WITH s AS (SELECT doc_id, {SENTENCES.format(x='text')} AS s FROM documents) SELECT doc_id, (i - 1)::BIGINT AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).select("doc_id", F.col("n").cast("long").alias("sentence_no"), "sentence")


@query(
    "sentence_min_tokens",
    f"WITH s AS (SELECT doc_id, unnest({SENTENCES.format(x='text')}) AS s FROM documents), n AS (SELECT doc_id, {norm('s')} AS n FROM s), "
    f"t AS (SELECT doc_id, len({TOKENS.format(n='n')}) AS k FROM n) SELECT doc_id, count(*) AS sentences, count(*) FILTER (k >= 5) AS checked, coalesce(sum(k) FILTER (k >= 5), 0)::BIGINT AS checked_tokens FROM t GROUP BY doc_id",
)
def sentence_min_tokens(spark, sf_dir):
    rows = coverage.sentence_rows(documents(spark, sf_dir, "doc_id", "text"), least=0)
    checked = F.col("n_tokens") >= coverage.MIN_TOKENS
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(checked).alias("checked"), F.sum(F.when(checked, F.col("n_tokens")).otherwise(0).cast("long")).alias("checked_tokens"))


@query(
    "shingle_counts",
    f"WITH n AS (SELECT doc_id, {norm('text')} AS n FROM documents), t AS (SELECT doc_id, {TOKENS.format(n='n')} AS t FROM n) SELECT doc_id, len({SHINGLES.format(t='t')})::BIGINT AS n_shingles FROM t",
)
def shingle_counts(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.size(T.shingle_hashes(T.tokens(F.col("text")))).cast("long").alias("n_shingles"))


LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(
    "line_signature",
    rf"WITH l AS ({LINES}), s AS (SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents(line), '[^\x00-\x7F]', '', 'g')), '[^a-z]+', '', 'g') AS sig FROM l) "
    "SELECT sig, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM s WHERE sig <> '' GROUP BY sig",
)
def line_signature(spark, sf_dir):
    lines = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", T.signature(F.col("line")).alias("sig")).where("sig <> ''").groupBy("sig").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def plain_sql(x: str) -> str:
    """The other engine's way to strip markup."""
    for pattern, to in T.PLAIN_STEPS:
        options = "g"
        p = pattern.replace("(?md)", "(?m)")
        to = to.replace("$1", r"\1")
        x = f"regexp_replace({x}, '{p}', '{to}', '{options}')"
    return x


@query("plain_from_html", f"SELECT page_id, {plain_sql('html')} AS plain FROM pages")
def plain_from_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.plain_text(F.col("html")).alias("plain"))


SHINGLE_COVERAGE = f"""
    WITH di AS (SELECT item_id, {norm('text')} AS n FROM benchmark), dt AS (SELECT item_id, {TOKENS.format(n='n')} AS t FROM di),
    items AS (SELECT item_id, {SHINGLES.format(t='t')} AS s FROM dt), item_rows AS (SELECT item_id, unnest(s) AS shingle FROM items),
    dn AS (SELECT doc_id, {norm('text')} AS n FROM documents), tt AS (SELECT doc_id, {TOKENS.format(n='n')} AS t FROM dn),
    doc_rows AS (SELECT doc_id, unnest({SHINGLES.format(t='t')}) AS shingle FROM tt),
    hits AS (SELECT doc_id, item_id, count(*) AS hits FROM doc_rows JOIN item_rows USING (shingle) GROUP BY ALL)
    SELECT doc_id, item_id, hits, len(s)::BIGINT AS shingles FROM hits JOIN items USING (item_id) WHERE hits >= 0.5 * len(s)"""


@query("shingle_coverage", SHINGLE_COVERAGE)
def shingle_coverage(spark, sf_dir):
    return coverage.containment(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir, "doc_id", "text"))


@query(
    "sentence_coverage",
    f"""
    WITH si AS (SELECT item_id, unnest({SENTENCES.format(x='text')}) AS sentence FROM benchmark),
    sn AS (SELECT row_number() OVER () AS k, item_id, sentence, {norm('sentence')} AS n FROM si), st AS (SELECT k, item_id, sentence, {TOKENS.format(n='n')} AS t FROM sn),
    items AS (SELECT k, item_id, sentence, {SHINGLES.format(t='t')} AS s FROM st WHERE len(t) > 7), item_rows AS (SELECT k, unnest(s) AS shingle FROM items),
    dn AS (SELECT doc_id, {norm('text')} AS n FROM documents), tt AS (SELECT doc_id, {TOKENS.format(n='n')} AS t FROM dn),
    doc_rows AS (SELECT doc_id, unnest({SHINGLES.format(t='t')}) AS shingle FROM tt),
    hits AS (SELECT doc_id, k, count(*) AS hits FROM doc_rows JOIN item_rows USING (shingle) GROUP BY ALL),
    held AS (SELECT k, count(*) AS n_docs FROM hits JOIN items USING (k) WHERE hits >= 0.5 * len(s) GROUP BY k)
    SELECT item_id, sentence, len(s)::BIGINT AS shingles, coalesce(n_docs, 0) AS n_docs FROM items LEFT JOIN held USING (k)""",
)
def sentence_coverage(spark, sf_dir):
    """For each sentence of a benchmark item, how many documents cover it."""
    rows = coverage.sentence_rows(table(spark, sf_dir, "benchmark"), key="item_id").where(F.col("n_tokens") > coverage.SHORT_TOKENS)
    wanted = rows.select(F.struct("item_id", "sentence_no").alias("item_id"), F.col("sentence").alias("text"))
    held = coverage.containment(wanted, documents(spark, sf_dir, "doc_id", "text")).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    sizes = wanted.select("item_id", F.col("text").alias("sentence"), F.size(T.shingles(T.tokens(F.col("text")))).cast("long").alias("shingles"))
    return sizes.join(held, "item_id", "left").select("item_id.item_id", "sentence", "shingles", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"))


#: A needle, the output it is looked for in.
SHORT = Inline("short_lines", "line_id int, needle string, output string", [
    (1, "Allotment gardens class 1.4", "the allotment gardens belong to class 1 4 as shown"),
    (2, "Allotment gardens class 1.4", "allotment " + "filler " * 40 + "gardens " + "filler " * 40 + "class " + "filler " * 40 + "1 4"),
    (3, "Allotment gardens class 1.4", "nothing of the kind"),
    (4, "one two three four five", "five four three two one"),
    (5, "one two three four five", "zero one two three four six"),
    (6, "a a b b c", "c b a"),
    (7, "only here", ""),
])


@query(
    "short_line_window",
    f"""
    WITH {SHORT.cte}, n AS (SELECT line_id, {norm('needle')} AS a, {norm('output')} AS b FROM short_lines),
    t AS (SELECT line_id, {TOKENS.format(n='a')} AS need, {TOKENS.format(n='b')} AS o FROM n),
    d AS (SELECT line_id, list_distinct(need) AS need, len(need) + 5 AS w, o FROM t),
    c AS (SELECT *, list_transform(need, lambda x: len(list_filter(o, lambda y: y = x))) AS counts FROM d),
    p AS (SELECT *, list_filter(range(1, len(o) + 1), lambda i: list_contains(need, o[i]) AND len(list_filter(o, lambda y: y = o[i])) = list_min(counts)) AS places FROM c)
    SELECT line_id, CASE WHEN len(o) = 0 OR list_min(counts) = 0 THEN false ELSE len(list_filter(places, lambda q: len(list_intersect(need, o[greatest(1, q - w):q + w])) >= 0.8 * len(need))) > 0 END AS covered FROM p""",
)
def short_line_window(spark, sf_dir):
    return SHORT.df(spark).select("line_id", coverage.short_covered(T.tokens(F.col("needle")), T.tokens(F.col("output"))).alias("covered"))


@query(
    "missing_by_doc_top5",
    f"""
    WITH found AS ({SHINGLE_COVERAGE}), n AS (SELECT doc_id, count(*) AS n_items, max(hits) AS most_hits FROM found GROUP BY doc_id)
    SELECT doc_id, n_items, most_hits FROM n ORDER BY n_items DESC, doc_id LIMIT 5""",
)
def missing_by_doc_top5(spark, sf_dir):
    """The five documents that hold the most items."""
    counts = shingle_coverage(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("hits").alias("most_hits"))
    return coverage.worst(counts, "n_items", ["doc_id"])


SOURCES = Inline("sources", "doc_id int, text string", [
    (1, "The quick brown fox jumps over the lazy dog tonight. A second sentence was dropped from the output text entirely. The third one stays as it was written here."),
    (2, "All that is said here is also said over there. And this is too, in other words."),
    (3, "No words"),
    (4, "This document has no output at all, so nothing is covered."),
])
OUTPUTS = Inline("outputs", "doc_id int, text string", [
    (1, "---\ntitle: x\n---\n# Heading\n\nThe *quick* brown fox jumps over the lazy dog tonight.\n\nThe third one stays as it was written here.\n<!-- repair: missing-text recovery -->\nA second sentence was dropped from the output text entirely."),
    (2, "All that is said here is also said over there. And this is too in other words"),
    (3, ""),
])


def coverage_sql(sources: str, outputs: str) -> str:
    """Tables up to ``f`` (doc_id, sentence, covered) for tables ``sources`` and ``outputs`` (doc_id, text) of these names."""
    return f"""si AS (SELECT doc_id, unnest({SENTENCES.format(x='text')}) AS sentence FROM {sources}),
    sn AS (SELECT row_number() OVER () AS k, doc_id, sentence, {norm('sentence')} AS n FROM si), st AS (SELECT k, doc_id, sentence, {TOKENS.format(n='n')} AS need FROM sn), s AS (SELECT * FROM st WHERE len(need) >= 5),
    ox AS (SELECT doc_id, regexp_replace(text, '(?s)<!-- (?:repair|postfix): missing-text (?:recovery|rescue) -->.*', '', 'g') AS x FROM {outputs}), op AS (SELECT doc_id, {plain_sql('x')} AS p FROM ox),
    o1 AS (SELECT doc_id, {norm('p')} AS n FROM op), o2 AS (SELECT doc_id, {TOKENS.format(n='n')} AS o FROM o1), o AS (SELECT doc_id, o, {SHINGLES.format(t='o')} AS os FROM o2),
    j AS (SELECT k, s.doc_id, sentence, need, coalesce(o, []::VARCHAR[]) AS o, coalesce(os, []::VARCHAR[]) AS os FROM s LEFT JOIN o USING (doc_id)),
    sh AS (SELECT *, {SHINGLES.format(t='need')} AS ns, list_distinct(need) AS d FROM j),
    ct AS (SELECT *, CASE WHEN len(need) > 7 THEN []::BIGINT[] ELSE [len(list_filter(o, lambda y: y = x)) FOR x IN d] END AS c FROM sh),
    f AS (SELECT doc_id, sentence, CASE WHEN len(need) > 7 THEN len(list_intersect(ns, os)) >= 0.5 * len(ns) WHEN len(o) = 0 OR list_min(c) = 0 THEN false
        ELSE len(list_filter(range(1, len(o) + 1), lambda q: list_contains(d, o[q]) AND c[list_position(d, o[q])] = list_min(c) AND len(list_intersect(d, o[greatest(1, q - len(need) - 5):q + len(need) + 5])) >= 0.8 * len(d))) > 0 END AS covered FROM ct)"""


@query(
    "coverage_summary",
    f"""
    WITH {SOURCES.cte}, {OUTPUTS.cte}, {coverage_sql('sources', 'outputs')}
    SELECT doc_id, count(*) AS total, count(*) FILTER (covered) AS covered, count(*) FILTER (NOT covered) AS missing, 100.0::DOUBLE * count(*) FILTER (covered) / count(*) AS percent,
        CASE WHEN count(*) FILTER (NOT covered) = 0 THEN 'ok' ELSE 'warn' END AS status FROM f GROUP BY doc_id""",
)
def coverage_summary(spark, sf_dir):
    return coverage.coverage_summary(coverage.sentence_coverage(SOURCES.df(spark), OUTPUTS.df(spark)))


@query(
    "sentence_coverage_half",
    f"WITH half AS (SELECT doc_id, left(text, length(text) // 2) AS text FROM documents), {coverage_sql('documents', 'half')} SELECT doc_id, count(*) AS total, count(*) FILTER (covered) AS covered FROM f GROUP BY doc_id",
)
def sentence_coverage_half(spark, sf_dir):
    """How many checked sentences of each document the first half of it covers."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    half = docs.select("doc_id", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"))
    return coverage.coverage_summary(coverage.sentence_coverage(docs, half)).select("doc_id", "total", "covered")


@query(
    "running_line_by_source",
    f"""
    WITH l AS ({LINES}), n AS (SELECT source, doc_id, {norm('line')} AS normal FROM l), t AS (SELECT source, count(DISTINCT doc_id) AS total FROM l GROUP BY source),
    v AS (SELECT source, normal, count(DISTINCT doc_id) AS n_pages FROM n WHERE normal <> '' GROUP BY ALL)
    SELECT source, normal, n_pages, total AS total_pages FROM v JOIN t USING (source) WHERE n_pages >= 2 AND n_pages >= 0.1 * total""",
)
def running_line_by_source(spark, sf_dir):
    """Lines that run over a tenth of a source's documents: a source is the document here, a document the page."""
    lines = documents(spark, sf_dir, "doc_id", "source", "text").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.explode(F.split("text", "\n")).alias("text"))
    return chrome.running_lines(lines, share=0.1).withColumnRenamed("doc_id", "source").select("source", "normal", "n_pages", "total_pages")


@query(
    "running_line_vote",
    f"WITH l AS ({LINES}), n AS (SELECT doc_id, {norm('line')} AS normal FROM l) SELECT normal, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM n WHERE normal <> '' GROUP BY normal HAVING count(DISTINCT doc_id) >= 2",
)
def running_line_vote(spark, sf_dir):
    """Lines that more than one document has."""
    lines = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    normal = lines.select("doc_id", T.normalize(F.col("line")).alias("normal")).where("normal <> ''")
    return normal.groupBy("normal").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 2")


#: Documents as pages of ten lines under a running header and above a page number; every fourth line of a page stands in a figure's box, every fifth document begins with a cover.
PAGED = """l AS (SELECT doc_id, (i - 1) // 10 AS page_no, (i - 1) % 10 + 1 AS line_no, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    p AS (SELECT DISTINCT doc_id, page_no FROM l), paged AS (SELECT * FROM l UNION ALL SELECT doc_id, page_no, 0, 'The Running  Header of Páge' FROM p UNION ALL SELECT doc_id, page_no, 99, 'Page ' || (page_no + 1)::VARCHAR FROM p)"""


@query(
    "source_text_of_pages",
    f"""WITH {PAGED}, k AS (SELECT *, {norm('text')} AS n FROM paged WHERE line_no <> 4 AND NOT (doc_id % 5 = 0 AND page_no = 0)),
    t AS (SELECT doc_id, max(page_no) + 1 AS total FROM k GROUP BY doc_id), r AS (SELECT doc_id, n FROM k JOIN t USING (doc_id) WHERE n <> '' GROUP BY doc_id, n, total HAVING count(DISTINCT page_no) >= 2 AND count(DISTINCT page_no) >= 0.5 * total)
    SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY page_no, line_no)) AS text_sha256, count(*) AS n_lines FROM k
    WHERE NOT regexp_matches(n, '^page [0-9]+$') AND NOT regexp_matches(n, '^[0-9]+$') AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = k.doc_id AND r.n = k.n) GROUP BY doc_id""",
)
def source_text_of_pages(spark, sf_dir):
    """What text coverage asks for of paged documents: without figures' insides, cover pages, running lines and page numbers."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", F.floor(F.col("i") / 10).cast("int").alias("page_no"), (F.col("i") % 10 + 1).alias("line_no"), "text")
    pages = lines.select("doc_id", "page_no").distinct()
    header = pages.select("doc_id", "page_no", F.lit(0).alias("line_no"), F.lit("The Running  Header of Páge").alias("text"))
    footer = pages.select("doc_id", "page_no", F.lit(99).alias("line_no"), F.concat(F.lit("Page "), (F.col("page_no") + 1).cast("string")).alias("text"))
    y = F.col("line_no").cast("double") * 10
    placed = lines.unionAll(header).unionAll(footer).select("*", F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 8).alias("y1"))
    boxes = pages.select("doc_id", "page_no", F.lit(0.0).alias("x0"), F.lit(39.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(49.0).alias("y1"))
    covers = docs.where("doc_id % 5 = 0").select("doc_id")
    told = verify.source_text(placed, boxes, covers)
    return told.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
