"""URL rules behind a blocked Bloom filter, with DataFrame functions only.

The rules are canonical URLs (host, path).  A URL is turned into the keys under
which a fitting rule would be listed: each suffix of its host at a label
boundary, joined with each prefix of its path that has the length of some rule's
path.  A blocked Bloom filter of the listed keys passes the possible hits on to
an exact hash join, which removes false positives; the longest rule left decides.

The filter is a table of at most ``blocks`` rows of four 64-bit words (each key
sets two bits in every word of one block), whatever the number of rules; this
bound, 40 bytes a row, is what is broadcast.  The exact side is left to the
planner, which broadcasts it only if its measured size allows.  Keys come from
the distinct (host, path) pairs, so a host with a third of the pages is combined
before it is shuffled; adaptive execution splits it where verdicts join back.

Defined results: a null URL or one without ``://`` has empty host and path and
fits no rule; of rules with equal length the longer host wins, of repeated rules
the smallest verdict; rules with a null host or path are ignored; no rules, or
none that fits, give the default verdict; repeated rows and further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 14
FEWEST_BLOCKS, MOST_BLOCKS = 1 << 10, 1 << 18
WORDS = 4
#: The alphabets of ASCII lower-casing (fixed values).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """For each word of the block two bits, from six-bit fields of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    field = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), field(i))
    return [one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(WORDS)]


def blocks_for(keys: DataFrame) -> int:
    """Blocks for so many keys, within ``FEWEST_BLOCKS`` and ``MOST_BLOCKS``; beyond those the filter only passes more."""
    return max(FEWEST_BLOCKS, min(MOST_BLOCKS, keys.count() // 24))


def blocked_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter as rows (block, w0..w3); blocks without keys are absent."""
    marked = keys.select(_block_of(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(rows: DataFrame, key: str, bloom: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows whose key the filter may hold; none that it holds is lost."""
    probe = rows.select("*", _block_of(F.col(key), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))])
    hit = None
    for i in range(WORDS):
        test = F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}")
        hit = test if hit is None else hit & test
    return probe.join(F.broadcast(bloom), "block").where(hit).select(*rows.columns)


def _candidates(pairs: DataFrame, lengths: list[int]) -> DataFrame:
    """Keys (struct of host suffix and path prefix) under which a rule for the pair would stand."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    return pairs.withColumn("r_host", F.explode(suffixes)).withColumn("r_path", F.explode(prefixes)).withColumn("key", F.concat("r_host", F.lit("\x00"), "r_path"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow", blocks: int = BLOCKS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.  ``rules`` has host, path and verdict."""
    listed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    listed = listed.withColumn("key", F.concat("host", F.lit("\x00"), "path"))
    # path lengths of rules: as many numbers at most as a URL has characters
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    if not lengths:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = _candidates(parsed.select("host", "path").distinct(), lengths)
    hits = possible_hits(keyed, "key", blocked_filter(listed, "key", blocks), blocks)
    exact = hits.join(listed.select("key", "verdict"), "key")
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias("host_length"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    decided = exact.groupBy("host", "path").agg(F.max(order).alias("best"))
    decided = decided.select(F.col("host").alias("d_host"), F.col("path").alias("d_path"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    joined = parsed.join(decided, (F.col("host") == F.col("d_host")) & (F.col("path") == F.col("d_path")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
