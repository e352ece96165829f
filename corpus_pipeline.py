"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``, whatever other columns there are
and what they are called.

Defined results: null and empty texts have no language and go in the first stage; rows with
null ids are documents like others in every stage; of repeated rows the two dedup stages keep
one; an empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import exact_dedup, language_id, packing, quality, simhash_similar
from folioscope.llm._common import materialize, table
from folioscope.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell, by a score of 0.35 or more; texts without a letter go."""
    return language_id.keep_known(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier gives 0.5 or more; without labels of both kinds all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the longest, of equally long ones that of the smallest id; null counts as empty."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, found by SimHash: five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest id of a group stays; of a group without ids one row.
    """
    return simhash_similar.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; an empty document has its end token."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]

#: SQL cannot train the models.  The stages are tested: language and quality against plain loops over the models, the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
