"""Roll-ups over the driver's own tables: our addition, built on the same operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query, table


@query("quality_by_source", "SELECT source, count(*) AS n_docs, count(quality) AS n_labelled, sum(quality)::BIGINT AS n_good, sum(toxic)::BIGINT AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def quality_by_source(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.sum("quality").alias("n_good"), F.sum("toxic").alias("n_toxic"))


@query("conversation_turn_stats", "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, sum(length(text))::BIGINT AS n_chars, max(turn) AS last_turn FROM conversations GROUP BY role")
def conversation_turn_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations"), F.sum(F.length("text")).alias("n_chars"), F.max("turn").alias("last_turn"))


@query("events_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_hourly(spark, sf_dir):
    counts = jobs.windowed_counts(table(spark, sf_dir, "events"))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))
