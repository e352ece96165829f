"""Running streams over what has arrived, and aggregations by event time.

All run with ``availableNow``: they work off what is there and stop; the next run goes on from
the checkpoint.  The same functions run over a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrived(spark: SparkSession, path: str, schema: StructType, files_a_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def work_off(result: DataFrame, checkpoint: str, out: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Run a stream until all that has arrived is done, and wait for it.

    Rows go to the Parquet table ``out``, each batch whole or not at all, or to ``each``, which
    is given a batch and its number and may be given the same ones again after a failure.
    """
    writer = result.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    writer = writer.queryName(name) if name else writer
    query = writer.format("parquet").option("path", out).start() if each is None else writer.foreachBatch(each).start()
    query.awaitTermination()
    return query


def inbox(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Convert the Parquet files that are new in ``path`` since the last run; the checkpoint is the memory of what is done."""
    return work_off(convert(arrived(spark, path, schema)), checkpoint, out)


def timed(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``events`` with ``ts`` as a timestamp; on a stream, rows later than ``late`` behind the newest are left out by what follows."""
    told = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return told.withWatermark(ts, late) if events.isStreaming else told


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n, value: tumbling windows."""
    return timed(events, ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), kind, "n", "value")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, n, value: runs of a key's rows that are less than ``gap`` apart.

    A stream gives a session once the watermark has passed its end.
    """
    merged = timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return merged.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "value")


def followed(first: DataFrame, second: DataFrame, key: str, ts: str = "ts", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """All columns of each ``first`` beside each ``second`` (as then_*) of its key that comes at the same time or up to ``within`` later.

    On a stream, rows of either side leave the state when the watermark says that nothing can meet them any more.
    """
    left = timed(first, ts, late)
    right = timed(second, ts, late)
    right = right.select(*[F.col(c).alias(f"then_{c}") for c in right.columns])
    near = (F.col(key) == F.col(f"then_{key}")) & (F.col(f"then_{ts}") >= F.col(ts)) & (F.col(f"then_{ts}") <= F.col(ts) + F.expr(f"interval {within}"))
    return left.join(right, near)
