"""Tables by key that are fed in batches, and fed again after failures.

A batch is a partition of the log, so writing it again replaces it: replays change nothing.
The newest version of a key is what counts.  ``compact`` folds old batches into a base, after
which those batches are known and refused.  No row is ever changed in place, and nothing that
is being read is overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import discard

BATCH = "batch_id"


class Versions:
    """``path`` holds ``log/batch_id=<n>`` and ``base/upto=<n>``; ``order`` tells the rows of one key in one batch apart, the largest stays."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, order: Column | None = None):
        self.spark, self.path, self.keys, self.schema, self.order = spark, path.rstrip("/"), keys, schema, order

    def _numbers(self, folder: str, name: str) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = place.getFileSystem(conf)
        if not fs.exists(place):
            return []
        parts = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith(f"{name}=")]
        # a base counts once it is committed
        whole = [p for p in parts if name == BATCH or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch; the same number again replaces it, and one that the base holds changes nothing."""
        done = self._numbers("base", "upto")
        if done and batch_id <= done[-1]:
            return
        one = self._newest(batch, self.order) if self.order is not None else batch
        told = one.select(*self.schema.names, F.lit(batch_id).cast("long").alias(BATCH))
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{self.path}/log")

    def _newest(self, rows: DataFrame, order: Column) -> DataFrame:
        """One row a key, that of the greatest ``order``; rows are combined before they are shuffled."""
        rest = [c for c in self.schema.names if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("best"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"best.`{c}`").alias(c) for c in self.schema.names])

    def current(self) -> DataFrame:
        """The newest version of each key."""
        bases, logs = self._numbers("base", "upto"), self._numbers("log", BATCH)
        known = bases[-1] if bases else None
        parts = []
        if known is not None:
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/base/upto={known}").withColumn(BATCH, F.lit(known).cast("long")))
        if [n for n in logs if known is None or n > known]:
            log = self.spark.read.schema(self.schema.fromJson(self.schema.jsonValue()).add(BATCH, "long")).parquet(f"{self.path}/log")
            parts.append(log if known is None else log.where(F.col(BATCH) > known))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._newest(rows, F.col(BATCH))

    def compact(self) -> None:
        """Fold the log into a new base, then drop what it replaces; a run that breaks off in between loses nothing."""
        logs, bases = self._numbers("log", BATCH), self._numbers("base", "upto")
        new = [n for n in logs if not bases or n > bases[-1]]
        if new:
            self.current().write.mode("overwrite").parquet(f"{self.path}/base/upto={new[-1]}")
            for n in bases:
                discard(self.spark, f"{self.path}/base/upto={n}")
        upto = self._numbers("base", "upto")[-1:]
        for n in logs:
            if upto and n <= upto[0]:
                discard(self.spark, f"{self.path}/log/{BATCH}={n}")
