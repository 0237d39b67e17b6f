"""A ledger of dispatched keys under a stream: publish, then mark, each key once (M8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch up to this many are broadcast to the ledger's scan.
BROADCAST_ROWS = 200_000


def marked(spark: SparkSession, path: str) -> DataFrame:
    """(key, batch) of all keys that were dispatched."""
    return spark.read.schema("key string, batch long").parquet(f"{path}/batch=*") if _any(spark, path) else spark.createDataFrame([], "key string, batch long")


def _any(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def dispatching(path: str, publish: Callable[[DataFrame, int], None], key: str = "key") -> Callable[[DataFrame, int], None]:
    """A handler for ``foreachBatch``: new keys of each batch are published, then marked in the ledger at ``path``.

    ``publish(rows, batch)`` gets the first row of each key that no earlier batch has marked; it must replace what it
    published for the same batch before. A batch that fails between publishing and marking comes again with the same
    number and the same keys, for the ledger's own entry of this batch is left out; so each key is published once. Null
    keys are never dispatched.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).persist()
        try:
            keys = rows.select(F.col(key).alias("key"))
            few = rows.count() <= BROADCAST_ROWS
            before = marked(spark, path).where(F.col("batch") < number).select("key")
            # The ledger is the large side: with few new keys it is read, but not shuffled.
            known = before.join(F.broadcast(keys) if few else keys, "key", "left_semi").distinct()
            new = rows.join(known.withColumnRenamed("key", "_known"), F.col(key) == F.col("_known"), "left_anti")
            publish(new, number)
            new.select(F.col(key).alias("key"), F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    return handle
