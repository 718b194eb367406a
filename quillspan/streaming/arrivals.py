"""Tables that grow while an experiment runs: rates by time window, and keyed tables kept up to date.

The streams are Structured Streaming: what a window holds is state with a watermark, and each finished batch is written to a shared
folder, so a restart goes on from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files of a folder (or that a pattern names) as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def rates(stream: DataFrame, time: str, by: list[str], event: Column, width: str, late: str) -> DataFrame:
    """begin, the keys, n and the share of rows with the event, by window of the time.  A row is not counted if its window ended more than ``late``
    before the latest time of the batches before; windows that old leave the state."""
    seen = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("_w"), *by)
    out = seen.agg(F.count("*").alias("n"), F.avg(event.cast("double")).alias("rate"))
    return out.select(F.col("_w.start").alias("begin"), *by, "n", "rate")


def _latest(rows: DataFrame, keys: list[str], first: bool = False) -> DataFrame:
    """The row of each key from its last (or first) batch."""
    order = F.col("batch").asc() if first else F.col("batch").desc()
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r", "batch")


def finish(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Works off what has arrived and returns the whole result as it then stands, one row for each of the keys.

    A batch writes only the rows that it changed, to a folder of its own under ``path`` (``batch=<n>``), so a repeated batch writes the same again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    return _latest(stream.sparkSession.read.schema(_with_batch(stream)).parquet(path), keys)


def _with_batch(stream: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in [*stream.dtypes, ("batch", "long")])


def keep_up(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str]) -> None:
    """Folds what has arrived into the keyed table at ``path``, which ``kept`` reads.

    Of a batch's rows of one key the greatest by ``order`` stays (ties: by all other columns), so a repeated batch chooses the same rows; it writes its rows alone, to
    ``batch=<n>``, and no earlier folder is read or written again."""

    def put(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in [*keys, *order]]
        w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, *rest]])
        batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def kept(spark: SparkSession, path: str, keys: list[str], overwrite: bool = True) -> DataFrame:
    """The keyed table: each key's row from its last batch, or without ``overwrite`` from its first."""
    return _latest(spark.read.parquet(path), keys, not overwrite)
