"""Live form of the log roll-up (AG-7): workers append records, metrics keep up.

Outputs are sums, so Structured Streaming keeps one small state row per interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from earshot.operators.metrics import rollup_log


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A directory of Parquet log records as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def follow_log(
    log: DataFrame, path: str, checkpoint: str, interval: int = 200, once: bool = False
) -> StreamingQuery:
    """Keep ``path`` (Parquet, one directory per micro-batch) up to date with the roll-up.

    Update mode emits only intervals that changed; the newest batch of an interval holds
    its current metrics, and a batch that is run again overwrites its own directory.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        rollup_log(log, interval=interval)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Current metrics per interval."""
    from pyspark.sql import functions as F

    saved = spark.read.parquet(path)
    rest = [c for c in saved.columns if c not in ("interval", "batch_id")]
    newest = F.max_by(F.struct(*rest), F.col("batch_id"))
    return saved.groupBy("interval").agg(newest.alias("_m")).select("interval", "_m.*")
