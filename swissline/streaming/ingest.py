"""Incremental ingestion of match feeds: late repeats are dropped inside the watermark, batches go into the store by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from swissline.operators import store


def first_seen(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    return stream.withColumn("identity", store.identity()).withWatermark(time, late).dropDuplicatesWithinWatermark(["identity"])


def daily_counts(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n"))


def upsert_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is added as a folder of its own, so a batch that runs again replaces itself; readers take the last row of each identity."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
