"""The review log as a stream: the same state as operators.review.review_state, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import review


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of new Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def live_state(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming review state, for output mode complete or update. Repeated event ids within the watermark count once;
    the latest rating is by event time and event id, so late events can't replace newer ones."""
    once = review.review_events(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    got = once.groupBy("item_id").agg(F.max(F.struct("ts", "event_id", "rating")).alias("m"), F.count("*").alias("reviews"))
    return got.select("item_id", F.col("m.rating").alias("rating"), "reviews", F.col("m.ts").alias("last_ts"), review.due(F.col("m.rating"), F.col("m.ts")).alias("due_ts"))


def live_windows(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Reviews of closed windows, for output mode append."""
    return review.windows(review.review_events(events).withWatermark("ts", late), length)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Everything available now into an in-memory table of the driver, for small results and tests."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything available now, output mode complete: each batch writes the whole state as Parquet in place of the one before; nothing passes through the driver."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)  # no batch runs on an empty source

    def write(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
