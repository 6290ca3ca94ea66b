"""Review scheduling and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until the next review, and the ratings that event types stand for.
DAYS = {"again": 0, "hard": 1, "good": 3, "easy": 7}
RATINGS = {"error": "again", "click": "hard", "view": "good", "purchase": "easy"}


def rating_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for event, rating in RATINGS.items():
        out = F.when(event_type == event, rating).otherwise(out)
    return out


def due(rating: Column, ts: Column) -> Column:
    days = F.lit(0)
    for r, n in DAYS.items():
        days = F.when(rating == r, n).otherwise(days)
    return ts + F.make_dt_interval(days)


def review_events(events: DataFrame) -> DataFrame:
    """event_id, item_id, ts, rating: events that are reviews, with the user as the item; time stamps of no zone are UTC."""
    return events.select("event_id", F.col("user_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), rating_of(F.col("event_type")).alias("rating")).where("rating is not null")


def review_state(reviews: DataFrame) -> DataFrame:
    """item_id, rating, reviews, last_ts, due_ts: the latest rating by event time, then event id."""
    got = reviews.groupBy("item_id").agg(F.max(F.struct("ts", "event_id", "rating")).alias("m"), F.count("*").alias("reviews"))
    return got.select("item_id", F.col("m.rating").alias("rating"), "reviews", F.col("m.ts").alias("last_ts"), due(F.col("m.rating"), F.col("m.ts")).alias("due_ts"))


def due_queue(items: DataFrame, state: DataFrame, as_of: str) -> DataFrame:
    """Items never reviewed or due at as_of, the longest due first."""
    return items.join(state, "item_id", "left").where(F.col("due_ts").isNull() | (F.col("due_ts") <= F.lit(as_of).cast("timestamp"))).orderBy(F.asc_nulls_first("due_ts"), "item_id")


def coverage(items: DataFrame, reviewed: DataFrame, by: str) -> DataFrame:
    """by, items, reviewed, share."""
    marks = reviewed.select("item_id").distinct().withColumn("_r", F.lit(1))
    got = items.join(marks, "item_id", "left").groupBy(by).agg(F.count("*").alias("items"), F.count("_r").alias("reviewed"))
    return got.withColumn("share", F.round(F.col("reviewed") / F.col("items"), 6))


def windows(reviews: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return reviews.groupBy(w.alias("w")).agg(F.count("*").alias("reviews"), F.count_if(F.col("rating") == "again").alias("again")).select(F.col("w.start").alias("start"), "reviews", "again")


def sessions(reviews: DataFrame, gap: str = "30 minutes") -> DataFrame:
    got = reviews.groupBy("item_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("reviews"))
    return got.select("item_id", F.col("w.start").alias("start"), "reviews")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key of a log."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
