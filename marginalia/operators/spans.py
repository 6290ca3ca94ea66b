"""Spans over ordered rows: parents, next boundaries, ranges, as-of look-ups, and greedy folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parents(rows: DataFrame, group: str, order: str, level: str = "level", levels: int = 5) -> DataFrame:
    """rows with parent_order: the nearest row before with a smaller level. One window for all levels."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.lit(None).cast(rows.schema[order].dataType)
    for k in range(levels, 1, -1):
        found = F.when(F.col(level) == k, F.last(F.when(F.col(level) < k, F.col(order)), True).over(before)).otherwise(found)
    return rows.withColumn("parent_order", found)


def span_ends(rows: DataFrame, group: str, order: str, level: str = "level", levels: int = 5) -> DataFrame:
    """rows with next_order: the next row with the same or a smaller level, where the span of a row ends."""
    after = Window.partitionBy(group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    found = F.lit(None).cast(rows.schema[order].dataType)
    for k in range(levels, 0, -1):
        found = F.when(F.col(level) == k, F.first(F.when(F.col(level) <= k, F.col(order)), True).over(after)).otherwise(found)
    return rows.withColumn("next_order", found)


def ranges(starts: DataFrame, group: str, start: str, last: Column) -> DataFrame:
    """starts with end: one before the next start, at least the own start, for the last one last."""
    nxt = F.lead(start).over(Window.partitionBy(group).orderBy(start))
    return starts.withColumn("end", F.greatest(F.col(start), F.coalesce(nxt - 1, last)))


def range_errors(chapters: DataFrame, group: str, pages: Column) -> DataFrame:
    """group, error of chapters(start, end): bounds, order, many chapters on page 1, and one that is almost the whole."""
    w = Window.partitionBy(group).orderBy("position")
    flagged = chapters.withColumns({"_pages": pages, "_prev": F.lag("start").over(w)})
    one = flagged.select(group, F.explode_outer(F.array_compact(F.array(
        F.when((F.col("start") < 1) | (F.col("end") > F.col("_pages")), "out_of_bounds"),
        F.when(F.col("start") > F.col("end"), "start_after_end"),
        F.when(F.col("_prev") >= F.col("start"), "not_increasing"),
        F.when((F.col("end") - F.col("start") + 1) >= F.col("_pages") * 0.9, "near_whole_span"),
    ))).alias("error")).where("error is not null").distinct()
    front = flagged.groupBy(group).agg(F.avg((F.col("start") == 1).cast("int")).alias("share")).where("share > 0.55").select(group, F.lit("many_start_at_one").alias("error"))
    return one.unionByName(front)


def shortened(chapters: DataFrame, group: str) -> DataFrame:
    """chapters(number, start, end) that end before the first start of a higher number inside them."""
    inner = chapters.select(group, F.col("number").alias("_n"), F.col("start").alias("_s"))
    cut = chapters.join(inner, group).where((F.col("_n") > F.col("number")) & (F.col("_s") > F.col("start")) & (F.col("_s") <= F.col("end"))).groupBy(group, "number").agg(F.min("_s").alias("_cut"))
    return chapters.join(cut, [group, "number"], "left").withColumn("end", F.coalesce(F.col("_cut") - 1, F.col("end"))).drop("_cut")


def as_of(rows: DataFrame, anchors: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """rows with the value of the last anchor at or before at: a union and a running last, one shuffle by group."""
    marked = anchors.select(group, F.col(at), F.lit(0).alias("_kind"), F.col(value).alias("_v"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in (group, at)])
    both = rows.withColumns({"_kind": F.lit(1), "_v": F.lit(None).cast(anchors.schema[value].dataType)}).unionByName(marked)
    w = Window.partitionBy(group).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).where("_kind = 1").drop("_kind", "_v")


def line_offsets(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines with offset: where each begins in the document."""
    w = Window.partitionBy(key).orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))


def page_windows(pages: DataFrame, size: int = 12, key: str = "doc_id") -> DataFrame:
    """key, block from 0, first_page, last_page, chars: up to size pages from the document's first one."""
    first = F.min("page").over(Window.partitionBy(key))
    return pages.withColumn("block", F.floor((F.col("page") - first) / size).cast("int")).groupBy(key, "block").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("chars").alias("chars"))


def least_blocks(pages: Column) -> Column:
    """How many blocks a document of more than 30 pages should have."""
    return F.when(pages > 30, F.least(F.lit(30), F.greatest(F.lit(5), F.ceil(pages / 7)))).otherwise(0)


def block_spans(lines: DataFrame, start: str, stop: str, most_lines: int, most_chars: int, key: str = "doc_id") -> DataFrame:
    """key, first_line, last_line, text: from each line that matches start up to the line before the next that matches
    start or stop, most_lines or most_chars. A start inside a span isn't one: a fold over one document's lines."""
    row = F.struct("line_index", "line", F.col("line").rlike(start).alias("s"), F.col("line").rlike(stop).alias("e"))
    docs = lines.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "struct<done:array<struct<first:int,last:int,text:string>>,first:int,last:int,text:string>"
    none = F.struct(F.array().cast("array<struct<first:int,last:int,text:string>>").alias("done"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit("").alias("text"))

    def closed(a):
        return F.when(a["first"] >= 0, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"), a["text"].alias("text"))))).otherwise(a["done"])

    def step(a, r):
        full = (r["line_index"] - a["first"] >= most_lines) | (F.length(a["text"]) + F.length(r["line"]) + 1 > most_chars)
        ends = (a["first"] >= 0) & (r["s"] | r["e"] | full)
        begins = r["s"] & ((a["first"] < 0) | ends)
        new = F.struct(closed(a).alias("done"), F.when(begins, r["line_index"]).otherwise(-1).alias("first"), r["line_index"].alias("last"), F.when(begins, r["line"]).otherwise("").alias("text"))
        more = F.struct(a["done"].alias("done"), a["first"].alias("first"), r["line_index"].alias("last"), F.concat(a["text"], F.lit("\n"), r["line"]).alias("text"))
        return F.when(begins | ends, new.cast(kind)).when(a["first"] >= 0, more.cast(kind)).otherwise(a)

    spans = docs.select(key, F.explode_outer(F.aggregate("rows", none.cast(kind), step, closed)).alias("b")).where("b is not null")
    return spans.select(key, F.col("b.first").alias("first_line"), F.col("b.last").alias("last_line"), F.col("b.text").alias("text"))


def numbered(rows: DataFrame, keys: list[str], order: str, ties: list[str], name: str, buckets: int = 64) -> DataFrame:
    """rows with name: their number from 1 within keys by the numeric column order, then ties.

    Rows are numbered within ranges of order, whose bounds are quantiles, and each range begins after the rows of those
    before it: no task holds all rows of a key, only those of one range of it.
    """
    marks = rows.agg(F.percentile_approx(order, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10_000)).alias("_marks"))
    ranged = rows.crossJoin(F.broadcast(marks)).withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col(order)))).drop("_marks")  # one row of at most buckets numbers
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy(*keys, "_range").count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order, *ties))
    r, f = ranged.withColumn("_own", own).alias("r"), first.alias("f")
    same = F.col("r._range") == F.col("f._range")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    return r.join(f, same).select("r.*", (F.col("f._first") + F.col("r._own")).alias(name)).drop("_range", "_own")
