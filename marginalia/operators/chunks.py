"""Bounded chunks of pages: a greedy fold over one document's pages inside the JVM, and their rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pages, characters and rendered characters of a chunk in each mode.
MODES = {"fast": (12, 42_000, 25_000), "standard": (8, 30_000, 25_000), "deep": (5, 22_000, 20_000)}


def chunk_pages(pages: DataFrame, limits: tuple[int, int, int] = MODES["fast"], key: str = "doc_id") -> DataFrame:
    """pages(key, page, chars, headed) with chunk from 1: a page opens a chunk if the open one is full in pages or
    characters, or if the page has a heading and the open chunk passed 55 % of what is rendered."""
    most_pages, most_chars, rendered = limits
    kind = "struct<out:array<struct<page:int,chunk:int>>,chunk:int,n:int,chars:bigint>"
    none = F.struct(F.array().cast("array<struct<page:int,chunk:int>>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("chars")).cast(kind)

    def step(a, p):
        opens = (a["n"] == 0) | (a["n"] >= most_pages) | (a["chars"] + p["chars"] > most_chars) | (p["headed"] & (a["chars"] > rendered * 0.55))
        chunk = a["chunk"] + opens.cast("int")
        return F.struct(F.concat(a["out"], F.array(F.struct(p["page"].alias("page"), chunk.alias("chunk")))).alias("out"), chunk.alias("chunk"), F.when(opens, 1).otherwise(a["n"] + 1).alias("n"), F.when(opens, p["chars"]).otherwise(a["chars"] + p["chars"]).alias("chars")).cast(kind)

    docs = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", F.col("chars").cast("bigint").alias("chars"), "headed"))).alias("ps"))
    return docs.select(key, F.inline_outer(F.aggregate("ps", none, step, lambda a: a["out"])))


def render_chunks(paged: DataFrame, rendered: int, key: str = "doc_id") -> DataFrame:
    """key, chunk_id, first_page, last_page, text, tokens of pages(key, page, text, chunk)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit("\n"), F.col("text")).alias("b")))), lambda s: s["b"]), "\n\n")
    got = paged.groupBy(key, "chunk").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.substring(body, 1, rendered).alias("text"))
    name = F.concat(F.lit("chunk-"), F.when(F.col("chunk") < 1000, F.lpad(F.col("chunk").cast("string"), 3, "0")).otherwise(F.col("chunk").cast("string")), F.lit("-p"), F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"))
    return got.select(key, name.alias("chunk_id"), "first_page", "last_page", "text", F.ceil(F.length("text") / 4).cast("long").alias("tokens"))


def important_lines(lines: DataFrame, pattern: str, most: int = 80, key: str = "doc_id") -> DataFrame:
    """The first most lines of each key that match pattern."""
    hit = lines.where(F.col("line").rlike(pattern))
    return hit.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("line_index"))).where(F.col("_k") <= most).drop("_k")
