"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item window is a run of words; its set elements are the word shingles at their positions. A window occurs only
where all its shingles occur, so with containment 1 the necessary prefix is one shingle: the rarest over all
documents. Documents' shingles join that prefix, positional and length bounds place the window, and the words are
compared. Nothing but hits is shuffled. Explodes are outer ones: for the others Catalyst infers a filter on the
array's size and computes the array once more for each of its elements there; the joins drop the null rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters beyond ASCII that lower() might change: then only A-Z are translated, which is slower.
CASED = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{M}]]"


#: What tells rows apart, since different texts may share a doc_id or have none.
ROW = ["doc_id", "h1", "h2"]


def text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z alone; null has none."""
    low = F.when(text.rlike(CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def _shingles(width: int) -> Column:
    """Hashes of the word shingles of column words, by position."""
    one = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)])
    return F.when(F.size("words") >= width, F.transform(F.sequence(F.lit(0), F.size("words") - width), one)).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int = 10, width: int = 3) -> DataFrame:
    """item_id, win (its words), width, off, shingle: a row for each shingle of each window. Items without words have none."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("len", F.least(F.size("words"), F.lit(window))).withColumn("width", F.least("len", F.lit(width)))
    runs = sized.select("item_id", "len", "width", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.slice("words", i, F.col("len")))).alias("win")).distinct()
    one = lambda w: F.xxhash64(*[F.get("win", F.col("off") + k) for k in range(w)])
    each = runs.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("len") - F.col("width"))).alias("off"))
    return each.withColumn("shingle", reduce(lambda c, w: c.when(F.col("width") == w, one(w)), range(2, width + 1), F.when(F.col("width") == 1, one(1))))


def find_windows(documents: DataFrame, items: DataFrame, window: int = 10, width: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), n_words, start, len, item_id: one row with null start for each document, and one for each place where an item window occurs.

    The items are the stated query set: they are broadcast in blocks of about block_bytes, each against all
    documents, so that what is broadcast has a bound whatever the number of items.
    """
    wins = item_windows(items, window, width)
    size = wins.agg(F.sum(F.length(F.array_join("win", " ")) + 64), F.collect_set("width")).first()
    blocks, widths = max(1, math.ceil((size[0] or 0) / block_bytes)), sorted(size[1])
    docs = documents.select("doc_id", *text_hashes(), words_of(F.col("text")).alias("words"))
    parts = []
    for block in range(blocks):
        own = wins.where(F.pmod(F.xxhash64("item_id", "win"), F.lit(blocks)) == block)
        for w in sorted({*widths, *([width] if block == 0 else [])}, reverse=True):
            mine, first = own.where(F.col("width") == w), block == 0 and w == width
            hashed = docs.select(*ROW, "words", _shingles(w).alias("hashes"))
            seen = hashed.select(F.explode_outer("hashes").alias("shingle")).join(F.broadcast(mine.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
            rare = mine.join(F.broadcast(seen), "shingle", "left").groupBy("item_id", "win", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "shingle")).alias("p"))
            prefix = rare.where("p.n > 0").select("p.shingle", "p.off", "win", "len", "item_id")
            if first:  # position 0 carries a mark that joins once in each document, so that all are in the result
                mark = documents.sparkSession.range(1).select(F.lit(0).cast("long").alias("shingle"), F.lit(None).cast("int").alias("off"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"))
                prefix = prefix.unionByName(mark)
            at = hashed.select(*ROW, "words", F.posexplode_outer(F.concat(F.array(F.lit(0).cast("long")), "hashes")).alias("at", "shingle"))
            start = F.col("at") - F.col("off")  # from 1
            placed = F.when(F.col("at") == 0, F.col("off").isNull()).when(F.col("off").isNull() | (start < 1) | (start + F.col("len") - 1 > F.size("words")), False).otherwise(F.slice("words", F.greatest(start, F.lit(1)), F.greatest("len", F.lit(1))) == F.col("win"))
            parts.append(at.join(F.broadcast(prefix), "shingle").where(placed).select(*ROW, F.size("words").cast("long").alias("n_words"), (start - 1).alias("start"), "len", "item_id"))
    return reduce(DataFrame.unionByName, parts)


def contamination(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of an item window is hit. Null and empty texts have no words; each row is judged by its
    own text, whatever other rows share its doc_id, and repeated rows are all returned; items with a null id mark words
    but aren't counted. What is gathered for a document is bounded by its own words.
    """
    found = find_windows(documents, items, window)
    place = F.struct("start", (F.col("start") + F.col("len")).alias("end"))
    by = found.groupBy(*ROW).agg(F.max("n_words").alias("n_words"), F.count_if(F.col("start").isNull()).alias("rows"), F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), place))).alias("runs"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["end"]))).alias("n"), F.greatest(a["end"], r["end"]).alias("end"))
    hit = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"].cast("long"))
    one = by.select("doc_id", "rows", "n_words", hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))
    return one.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("row", "rows")


def without_leaks(documents: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of documents in whose own text no item window occurs. Columns of documents stay as they are."""
    bad = find_windows(documents, items, window).where("start is not null").select(*ROW).distinct()
    name = "leak"
    while any(c.startswith(name) for c in documents.columns):
        name += "_"
    bad = bad.select(*[F.col(c).alias(f"{name}{c}") for c in ROW])
    same = F.col("doc_id").eqNullSafe(F.col(f"{name}doc_id")) & (F.xxhash64("text") == F.col(f"{name}h1")) & (F.xxhash64(F.lit(1), "text") == F.col(f"{name}h2"))
    return documents.join(bad, same, "left_anti")
