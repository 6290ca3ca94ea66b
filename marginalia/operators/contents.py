"""Tables of contents: rows with leaders, wrapped titles, page numbers on the next line and rows without numbers.

The lines of a document's window are a short array; a fold reads them with the two lines that follow, as a row may take
up to three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Pages and characters that are read, what leads to a page number, and the shapes of rows.
PAGES, CHARS = 15, 25_000
LEADERS, PAGE = r"(?:\.{2,}|…|(?:\s\.){3,}|\s{3,})\s*([0-9]{1,3})\s*$", r"^\s*([0-9]{1,3})\s*$"
BANNER, HEADER = r"(?i)\bcontents\b|\btable\s+of\s+contents\b", r"(?i)^(table of )?contents$"
PLAIN = r"^(.{8,160}?)(?:\s*(?:\.{2,}|…|(?:\s\.){3,}|\s{5,}))\s*([0-9]{1,3})\s*$"
NUMBERED, LABELLED = r"^\s*([0-9]{1,2}(?:\.[0-9]+){0,2})\s+(.+?)(?:\s*(?:\.{2,}|…|(?:\s\.){3,}|\s{4,}))\s*([0-9]{1,3})\s*$", r"^\s*([0-9]{1,2}(?:\.[0-9]+){0,2})\s+(.+)$"
CONFIDENCE = 0.82
ENTRY = "array<struct<label:string,title:string,page:int,raw:string>>"


def _wraps(line: Column) -> Column:
    """Whether a line can be the rest of the title above it."""
    starts = line.rlike(r"^[0-9]{1,2}\s+(?![0-9.])")
    return F.coalesce(F.length(line).between(3, 200) & ~line.rlike(LEADERS) & ~line.rlike(PAGE) & ~starts, F.lit(False))


def _row(label: Column, title: Column, page: Column, raw: Column, last: Column, least: int) -> Column:
    """An array with the entry, or null if its title or page can't be."""
    fits = (label != "") & (F.length(title) >= least) & page.between(1, last)
    return F.when(fits, F.array(F.struct(label.alias("label"), title.alias("title"), page.alias("page"), raw.alias("raw"))).cast(ENTRY))


def _raw_entries(lines: Column, last: Column) -> Column:
    """Entries in the order of lines, an array of collapsed ones that aren't empty."""
    part = lambda t, p, k: F.regexp_extract(t, p, k)
    number = lambda t: t.try_cast("int")
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+\.", " "), r"\.+$", ""))
    seen = F.transform(lines, lambda t, i: F.struct(t.alias("t"), F.get(lines, i + 1).alias("b"), F.get(lines, i + 2).alias("c")))
    state = lambda skip, plain, rows: F.struct(skip.cast("int").alias("skip"), plain.cast("int").alias("plain"), rows.alias("rows"))

    def step(a, r):
        t = r["t"]
        title = F.trim(F.regexp_replace(part(t, PLAIN, 1), r"\s+", " "))
        label = F.concat(F.lit("u"), (a["plain"] + 1).cast("string"))
        plain = F.when(t.rlike(PLAIN) & ~t.rlike("^[0-9]") & ~F.lower(title).isin("contents", "page"), _row(label, title, number(part(t, PLAIN, 2)), t, last, 8))
        wrapped = _wraps(r["b"])
        whole, after = F.when(wrapped, F.concat_ws(" ", t, r["b"])).otherwise(t), F.when(wrapped, r["c"]).otherwise(r["b"])
        one = F.when(whole.rlike(NUMBERED), _row(part(whole, NUMBERED, 1), bare(part(whole, NUMBERED, 2)), number(part(whole, NUMBERED, 3)), whole, last, 3))
        name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, LEADERS, ""), r"^\s*[0-9]{1,2}(?:\.[0-9]+){0,2}\s+", ""), r"\.+$", ""))
        led = F.when(whole.rlike(LABELLED) & whole.rlike(LEADERS), _row(part(whole, LABELLED, 1), name, number(part(whole, LEADERS, 1)), whole, last, 3))
        alone = F.trim(part(whole, LABELLED, 2))
        below = F.when(whole.rlike(LABELLED) & F.coalesce(after.rlike(PAGE), F.lit(False)) & ~alone.rlike("[0-9]{3,}"), _row(part(whole, LABELLED, 1), alone, number(F.trim(after)), F.concat_ws(" → ", whole, after), last, 3))
        numbered = F.when(t.rlike(r"^[0-9]{1,2}\s+|^[0-9]{1,2}\.[0-9]"), F.coalesce(one, led))
        under = F.when(t.rlike(r"^[0-9]{1,2}\s+|^[0-9]{1,2}\.[0-9]"), below)
        used = F.when(t.rlike(r"^[0-9]{1,2}\s+|^[0-9]{1,2}\.[0-9]") & wrapped, 1).otherwise(0)
        rows = lambda e: F.concat(a["rows"], e)
        return (
            F.when(a["skip"] > 0, state(a["skip"] - 1, a["plain"], a["rows"])).when(t.rlike(HEADER), state(F.lit(0), a["plain"], a["rows"])).when(plain.isNotNull(), state(F.lit(0), a["plain"] + 1, rows(plain)))
            .when(numbered.isNotNull(), state(used, a["plain"], rows(numbered))).when(under.isNotNull(), state(used + 1, a["plain"], rows(under))).otherwise(state(used, a["plain"], a["rows"]))
        )

    return F.aggregate(seen, state(F.lit(0), F.lit(0), F.array().cast(ENTRY)), step)["rows"]


def contents_entries(pages: DataFrame) -> DataFrame:
    """doc_id, position, label, title, start, end, level, confidence, raw of the table of contents of pages(doc_id, page, text).

    Read are the first PAGES pages, from the word contents on CHARS characters. Of numbered rows the longest title of each
    leading number counts, beside all rows without numbers; where that leaves fewer than three, all rows count. Fewer
    than two, or a document of one page, are no contents. A row ends before the next one, the last with the document.
    """
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "\n\n")
    early = pages.where(F.col("page") <= PAGES).groupBy("doc_id").agg(X.sanitise(F.regexp_replace(joined, "\r\n", "\n")).alias("text")).join(last.where("last >= 2"), "doc_id")
    at = F.greatest(F.regexp_instr("text", F.lit(BANNER)), F.lit(1))
    lines = F.filter(F.transform(F.split(F.substring(F.col("text"), at, F.lit(CHARS)), "\n"), X.collapse), lambda t: t != "")
    # the lines go through an explode, so that they are cut once
    cut = early.select("doc_id", "last", F.explode_outer(F.array(lines)).alias("lines"))
    found = cut.select("doc_id", "last", F.posexplode_outer(_raw_entries(F.col("lines"), F.col("last"))).alias("k", "e")).where("e is not null").select("doc_id", "last", "k", "e.*")
    major = F.element_at(F.split("label", r"\."), 1)
    doc = Window.partitionBy("doc_id")
    rows = found.withColumns({"major": major, "_plain": F.col("label").startswith("u")})
    longest = F.row_number().over(Window.partitionBy("doc_id", "major").orderBy(F.desc(F.length("title")), "k"))
    again = F.row_number().over(Window.partitionBy("doc_id", "label", "page").orderBy("k"))
    marked = rows.withColumns({"_a": F.col("_plain") | (longest == 1), "_b": again == 1})
    counted = marked.withColumns({"_na": F.count_if("_a").over(doc), "_n": F.count("*").over(doc), "_any": F.bool_or("_plain").over(doc)})
    every = (F.col("_na") < 3) & (F.col("_n") >= 3)
    kept = counted.withColumn("_every", every).where(F.when(F.col("_every"), F.col("_b")).otherwise(F.col("_a")))
    number = F.coalesce(F.col("major").try_cast("int"), F.lit(0))
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("_every") | F.col("_any"), F.col("page")).otherwise(number), F.when(F.col("_any") & ~F.col("_every"), F.col("title")), F.when(F.col("_every"), number), "k")
    placed = kept.withColumns({"position": F.row_number().over(order), "_left": F.count("*").over(doc), "_next": F.lead("page").over(order)}).where("_left >= 2")
    end = F.when(F.col("_next").isNull(), F.col("last")).otherwise(F.least("last", F.greatest("page", F.col("_next") - 1)))
    level = F.least(F.lit(4), F.size(F.split("label", r"\.")))
    return placed.select("doc_id", "position", "label", "title", F.col("page").alias("start"), end.alias("end"), level.alias("level"), F.lit(CONFIDENCE).alias("confidence"), "raw")
