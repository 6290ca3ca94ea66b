"""Documents to lines, pages and sentences, and the topics that are counted in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_index from 0, line, layer, confidence; a carriage return in front of a line feed isn't part of a line."""
    each = documents.select(key, F.posexplode_outer(F.split(X.sanitise(F.regexp_replace(text, "\r\n", "\n")), "\n")).alias("line_index", "line")).where("line is not null")
    return each.withColumn("layer", X.layer(F.col("line"))).withColumn("confidence", X.layer_confidence(F.col("layer")))


def layers(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and, for each layer, its lines' number and text in order; blank lines keep their places in the printed text, but aren't counted."""
    kinds = ("printed", "handwritten", "noise")
    kept = lines(documents, key).groupBy(key)
    end = F.regexp_replace("line", r"\s+$", "")
    line = {"printed": F.when(F.col("layer") == "blank", "").when(F.col("layer") == "printed", F.col("line")), "handwritten": F.when(F.col("layer") == "handwritten", end), "noise": F.when(F.col("layer") == "noise", end)}
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line[k].isNotNull(), F.struct("line_index", line[k].alias("t"))))), lambda s: s["t"]), "\n")
    return kept.agg(*[F.count_if(F.col("layer") == k).alias(f"n_{k}") for k in kinds], *[text(k).alias(f"{k}_text") for k in kinds])


def usable_text(layered: DataFrame, least: int = 80) -> DataFrame:
    """The printed layer if it has least characters, else all layers."""
    return layered.withColumn("text", F.when(F.length("printed_text") >= least, F.col("printed_text")).otherwise(F.concat_ws("\n", "printed_text", "handwritten_text", "noise_text")))


#: Where a glued line is broken, in order; the first list is for every text, the second for lines of LONG characters on.
LABELS = "Definition|Theorem|Proposition|Lemma|Corollary|Remark|Example|Exercise|Algorithm"
BREAKS = [(r"(?i)([^\n])\s*(\[Page\s+\d+\])", "$1\n$2"), (rf"(?i)([a-z0-9)\]}}])\s+((?:{LABELS})\s+\d+(?:\.\d+)*(?:\s*\([^)]*\))?)", "$1\n$2"), (r"(?i)([a-z0-9)\]}])\s+(Proof\s*[.:])", "$1\n$2"), (r"(?i)([a-z0-9)\]}])\s+(Chapter\s+\d+)\b", "$1\n$2"), (r"\n{3,}", "\n\n")]
LONG = 200
REFLOWS = [(r"(?i)([.!?][\"'”]?\s+)(Chapter\s+\d)", "$1\n$2"), (r"([.!?][\"'”]?\s+)(\d{1,2}\.\d{1,3}\s+[A-Z\u00C0-\u024F])", "$1\n$2"), (rf"(?i)([a-z0-9%)\]}}])\s+((?:{LABELS})\s+\d)", "$1\n$2"), (r"(?i)([a-z0-9%)\]}])\s+(Proof\s*[.:])", "$1\n$2")]


def broken_lines(text: Column, rules: list[tuple[str, str]] = BREAKS) -> Column:
    """text with a line break in front of page marks, labels, proofs and chapters that are glued to a line, and at most one blank line in a row."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, F.regexp_replace(text, "\r\n", "\n"))


def reflowed(text: Column) -> Column:
    """text whose long lines are broken in front of chapters, numbered sections, labels and proofs; the others stay."""
    one = lambda t: F.when(F.length(t) < LONG, t).otherwise(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REFLOWS, t))
    return F.array_join(F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), one), "\n")


#: What a light heading looks like.
LIGHT = r"(?i)^(chapter|section|lecture|topic|\d+(\.\d+)*|[A-Z][A-Z\s]{5,})\b[:.)\-\s]*(.+)?$|^#+\s+"


def light_headings(pages: DataFrame, *keys: str, most: int = 8) -> DataFrame:
    """keys, headings: the first most lines of 4 to 120 characters of each page that look like headings; none: an empty array.

    Word borders are ASCII's, see ascii_fold.
    """
    each = F.transform(F.split("text", r"\n+"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    kept = pages.withColumn("_l", each).select(*keys, "_l", F.filter("_l", lambda t: F.length(t).between(4, 120) & X.ascii_fold(t).rlike(LIGHT)).alias("_h"))
    return kept.select(*keys, F.coalesce(F.slice("_h", 1, most), F.array().cast("array<string>")).alias("headings"))


def pages_of(documents: DataFrame, per_page: int = 8, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, page from 1, text, chars: every per_page lines of a document are a page."""
    n = F.lit(per_page)
    docs = documents.where("text is not null").select(key, *keep, F.split("text", "\n").alias("parts"))
    parts = F.col("parts")  # a column: in a lambda an expression is computed for each element
    count = F.ceil(F.size(parts) / n).cast("int")
    pages = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda p: F.array_join(F.slice(parts, (p - 1) * n + 1, n), "\n"))
    each = docs.select(key, *keep, F.posexplode_outer(pages).alias("p", "text"))
    return each.select(key, *keep, (F.col("p") + 1).alias("page"), "text", F.length("text").alias("chars"))


def marked_pages(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, text of text with [Page N] marks on lines of their own; text before the first mark is page 1 where no mark has it."""
    parts = documents.select(key, F.posexplode_outer(F.split("text", r"(?=\[Page\s+[0-9]+\]\n)")).alias("k", "part"))
    number = F.regexp_extract("part", r"^\[Page\s+([0-9]+)\]\n", 1)
    body = F.regexp_replace(F.regexp_replace("part", r"^\[Page\s+[0-9]+\]\n", ""), r"^\s+|\s+$", "")
    return parts.select(key, "k", F.coalesce(number.try_cast("int"), F.lit(1)).alias("page"), body.alias("text"), (number == "").alias("_none")).where("not _none or text <> ''").drop("_none", "k")


def pages_or_whole(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """marked_pages, and page 1 with the whole text for documents without any mark or rule of pages.

    A rule is a line "Page N" between two lines of three dashes or more; it is read like a mark.
    """
    rules = F.regexp_replace("text", r"(?:^|\n)-{3,}\nPage\s+([0-9]+)[^\n]*\n-{3,}\n", "\n[Page $1]\n")
    return marked_pages(documents.select(key, rules.alias("text")), key)


def pages_to_recognise(pages: DataFrame, key: str = "doc_id", most: int = 200) -> DataFrame:
    """key, page of pages(key, page, text, images) whose text should be recognised from the image, at most most of a document.

    Those with three images or fewer than 80 characters; all where a document's mean is below 120.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    mean = F.avg(n).over(Window.partitionBy(key))
    asked = pages.withColumn("_mean", mean).where((F.col("_mean") < 120) | (F.coalesce("images", F.lit(0)) >= 3) | (n < 80))
    return asked.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("page"))).where(F.col("_k") <= most).select(key, "page")


def render(pages: DataFrame, key: str = "doc_id", source: str | None = None, first: int = 1, last: int | None = None) -> DataFrame:
    """key, text: pages from first to last in order, each after its [Page N] mark; source is a column whose name goes before them."""
    some = pages.where((F.col("page") >= first) & (F.col("page") <= last if last is not None else F.lit(True)))
    if source:
        body = render(some, key)
        return body.join(pages.groupBy(key).agg(F.min(source).alias("_s")), key).select(key, F.concat(F.lit("["), "_s", F.lit("]\n\n"), "text").alias("text"))
    return _rendered(some, key)


def _rendered(pages: DataFrame, key: str) -> DataFrame:
    one = F.struct("page", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")).alias("body"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["body"]), "\n\n").alias("text"))


def sentences(documents: DataFrame, least: int = 20, most: int = 500, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, sentence_index, sentence: parts after . ! ? and white space or at line ends, collapsed, of least to most characters."""
    # collapsed below the explode, so that neither the bounds nor what follows do it again
    parts = F.transform(F.split("text", r"(?<=[.!?])\s+|\n"), X.collapse)
    each = documents.select("doc_id", *keep, F.posexplode_outer(parts).alias("sentence_index", "sentence"))
    return each.where(F.length("sentence").between(least, most))


def bigram_topics(documents: DataFrame, least: int = 5, stop: tuple[str, ...] = ()) -> DataFrame:
    """phrase, hits of pairs of words with 4 letters or more that stand at least so often side by side."""
    found = documents.select(F.explode_outer(F.regexp_extract_all(X.ascii_fold(F.lower("text")), F.lit(X.WORD_PAIR), F.lit(0))).alias("m"))
    counted = found.where("m is not null").groupBy(F.regexp_replace("m", r"\s+", " ").alias("phrase")).agg(F.count("*").alias("hits"))
    return counted.where((F.col("hits") >= least) & ~F.col("phrase").isin(*stop) if stop else F.col("hits") >= least)


def canonical_topics(headings: DataFrame, bigrams: DataFrame, most: int = 80) -> DataFrame:
    """topic, weight: headings(topic) count 2 each, frequent bigrams 1; the first most by weight, then length, then name."""
    title = F.lower(F.trim(F.regexp_replace(X.collapse(F.col("topic")), r"^[0-9.)\s]+", "")))
    both = headings.select(title.alias("topic"), F.lit(2).alias("w")).unionByName(bigrams.select(F.col("phrase").alias("topic"), F.lit(1).alias("w")))
    return both.where(F.length("topic").between(4, 70)).groupBy("topic").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), F.desc(F.length("topic")), "topic").limit(most)


def cut_after(lines_: DataFrame, pattern: str, least: int, key: str = "doc_id") -> DataFrame:
    """Lines before the first line that matches pattern at least characters into the document: bibliographies."""
    w = Window.partitionBy(key).orderBy("line_index")
    offset = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flagged = lines_.withColumn("_cut", ((offset >= least) & F.col("line").rlike(pattern)).cast("int"))
    return flagged.withColumn("_cut", F.max("_cut").over(w)).where("_cut = 0").drop("_cut")


def rewrite(documents: DataFrame, rules: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Ordered (name, pattern, replacement) rules on text: the documents, and (rule, hits) over all of them."""
    c, hits = F.col("text"), []
    for name, pattern, new in rules:
        hits.append(F.coalesce(F.sum(X.count_of(c, pattern)), F.lit(0)).alias(name))
        c = F.regexp_replace(c, pattern, new)
    totals = documents.agg(*hits)
    audit = totals.select(F.expr(f"stack({len(rules)}, " + ", ".join(f"'{n}', `{n}`" for n, _, _ in rules) + ") as (rule, hits)"))
    return documents.withColumn("text", c), audit


def merge_page_text(visual: DataFrame, layer: DataFrame, least: int = 28) -> DataFrame:
    """doc_id, page, text of recognised text and the text layer: the recognised one first if it has least characters."""
    both = visual.select("doc_id", "page", F.trim("text").alias("_v")).join(layer.select("doc_id", "page", F.trim("text").alias("_l")), ["doc_id", "page"], "full")
    v, t = F.nullif(F.col("_v"), F.lit("")), F.nullif(F.col("_l"), F.lit(""))
    return both.select("doc_id", "page", F.when(F.length("_v") >= least, F.concat_ws("\n", v, t)).otherwise(F.concat_ws("\n", t, v)).alias("text"))


def positioned_lines(items: DataFrame, same: float = 3.0, gap: float = 2.0) -> DataFrame:
    """doc_id, page, line_no, line of text items (x, y, width, str): a new line where y falls by more than same, a space where x leaves a gap."""
    page = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x")
    lined = items.withColumn("_new", (F.lag("y").over(page) - F.col("y") > same).cast("int")).withColumn("line_no", F.coalesce(F.sum("_new").over(page), F.lit(0)))
    line = Window.partitionBy("doc_id", "page", "line_no").orderBy("x")
    spaced = lined.withColumn("_s", F.when(F.col("x") - (F.lag("x").over(line) + F.lag("width").over(line)) > gap, F.concat(F.lit(" "), "str")).otherwise(F.col("str")))
    return spaced.groupBy("doc_id", "page", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "_s"))), lambda s: s["_s"]), "").alias("line"))
