"""Headings, contents, chapters, section blocks and profiles of documents, from their line table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Kind, level and pattern of a heading line, first match wins.
HEADING_RULES = [
    ("chapter", 1, r"(?i)^chapter\s*[0-9]+(\.[0-9]+)?\s*([.:]?\s+\S.*)?$"), ("subsubsection", 4, r"^([0-9]+\.){3}[0-9]+\s+\S"), ("subsection", 3, r"^([0-9]+\.){2}[0-9]+\s+\S"), ("section", 2, r"^[0-9]+\.[0-9]+\s+\S"), ("chapter", 1, r"^[0-9]{1,2}\s+[A-Za-z(].{3,120}$"),
    ("definition", 4, r"(?i)^definition\b"), ("lemma", 4, r"(?i)^lemma\s+[0-9]"), ("proposition", 4, r"(?i)^proposition\s+[0-9]"), ("theorem", 4, r"(?i)^theorem\s+[0-9]"), ("corollary", 4, r"(?i)^corollary\s+[0-9]"), ("proof", 5, r"(?i)^proof([.:]?\s*$|[.:]\s+\S.{0,150}$)"),
    ("worked_example", 4, r"(?i)^worked\s+example"), ("example", 4, r"(?i)^example\b"), ("exercise", 4, r"(?i)^exercise\b"), ("question", 4, r"(?i)^(question\b|problem\s+[0-9])"), ("solution", 4, r"(?i)^solution\b"), ("algorithm", 4, r"(?i)^algorithm\b"), ("remark", 4, r"(?i)^remark\b"),
    ("exercise", 4, r"(?i)^(show|check)\s+that\b|^derive\b|^determine\s+whether\b"), ("section", 2, r"^(?=.{8,72}$)(?!.*[0-9]{4})[A-Z][A-Z0-9]+(\s+[A-Z0-9]+){1,9}$"),
]
#: Fixed value: what the first three characters of a line match if one of the rules does; it spares most lines the rules.
STARTS = r"(?i)^(cha|def|lem|pro|the|cor|wor|exa|exe|que|sol|alg|rem|sho|che|der|det)|^[0-9]|^[A-Z][A-Z0-9]"
FORMAL = ("definition", "lemma", "proposition", "theorem", "corollary")


def _kind(t: Column, part: int) -> Column:
    out = F.when(t.rlike(HEADING_RULES[0][2]), HEADING_RULES[0][part])
    return F.when(F.left(t, F.lit(3)).rlike(STARTS), reduce(lambda c, r: c.when(t.rlike(r[2]), r[part]), HEADING_RULES[1:], out))


#: Signs of lines that aren't headings, by the reason given, first match wins; and what the confidence of a kind is.
FOOTER = r"(?i)\b(page\s+\d+\s+of\s+\d+|copyright|all\s+rights\s+reserved|lecture\s+notes\s+only)\b|©"
AXIS = r"^[\d.,\s\-–—]{6,}$|^(0\.\d|1\.\d|-?\d+\.\d)\s+(0\.\d|1\.\d|-?\d+\.\d)(\s+(0\.\d|1\.\d|-?\d+\.\d)){2,}"
STRONG = r"(?i)^(Chapter\s*\d+|(\d+\.){1,3}\d+\s+\S|Definition|(Lemma|Theorem|Proposition|Corollary|Problem)\s+\d+|Proof|Worked\s+example|Example|Exercise|Question|Solution|Remark|Algorithm)"
CONFIDENCE = {"chapter": 0.9, "section": 0.84, "subsection": 0.84, "subsubsection": 0.84, "proof": 0.8, "theorem": 0.8, "definition": 0.8}


def heading_noise(t: Column) -> Column:
    """True for lines that hardly are headings: too long, mostly signs, footers, only marks, few letters."""
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda p: X.count_of(t, p) / n
    return (t == "") | (F.length(t) > 180) | ((share(r"[=∑∫√^_∇∂‰∞±]") > 0.22) & (F.length(t) > 80)) | (t.rlike(FOOTER) & (F.length(t) < 90)) | t.rlike(r"^[^\w\s]{3,}$") | ((F.length(t) > 40) & (share("[A-Za-z]") < 0.08))


def headings(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, line_index, line, layer) that look like headings: kind, level, confidence and rejection_reason (null: accepted)."""
    t = F.trim("line")
    n = F.length(t)
    share = lambda p: X.count_of(t, p) / F.greatest(n, F.lit(1))
    body = (n >= 70) & ~t.rlike(r"(?i)^(theorem|lemma|definition|proposition|chapter)\b") & (((X.count_of(t, r"\S+") > 22) & t.rlike(r"[.;:]\s")) | ((n > 110) & t.rlike("^[a-z]") & (X.count_of(t, r",\s") >= 2)))
    caption = t.rlike(r"(?i)^(figure|fig\.|table)\s+\d+")
    reason = X.first_match([
        ("page_number", t.rlike(r"^\s*\d{1,4}\s*$")), ("ocr_noise", (F.col("layer") == "noise") & ~t.rlike(STRONG)), ("figure_axis_noise", t.rlike(AXIS)),
        ("table_caption_context", caption & t.rlike(r"(?i)^table\b")), ("figure_caption_context", caption), ("too_many_numbers", (X.count_of(t, r"\d") >= 14) & (share(r"\d") > 0.35)),
        ("too_many_symbols", (share(r"[^A-Za-z0-9\s.,;:()\-]") > 0.28) & (X.count_of(t, r"\S*[A-Za-z]{3,}\S*") < 4)), ("footer_or_header", t.rlike(FOOTER) & (n < 100)), ("figure_axis_noise", heading_noise(t)), ("body_sentence", body),
    ], "")
    base = reduce(lambda c, k: c.when(F.col("kind") == k[0], k[1]), CONFIDENCE.items(), F.when(F.lit(False), 0.0)).otherwise(0.72)
    found = lines.withColumns({"kind": _kind(t, 0), "level": _kind(t, 1), "rejection_reason": F.nullif(reason, F.lit(""))}).where("kind is not null")
    return found.withColumns({"line": t, "confidence": F.round(base - F.when(n > 120, 0.12).otherwise(0), 2)})


def unique_headings(found: DataFrame) -> DataFrame:
    """The first heading of each page, line, kind and beginning."""
    w = Window.partitionBy("doc_id", "page", "line_index", "kind", F.lower(F.substring("line", 1, 80))).orderBy(F.desc("confidence"))
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def joined_titles(lines: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, line_index, line of bare "Chapter N" lines with the title lines right after them, at most so many."""
    w = Window.partitionBy("doc_id").orderBy("line_index")
    out, going = F.trim("line"), F.lit(True)
    cols = {f"_n{k}": F.trim(F.lead("line", k).over(w)) for k in range(1, most + 1)}
    bare = lines.withColumns(cols).where(F.trim("line").rlike(r"(?i)^chapter\s*[0-9]+(\.[0-9]+)?\s*$"))
    for k in range(1, most + 1):
        c = F.col(f"_n{k}")
        title = F.length(c).between(3, 100) & (X.count_of(c, r"\S+") <= 14) & ~c.rlike(r"(?i)^([0-9]+\.[0-9]|chapter\s*[0-9]|(theorem|lemma|proposition|definition|corollary|figure|table)\b|[-*•]\s|[0-9]+\s*\)\s)") & ~(c.rlike("^[a-z]") & (F.length(c) > 40))
        going = going & F.coalesce(title | (c == ""), F.lit(False))
        out = F.when(going & (c != ""), F.concat(out, F.lit(" "), c)).otherwise(out)
    return bare.select("doc_id", "line_index", X.collapse(out).alias("line"))


def section_headings(lines: DataFrame) -> DataFrame:
    """doc_id, number, title, line_index of numbered section lines; years aren't numbers of sections."""
    t = F.trim("line")
    got = lines.select("doc_id", "line_index", F.regexp_extract(t, r"^([0-9]{1,2}(\.[0-9]{1,3})+)\s+([A-Za-z(].*)$", 1).alias("number"), F.regexp_extract(t, r"^([0-9]{1,2}(\.[0-9]{1,3})+)\s+([A-Za-z(].*)$", 3).alias("title"))
    return got.where("number <> ''").withColumn("title", F.regexp_replace("title", r"\s*\.{2,}\s*[0-9]*$", ""))


#: Where the text of a section begins inside a title, what titles aren't, and labels that are models.
BODY = r"(?i)\b(we introduce|we consider|recall that|this section|let\s+\w+\s+be)\b"
NOT_TITLE = r"(?i)^(definition|theorem|lemma|proposition|corollary|remark|example|exercise|proof|algorithm)\b"
MODEL = r"(?i)^(MA|AR|ARMA|ARCH|ARIMA|VAR|GLP|General\s+linear\s+process)\s*\([^)]{1,24}\)\s*$"


def _title(c: Column) -> Column:
    """A title without the body text glued to it, at most 160 characters."""
    whole = X.collapse(c)
    at = F.regexp_instr(whole, F.lit(BODY)) - 1
    return F.when(at >= 12, F.trim(F.substring(whole, F.lit(1), at))).when(F.length(whole) > 160, F.concat(F.substring(whole, 1, 157), F.lit("…"))).otherwise(whole)


def structural_headings(lines: DataFrame) -> DataFrame:
    """doc_id, line_index, kind, label, title, level of chapters, numbered sections, worked examples and model labels.

    A bare chapter takes the next line as its title. Numbers on lines of their own are sections from 1 to 60; a line has one heading.
    """
    w = Window.partitionBy("doc_id").orderBy("line_index")
    t, nxt = F.trim("line"), F.trim(F.lead("line").over(w))
    got = lines.withColumns({"t": t, "_next": nxt}).where(F.length("t") >= 4)
    part = lambda p, k: F.regexp_extract("t", p, k)
    chapter, bare = r"(?i)^Chapter\s+(\d{1,2}(?:\.\d+)?)\s*[.:]?\s+(.+)", r"(?i)^Chapter\s+(\d{1,2}(?:\.\d+)?)\s*$"
    major, minor, worked = r"^(\d{1,2})\s+([A-Za-z0-9\u00C0-\u024F()].{3,180})$", r"^(\d{1,2}\.\d{1,2}(?:\.\d{1,2})?)\s+(.+)", r"(?i)^Worked\s+example\s*[.:]?\s*(.*)$"
    follows = F.length("_next").between(4, 199) & ~F.col("_next").rlike(r"(?i)^\[Page\b|^\d+\.\d+|^Chapter\s+")
    clean = lambda c: _title(F.regexp_replace(c, r"^[\s.:)-]+", ""))
    row = lambda kind, label, title, level: F.struct(F.lit(kind).alias("kind"), label.alias("label"), title.alias("title"), (F.lit(level) if isinstance(level, int) else level).alias("level"))
    named = lambda p: F.concat(F.lit("Chapter "), part(p, 1))
    rest = F.trim(part(worked, 1))
    is_major = F.col("t").rlike(major) & part(major, 1).try_cast("int").between(1, 60) & ~F.col("t").rlike(r"^\d{1,2}\.\d")
    h = F.when(F.col("t").rlike(bare), F.when(follows, row("chapter", named(bare), _title(F.col("_next")), 1))).when(F.col("t").rlike(chapter), row("chapter", named(chapter), _title(part(chapter, 2)), 1))
    h = h.when(is_major, row("section", part(major, 1), clean(part(major, 2)), 2)).when(F.col("t").rlike(minor), row("section", part(minor, 1), clean(part(minor, 2)), F.when(part(minor, 1).rlike(r"\..*\."), 3).otherwise(2)))
    h = h.when(F.col("t").rlike(worked) & (F.length("t") < 220), row("section", F.lit("Worked example"), _title(F.when(F.length(rest) >= 4, rest).otherwise("Worked example")), 2)).when(F.col("t").rlike(MODEL) & (F.length("t") < 120), row("section", F.upper(part(MODEL, 1)), F.col("t"), 3))
    found = got.select("doc_id", "line_index", h.alias("h")).where("h is not null").select("doc_id", "line_index", "h.*")
    return found.where((F.length("title") >= 4) & ((F.col("kind") == "chapter") | ~F.col("title").rlike(NOT_TITLE)))


def chapter_context(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines(doc_id, line_index) with chapter and chapter_title of the last chapter heading at or before them, and section, the last heading's label."""
    marks = found.groupBy("doc_id", "line_index").agg(F.min(F.struct("level", "kind", "label", "title")).alias("h"))
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    is_chapter = F.col("h.kind") == "chapter"
    last = lambda c: F.last(c, True).over(w)
    both = lines.join(marks, ["doc_id", "line_index"], "left")
    return both.withColumns({"chapter": F.coalesce(last(F.when(is_chapter, F.col("h.label"))), F.lit("")), "chapter_title": F.coalesce(last(F.when(is_chapter, F.col("h.title"))), F.lit("")), "section": last(F.col("h.label"))}).drop("h")


def version_key(number: Column) -> Column:
    """Sorts 3.10 after 3.9."""
    return F.transform(F.split(number, r"\."), lambda p: p.try_cast("int"))


def merged_sections(sections: DataFrame) -> DataFrame:
    """number, title: the longest title of each number over all files, in version order."""
    got = sections.groupBy("number").agg(F.max(F.struct(F.length("title").alias("n"), "title")).alias("m"))
    return got.select("number", F.col("m.title").alias("title")).orderBy(version_key(F.col("number")))


def contents(lines: DataFrame, pages: int = 15) -> DataFrame:
    """doc_id, label, title, page of rows of a table of contents on the first pages: dot leaders, titles that wrap, page numbers on the next line.

    The longest title of a label; documents with fewer than two rows have none.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "line_index")
    early = lines.where(F.col("page") <= pages).withColumns({"t": X.collapse(F.col("line")), "_prev": X.collapse(F.lag("line").over(w)), "_next": X.collapse(F.lead("line").over(w))})
    row = r"^([0-9]{1,2}(?:\.[0-9]+)*)?\s*(.{3,160}?)\s*(?:\.{2,}|…|(?:\s\.){3,})\s*([0-9]{1,3})$"
    part = lambda k: F.regexp_extract("t", row, k)
    alone = F.col("t").rlike(r"^[0-9]{1,2}(\.[0-9]+)*\s+[A-Za-z].{2,160}$") & F.col("_next").rlike(r"^[0-9]{1,3}$")
    wrapped = F.when(F.col("_prev").rlike(r"^[0-9]{1,2}(\.[0-9]+)*\s+[A-Za-z][^.]*$") & (part(1) == ""), F.col("_prev"))
    label = F.when(alone, F.regexp_extract("t", r"^(\S+)", 1)).otherwise(F.coalesce(F.regexp_extract(wrapped, r"^(\S+)", 1), part(1)))
    title = F.when(alone, F.regexp_extract("t", r"^\S+\s+(.*)$", 1)).otherwise(F.concat_ws(" ", F.regexp_extract(wrapped, r"^\S+\s+(.*)$", 1), part(2)))
    page = F.when(alone, F.col("_next")).otherwise(part(3))
    rows = early.where(F.col("t").rlike(row) | alone).select("doc_id", "page", "line_index", label.alias("label"), F.trim(title).alias("title"), page.try_cast("int").alias("start")).where(~F.lower("title").isin("contents", "page"))
    named = rows.withColumn("label", F.when(F.col("label") == "", F.concat(F.lit("u"), F.row_number().over(Window.partitionBy("doc_id", F.col("label") == "").orderBy("page", "line_index")))).otherwise(F.col("label")))
    best = named.groupBy("doc_id", "label").agg(F.max(F.struct(F.length("title").alias("n"), "title", "start")).alias("m"))
    return best.select("doc_id", "label", F.col("m.title").alias("title"), F.col("m.start").alias("start"), F.count("*").over(Window.partitionBy("doc_id")).alias("_n")).where("_n >= 2").drop("_n")


def chapters_from_markers(found: DataFrame, last_page: DataFrame) -> DataFrame:
    """doc_id, number, title, start, end: the first chapter heading of each number, at least two, each to the page before the next."""
    number = F.coalesce(F.nullif(F.regexp_extract("line", r"(?i)^chapter\s*([0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^([0-9]{1,2})\s", 1), F.lit(""))).try_cast("int")
    first = Window.partitionBy("doc_id", "number").orderBy("page", "line_index")
    marks = found.where("kind = 'chapter' and rejection_reason is null").withColumn("number", number).where("number is not null").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    marks = marks.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).where("_n >= 2").join(last_page, "doc_id")
    nxt = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page", "line_index"))
    title = F.trim(F.regexp_replace("line", r"(?i)^(chapter\s*[0-9]+(\.[0-9]+)?|[0-9]{1,2})\s*[.:]?\s*", ""))
    return marks.select("doc_id", "number", title.alias("title"), F.col("page").alias("start"), F.greatest("page", F.coalesce(nxt - 1, "last_page")).alias("end"))


def best_source(ranked: list[tuple[str, DataFrame]], least: int = 2) -> DataFrame:
    """Per document the rows of the first source in the list that has at least so many, with column source."""
    every = reduce(DataFrame.unionByName, [df.withColumns({"source": F.lit(n), "_rank": F.lit(k)}) for k, (n, df) in enumerate(ranked)])
    enough = every.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "_rank"))).where(F.col("_n") >= least)
    return enough.withColumn("_best", F.min("_rank").over(Window.partitionBy("doc_id"))).where("_rank = _best").drop("_rank", "_n", "_best")


def titled(chapters: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters with the contents' title where their own is missing or shorter than four characters."""
    names = toc.select("doc_id", F.regexp_extract("label", r"^([0-9]+)$", 1).try_cast("int").alias("number"), F.col("title").alias("_t")).where("number is not null")
    return chapters.join(names, ["doc_id", "number"], "left").withColumn("title", F.when(F.length("title") < 4, F.coalesce("_t", "title")).otherwise(F.col("title"))).drop("_t")


#: Cues of a block's lines, first match wins, with how many are kept.
CUES = [("definitions", r"(?i)^definition\b|\bis (called|defined as)\b", 40), ("theorems", r"(?i)^(theorem|lemma|proposition|corollary)\b", 40), ("proofs", r"(?i)^proof\b", 40), ("worked_examples", r"(?i)^worked example", 25), ("examples", r"(?i)^example\b", 40), ("exercises", r"(?i)^(exercise|question|problem)\b", 80), ("derivations", r"(?i)\b(derive|derivation)\b", 25), ("formulas", r"[=∑∫√≤≥]|\\(frac|sum|int|sqrt)", 80)]


def inline_cues(block_lines: DataFrame, *block: str) -> DataFrame:
    """block, cue, lines of block_lines(block, line_index, line): each line under its first cue, repeated ones once, in order."""
    t = F.trim("line")
    named = block_lines.where(t != "").withColumn("cue", X.first_match([(n, t.rlike(p)) for n, p, _ in CUES], "")).where("cue <> ''").withColumn("line", t)
    once = named.withColumn("_k", F.row_number().over(Window.partitionBy(*block, "cue", F.lower(F.substring("line", 1, 120))).orderBy("line_index"))).where("_k = 1")
    cap = reduce(lambda c, r: c.when(F.col("cue") == r[0], r[2]), CUES[1:], F.when(F.col("cue") == CUES[0][0], CUES[0][2]))
    few = once.withColumn("_k", F.row_number().over(Window.partitionBy(*block, "cue").orderBy("line_index"))).where(F.col("_k") <= cap)
    return few.groupBy(*block, "cue").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda s: s["line"]).alias("lines"))
