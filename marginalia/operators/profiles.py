"""The profile of each document as one wide row, put together from its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X

from . import contents, profile, structure, topics


def chapter_map(lines: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, position, title, start, end, source: chapters from markers, or where these are fewer than two from the contents."""
    last = lines.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    marks = structure.chapters_from_markers(found, last).select("doc_id", F.col("number").cast("int").alias("position"), "title", "start", "end")
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda s: s["line"]), "\n").alias("text"))
    rows = contents.contents_entries(pages).select("doc_id", "position", "title", "start", "end")
    return structure.best_source([("markers", marks), ("contents", rows)])


def document_profiles(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each of files(doc_id, name): title and its reason, front matter with people and notes, type, flags, notation,
    chapters and their source, topics with pages, pages of noise, confidence, whether contents couldn't be read, warnings.

    lines(doc_id, page, line_index, line, layer). What a document hasn't is null or an empty array; a document without
    lines has a title from its file alone.
    """
    found = structure.headings(lines)
    front, early = profile.front_matter(lines), profile.early_title(lines)
    # titles carry the rest of the front matter, so that it is read once
    titles = profile.chosen_title(front, early, found, files, tuple(c for c in front.columns if c not in ("doc_id", "title")))
    chapters = chapter_map(lines, found)
    spot = F.struct("position", "title", "start", "end")
    mapped = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(spot)).alias("chapters"), F.first("source").alias("chapter_source"))
    texts = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda s: s["line"]), "\n").alias("text"))
    heads = structure.unique_headings(found.where("rejection_reason is null")).select("doc_id", "page", "line")
    entries = topics.topic_pages(topics.document_topics(texts, heads), heads)
    row = F.struct((-F.col("weight")).alias("_w"), (-F.length("topic")).alias("_n"), "topic", "weight", "pages", "confidence")
    named = entries.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda s: F.struct(s["topic"].alias("topic"), s["weight"].alias("weight"), s["pages"].alias("pages"), s["confidence"].alias("confidence"))).alias("topics"))
    signs = profile.notation(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("meaning", "hits"))).alias("notation"))
    noise = profile.noise_pages(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "score", "examples"))).alias("noise_pages"))
    toc = chapters.where("source = 'contents'").select("doc_id").distinct().withColumn("contents_found", F.lit(True))
    failed = profile.contents_failed(lines, chapters).withColumn("contents_failed", F.lit(True))
    out = files.select("doc_id", "name")
    for part in (titles, profile.flags(lines), mapped, named, signs, noise, toc, failed):
        out = out.join(part, "doc_id", "left")
    kinds = {f.name: f.dataType for f in out.schema.fields}
    lists = ("people", "admin_notes", "chapters", "topics", "notation", "noise_pages")
    out = out.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in lists} | {c: F.coalesce(c, F.lit(False)) for c in ("contents_found", "contents_failed")})
    sure = profile.confidence(F.col("title").isNotNull(), F.size("chapters"), F.col("contents_found"), F.size("topics"))
    few = F.when(F.col("contents_found") & (F.size("chapters") < 3), "contents with fewer than three rows")
    return out.withColumns({"confidence": sure, "warnings": F.array_compact(F.array(few, F.when(F.col("contents_failed"), "contents could not be read")))})

