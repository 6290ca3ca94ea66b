"""Topics of documents with their pages, the knowledge and structure maps of a course, and which topics go together.

What a text holds is found by priority.phrases_held or by a join within a document or course on bounded lists; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Pairs of words and phrases that are no topics, and signs of labels that aren't either.
STOP_PAIRS = ["for the", "and the", "of the", "in the", "to the", "on the", "at the", "by the", "from the", "with the"]
STOP_PHRASES = [
    "the same", "called the", "all the", "for all", "that the", "the form", "for any", "and hence", "has the", "can write", "we have", "it follows", "note that", "given that", "such that", "suppose that", "assume that", "this estimator", "that minimises", "that minimizes",
    "sampling from", "this integral", "lecture notes", "this section", "samples from", "other words", "recall that", "have access", "sample from", "would like", "true value", "this means", "this case", "have seen", "seen from", "show that",
]
NO_TOPIC = [
    r"(?i)\bconcentr\b", r"(?i)\beffectiv\b", r"\b(this|that|other)\s+\w+\s+(estimator|integral|section|case|value)\b", r"(?i)\b(blackboard|assessment|department|room\s+[a-z]?\d|@\w+\.\w+|use\s+blackboard|course\s+materials|postal|address)\b", r"\b(the|a|an)\s+(the|same|form|following)\b",
]
MOST = 80
#: What a topic is likely to be asked for, first match wins.
USES = [("calculation", r"\bkriging|likelihood|intensity\b|\bsemivariogram|covariance\b"), ("conceptual_explanation", r"\bstationarity|isotropy\b")]


def is_topic(name: Column) -> Column:
    """Whether a lower-case name with single spaces can be a topic: 5 to 72 characters, five words at most unless it has signs, none of the stop phrases."""
    out = F.length(name).between(5, 72) & ~name.isin(*STOP_PHRASES) & ((X.count_of(name, r"\S+") <= 5) | name.rlike("[=∫∑]"))
    for p in NO_TOPIC:
        out = out & ~name.rlike(p)
    return out


def _label(text: Column) -> Column:
    """A heading's topic: without its number, of more than five longer words the first five; null if too short or long."""
    bare = F.trim(F.regexp_replace(X.collapse(text), r"^[0-9.)\s]+", ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) > 1)
    cut = F.when(F.size(words) > 5, F.array_join(F.slice(words, 1, 5), " ")).otherwise(bare)
    return F.when(F.length(bare).between(4, 70), F.lower(cut))


def document_topics(documents: DataFrame, headings: DataFrame, least: int = 5, most: int = MOST) -> DataFrame:
    """doc_id, topic, weight: headings(doc_id, line) count 2 each, pairs of words seen least times 1; the first most by weight, then length, then name.

    Different headings count once each; pairs are counted in the whole text of a document.
    """
    titles = headings.select("doc_id", F.trim("line").alias("line")).where(F.length("line") > 2).distinct().select("doc_id", _label(F.col("line")).alias("topic"), F.lit(2).alias("w"))
    # the text goes through an explode of its own, so that its pairs are found once
    pairs = documents.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(X.WORD_PAIR), F.lit(0))).alias("m")).where("m is not null").groupBy("doc_id", F.regexp_replace("m", r"\s+", " ").alias("topic")).agg(F.count("*").alias("n"))
    frequent = pairs.where((F.col("n") >= least) & ~F.col("topic").isin(*STOP_PAIRS)).select("doc_id", "topic", F.lit(1).alias("w"))
    counted = titles.unionByName(frequent).where(F.col("topic").isNotNull() & is_topic(F.col("topic"))).groupBy("doc_id", "topic").agg(F.sum("w").alias("weight"))
    first = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc(F.length("topic")), "topic")
    return counted.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most).drop("_k")


def topic_pages(topics: DataFrame, headings: DataFrame) -> DataFrame:
    """topics(doc_id, topic, weight) with pages (sorted) of the headings(doc_id, page, line) that name them, and confidence.

    A heading names a topic that it holds, or that holds its first 24 characters; confidence grows with up to five headings that
    hold the topic's first 16 characters and with a second page, and stays low without pages. A document has at most MOST topics.
    """
    n = F.lower(F.trim(F.regexp_replace(X.collapse(F.col("line")), r"^[0-9.)\s]+", "")))
    h = headings.select("doc_id", "page", n.alias("_n"), F.lower(X.collapse(F.col("line"))).alias("_full")).where("_full <> ''")
    names = (F.length("_n") >= 4) & (F.contains("_n", "topic") | F.contains("topic", F.substring("_n", 1, 24)))
    held = F.contains("_full", F.substring("topic", 1, 16))
    h = h.withColumnRenamed("doc_id", "_doc")
    # one left join, so that the topics aren't counted a second time
    seen = topics.join(h, (F.col("doc_id") == F.col("_doc")) & (names | held), "left")
    got = seen.groupBy(*topics.columns).agg(F.array_sort(F.collect_set(F.when(names, F.col("page")))).alias("pages"), F.count_if(held).alias("_w"))
    sure = F.least(F.lit(0.95), F.lit(0.42) + F.lit(0.07) * F.least(F.lit(5), F.col("_w")) + F.when(F.size("pages") > 1, 0.06).otherwise(0.0))
    return got.withColumn("confidence", F.round(F.when(F.size("pages") > 0, sure).otherwise(F.least(sure, F.lit(0.36))), 4)).drop("_w")


def knowledge_map(sentences: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """course, topic, importance, evidence, likely_use: the terms(topic, lower case) that a course's sentences(course, role, doc_id, sentence_index, sentence) hold.

    A topic is core if the guidance holds it, else supporting. Its evidence are the first most sentences of the guidance that
    hold it; the notes are looked at only where a course has no guidance.
    """
    low = sentences.withColumn("_low", F.explode_outer(F.array(F.lower("sentence"))))
    guides = F.col("role") == "exam_guidance"
    held = low.join(terms.select("topic").distinct(), F.contains("_low", "topic"))  # terms are a short list, compared in each task
    spot = F.struct("doc_id", "sentence_index", "sentence")
    first = lambda c: F.slice(F.transform(F.array_sort(F.collect_set(c)), lambda s: s["sentence"]), 1, most)
    by = held.groupBy("course", "topic").agg(F.bool_or(guides).alias("_core"), first(F.when(guides, spot)).alias("_g"), first(F.when(~guides, spot)).alias("_n"))
    guided = sentences.where(guides).select("course").distinct().withColumn("_guided", F.lit(True))
    use = F.when(F.col("topic").rlike(USES[0][1]), USES[0][0]).when(F.col("topic").rlike(USES[1][1]), USES[1][0]).otherwise("definition_recall")
    got = by.join(guided, "course", "left")
    return got.select("course", "topic", F.when(F.col("_core"), "core").otherwise("supporting").alias("importance"), F.when(F.col("_guided"), F.col("_g")).otherwise(F.col("_n")).alias("evidence"), use.alias("likely_use"))


def structure_map(sections: DataFrame, knowledge: DataFrame, terms: DataFrame) -> DataFrame:
    """sections(course, doc_id, number, title, text, start, end) with summary and importance: that of the first topic, in the order of terms(topic, position), that the section holds, else unknown."""
    ranked = knowledge.join(terms.select("topic", "position"), "topic").select("course", "topic", "position", "importance")
    keys = ["course", "doc_id", "number", "title", "start", "end"]
    s = sections.withColumns({"_low": F.explode_outer(F.array(F.lower("text"))), "_id": F.xxhash64(*keys, "text")})
    hit = s.join(ranked, "course").where(F.contains("_low", "topic")).groupBy("_id", "doc_id").agg(F.min(F.struct("position", "importance")).alias("_m"))
    got = s.join(hit, ["_id", "doc_id"], "left")
    return got.select(*keys, F.trim(F.regexp_replace(F.substring("text", 1, 240), r"\s+", " ")).alias("summary"), F.coalesce("_m.importance", F.lit("unknown")).alias("importance"))


def related_items(topics: DataFrame, items: DataFrame) -> DataFrame:
    """course, topic, items: the sorted ids of items(course, id, text) that hold each of topics(course, topic)."""
    low = items.withColumn("_low", F.explode_outer(F.array(F.lower("text"))))
    hit = low.join(topics.select("course", "topic").distinct(), "course").where(F.contains("_low", "topic"))
    return hit.groupBy("course", "topic").agg(F.array_sort(F.collect_set("id")).alias("items"))


def related_topics(held: DataFrame, most: int = 5) -> DataFrame:
    """topic, related, weight, k: for each topic the first most others by the number of texts that hold both, of held(id, topic).

    A text's pairs come from its own topics, a short list; they are counted before the shuffle, and only the counts are ranked, a
    common topic's by hash of the other first, so that no task ranks all of them.
    """
    sets = held.groupBy("id").agg(F.array_sort(F.collect_set("topic")).alias("t"))
    a = sets.where(F.size("t") > 1).select("t", F.explode("t").alias("topic"))
    weights = a.select("topic", F.explode("t").alias("related")).where("topic <> related").groupBy("topic", "related").agg(F.count("*").alias("weight"))
    order = [F.desc("weight"), "related"]
    part = weights.withColumn("_p", F.pmod(F.xxhash64("related"), F.lit(16)))
    some = part.withColumn("_k", F.row_number().over(Window.partitionBy("topic", "_p").orderBy(*order))).where(F.col("_k") <= most).drop("_k", "_p")
    return some.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).where(F.col("k") <= most)
