"""Assessment evidence and topic priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Question kinds by the verbs that announce them, and labels by rank.
QUESTION_KINDS = [("State or define", r"\b(state|define|give the definition)\b"), ("Prove or show", r"\b(prove|show that|derive)\b"), ("Calculate or estimate", r"\b(calculate|compute|estimate|find)\b"), ("Explain or interpret", r"\b(explain|interpret|compare|distinguish)\b")]
#: Marks at a word's ends, of texts folded to ASCII: all characters but a-z, 0-9, space and hyphen. They are named one by one, as Java looks
#: such a class up in a table, but asks each range of a class of ranges at each character.
MARKS = "[" + "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in "abcdefghijklmnopqrstuvwxyz0123456789 -") + "]"
RANKS = ["unknown", "low", "medium", "high", "very_high"]


def bounded(names: DataFrame, most: int = 500) -> list[str]:
    """The strings of a one-column table with at most most rows, in its order; more are an error, since they are put into every task's plan."""
    got = [r[0] for r in names.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} names: join them by key instead")
    return got


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def with_pairs(sentences: DataFrame) -> DataFrame:
    """sentences with pairs: each pair of neighbouring words, a space between them and no marks at its ends."""
    low = X.ascii_fold(F.lower("sentence"))
    # marks are taken off both sides of all words at once: one pass over the sentence instead of two expressions for each word
    left, right = F.regexp_replace(low, f"{MARKS}(?<![^ ]{MARKS}){MARKS}*", ""), F.regexp_replace(low, f"{MARKS}+(?![^ ])", "")
    sides = sentences.withColumns({"_l": F.split(left, " "), "_r": F.split(right, " ")})
    n = F.size("_l")
    # _l and _r stay columns: in a lambda an expression is computed for each element
    return sides.withColumn("pairs", F.when(n > 1, F.zip_with(F.slice("_l", F.lit(1), n - 1), F.slice("_r", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))))


def _first_sentences(hits: DataFrame, most: int) -> DataFrame:
    """doc_id, role, phrase, sentence_index, sentence of hits: the first most of each document and phrase, each once."""
    first = F.slice(F.array_sort(F.collect_set(F.struct("sentence_index", "sentence"))), 1, most)
    return hits.groupBy("doc_id", "role", "phrase").agg(first.alias("s")).select("doc_id", "role", "phrase", F.explode("s").alias("s")).select("doc_id", "role", "phrase", "s.sentence_index", "s.sentence")


def topic_evidence(sentences: DataFrame, topics: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, role, phrase, sentence_index, sentence: the first most sentences of each document that hold a topic's two words.

    topics(phrase) is joined, whatever its size. The pairs are made once for each sentence: they go through an outer explode, as
    a filter on an array would be pushed below it and have its expressions computed for each element.
    """
    pair = with_pairs(sentences).select("doc_id", "role", "sentence_index", "sentence", F.explode_outer(F.array_distinct("pairs")).alias("phrase"))
    return _first_sentences(pair.join(topics.select("phrase").distinct(), "phrase"), most)


def phrase_key(text: Column) -> Column:
    """text in lower case with single spaces; characters beyond ASCII as |, so that word borders are ASCII's."""
    return X.ascii_fold(F.lower(X.collapse(text)))


def phrases_held(rows: DataFrame, text: str, aliases: DataFrame, *keep: str) -> DataFrame:
    """keep and phrase, once for each alias that the column text holds as whole words, in any case.

    aliases(phrase, alias), of any number of words: the texts emit their runs of as many words as aliases have, and these
    are joined to the aliases; only the numbers of words in use (one short row) go to all tasks. An alias without letters or
    digits is held by nothing.
    """
    word, run = "[A-Za-z0-9_]+", F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+")
    bare = F.regexp_replace(phrase_key(F.col("alias")), "^[^a-z0-9_]+|[^a-z0-9_]+$", "")
    known = aliases.select("phrase", bare.alias("_alias")).where("_alias <> ''").distinct()
    lengths = known.agg(F.coalesce(F.array_sort(F.collect_set(X.count_of(F.col("_alias"), word).cast("int"))), F.array().cast("array<int>")).alias("_lengths"))
    # each array goes through an outer explode of its own, so that it is computed once for each row
    parts = rows.select(*keep, F.explode_outer(F.array(F.regexp_extract_all(phrase_key(F.col(text)), run, F.lit(0)))).alias("_parts")).crossJoin(F.broadcast(lengths))
    # words and what is between them take turns: the words' places follow from what the first part is
    first = F.when(F.coalesce(F.get("_parts", F.lit(0)), F.lit("")).rlike("^[a-z0-9_]"), 1).otherwise(2)
    places = F.when(F.size("_parts") >= first, F.sequence(first, F.size("_parts"), F.lit(2)))
    at = parts.select(*keep, "_parts", "_lengths", F.explode_outer(F.array(places)).alias("_at"))
    runs = F.flatten(F.transform("_at", lambda i: F.transform("_lengths", lambda n: F.array_join(F.slice(F.col("_parts"), i, 2 * n - 1), ""))))
    each = at.select(*keep, F.explode_outer(F.array_distinct(runs)).alias("_alias"))
    return each.join(known, "_alias").drop("_alias")


def alias_evidence(sentences: DataFrame, aliases: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, role, phrase, sentence_index, sentence: the first most sentences of each document that hold one of a topic's aliases(phrase, alias)."""
    return _first_sentences(phrases_held(sentences, "sentence", aliases, "doc_id", "role", "sentence_index", "sentence"), most)


def topic_sections(sections: DataFrame, aliases: DataFrame, evidence: DataFrame) -> DataFrame:
    """phrase, numbers: those of sections(doc_id, number, text) that hold an alias, of documents with evidence for the topic."""
    numbered = sections.where("number is not null and number <> ''")
    held = phrases_held(numbered, "text", aliases, "doc_id", "number")
    seen = evidence.select("doc_id", "phrase").distinct()
    return held.join(seen, ["doc_id", "phrase"], "left_semi").groupBy("phrase").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def priority_label(weight: Column, assessed: Column) -> Column:
    return F.when((weight >= 16) & assessed, "very_high").when((weight >= 10) | (assessed & (weight >= 6)), "high").when(weight >= 4, "medium").otherwise("low")


def score_label(score: Column) -> Column:
    return F.when(score >= 85, "very_high").when(score >= 65, "high").when(score >= 40, "medium").when(score > 0, "low").otherwise("unknown")


def rank_of(label: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in RANKS]), label), F.lit(0)) - 1, F.lit(0))


def topic_priorities(evidence: DataFrame) -> DataFrame:
    """phrase, weight, sentences, documents, label: each sentence counts with the weight of its document's role."""
    assessed = F.bool_or(F.col("role").isin("past_paper", "exam_guidance"))
    got = evidence.groupBy("phrase").agg(F.sum(X.role_weight(F.col("role"))).alias("weight"), F.count("*").alias("sentences"), F.count_distinct("doc_id").alias("documents"), assessed.alias("assessed"))
    return got.withColumn("label", priority_label(F.col("weight"), F.col("assessed"))).drop("assessed")


def role_frequencies(evidence: DataFrame, most: int = 4) -> DataFrame:
    """phrase and a column for each role: its sentences, at most so many of a document."""
    w = Window.partitionBy("doc_id", "phrase").orderBy("sentence_index")
    some = evidence.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return some.groupBy("phrase").agg(*[F.count_if(F.col("role") == r).alias(r) for r, _ in X.ROLES])


def question_kinds(sentences: DataFrame, kinds: list[tuple[str, str]] = QUESTION_KINDS) -> DataFrame:
    """kind, sentences, documents of assessment roles; kinds without sentences have 0."""
    asked = sentences.where(F.col("role").isin("past_paper", "problem_sheet", "exam_guidance")).withColumn("_s", X.ascii_fold(F.lower("sentence")))
    got = asked.agg(*[f.alias(f"{p}{k}") for k, (_, pattern) in enumerate(kinds) for p, f in (("n", F.count_if(F.col("_s").rlike(pattern))), ("d", F.count_distinct(F.when(F.col("_s").rlike(pattern), F.col("doc_id")))))])
    return got.select(F.expr(f"stack({len(kinds)}, " + ", ".join(f"'{name}', n{k}, d{k}" for k, (name, _) in enumerate(kinds)) + ") as (kind, sentences, documents)"))


def topic_score(flags: dict[str, Column]) -> Column:
    """0 to 100 from boolean columns paper, sheet, guidance, solutions, core, background, supporting, formula."""
    #: Fixed values.
    points = {"paper": 30, "sheet": 20, "guidance": 20, "solutions": 15, "core": 15, "background": -20, "supporting": 25, "formula": -5}
    total = sum((F.when(flags[k], p).otherwise(0) for k, p in points.items() if k in flags), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """The higher score of each name, ignoring case; a label gives the score where there is none. Ties: the first list."""
    by_label = F.when(F.col("label") == "very_high", 85).when(F.col("label") == "high", 70).when(F.col("label") == "medium", 50).when(F.col("label") == "low", 25).otherwise(0)
    both = first.select("name", "score", "label", F.lit(0).alias("_from")).unionByName(second.select("name", "score", "label", F.lit(1).alias("_from"))).withColumns({"score": F.coalesce("score", by_label), "_name": F.lower("name")})
    return both.withColumn("_k", F.row_number().over(Window.partitionBy("_name").orderBy(F.desc("score"), "_from", "name"))).where("_k = 1").select("name", "score", "label")
