"""Phrases of any length in sentences, against the rule as a regular expression, and the plans of evidence."""

import random
import re

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import priority

SENTENCES = "doc_id long, role string, sentence_index int, sentence string"


def test_phrases_equal_the_rule(spark):
    random.seed(8)
    words = ["car", "CAR model", "semi-variogram", "variogram", "point process", "Point  process", "log-likelihood", "x_1", "é", "(car)", "sar.", "covariance matrix, valid", "a", ""]
    texts = [random.choice(["", " ", "  "]).join([]) + " ".join(random.choice(words) for _ in range(random.randrange(8))) for _ in range(300)] + [None, "", "cars", "scar model", "CAR-model"]
    aliases = [("CAR", "car"), ("CAR", "car model"), ("V", "semi-variogram"), ("V2", "variogram"), ("P", "point process"), ("L", " Log-likelihood "), ("U", "x_1"), ("A", "a"), ("M", "covariance matrix, valid"), ("none", "..."), ("none", None), ("N", "process car model")]
    got = priority.phrases_held(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t", spark.createDataFrame(aliases, "phrase string, alias string"), "id").distinct()
    want = set()
    for k, t in enumerate(texts):
        plain = re.sub(r"[^\x00-\x7F]", "|", re.sub(r"\s+", " ", t or "").strip().lower())
        for name, alias in aliases:
            if alias and alias.strip(" .") and re.search(rf"\b{re.escape(alias.strip().lower())}\b", plain, re.A):
                want.add((k, name))
    assert {(r.id, r.phrase) for r in got.collect()} == want


def test_alias_evidence_and_sections(spark):
    rows = [(0, "past_paper", k, f"Sentence {k} on a simple Kriging estimate") for k in range(7)] + [(1, "exam_guidance", 0, "BLUP, or ordinary kriging"), (1, "exam_guidance", 1, "nothing of it")]
    aliases = spark.createDataFrame([("Kriging", "kriging"), ("Kriging", "best linear unbiased"), ("Kriging", "blup"), ("Other", "unknown thing")], "phrase string, alias string")
    found = priority.alias_evidence(spark.createDataFrame(rows, SENTENCES), aliases)
    assert sorted((r.doc_id, r.sentence_index) for r in found.collect()) == [(0, k) for k in range(5)] + [(1, 0)]
    sections = spark.createDataFrame([(0, "3.10", "the best linear unbiased one"), (0, "2", "kriging"), (0, "", "kriging"), (0, None, "kriging"), (5, "9", "kriging"), (1, "2", "BLUP")], "doc_id long, number string, text string")
    assert [(r.phrase, r.numbers) for r in priority.topic_sections(sections, aliases, found).collect()] == [("Kriging", ["2", "3.10"])]
    none = aliases.limit(0)
    assert priority.alias_evidence(spark.createDataFrame(rows, SENTENCES), none).collect() == [] and priority.alias_evidence(spark.createDataFrame([], SENTENCES), aliases).collect() == []


def test_no_expression_is_repeated_for_each_word(spark):
    """In the optimized plans no lambda holds a regular expression, and the pairs' expressions stand once."""
    sentences = spark.createDataFrame([(0, "r", 0, "one two three")], SENTENCES)
    topics = spark.createDataFrame([("one two",)], "phrase string")
    plan = priority.topic_priorities(priority.topic_evidence(sentences, topics))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4 and not re.search(r"lambdafunction\([^\n]*regexp_(replace|extract)[^\n]*lambda", plan)
    held = priority.phrases_held(sentences, "sentence", topics.selectExpr("phrase", "phrase as alias"), "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert held.count("[A-Za-z0-9_]+|[^A-Za-z0-9_]+, 0)") == 1  # the texts are cut once; the aliases' words are counted elsewhere


def test_pairs_equal_the_rule_in_any_marks(spark):
    """Marks at both ends of words, alone, in a row and inside words: the pairs are those of the rule, word by word."""
    random.seed(5)
    texts = ["".join(random.choice(["ab", "Zq", "7", " ", " ", "-", ".", "(", "'", "|", "é", "\x7f", "[", "{", "_", "--x", "!? "]) for _ in range(random.randrange(1, 24))) for _ in range(500)] + ["", " ", "one", "a b", "! !", "( a ) ( b )"]
    got = priority.with_pairs(spark.createDataFrame([(0, "r", k, t) for k, t in enumerate(texts)], SENTENCES)).select("sentence_index", "pairs").collect()
    for k, pairs in got:
        w = re.sub(r"[^\x00-\x7F]", "|", texts[k].lower()).split(" ")
        want = [re.sub("^[^a-z0-9-]+", "", a) + " " + re.sub("[^a-z0-9-]+$", "", b) for a, b in zip(w, w[1:])]
        assert (pairs or []) == want, texts[k]


def test_word_pairs_equal_the_rule(spark):
    random.seed(6)
    texts = ["".join(random.choice(["abcd", "ab", "word-", "-", " ", " ", "  ", "\n", "x", "1", "_", ".", "|", "long-word", "Z"]) for _ in range(random.randrange(1, 30))) for _ in range(500)]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", F.regexp_extract_all("t", F.lit(X.WORD_PAIR), F.lit(0)).alias("m")).collect()
    assert all(r.m == [m.group(0) for m in re.finditer(r"\b([a-z][a-z-]{3,})\s+([a-z][a-z-]{3,})\b", texts[r.k], re.A)] for r in got)
    assert sum(len(r.m) for r in got) > 50


def test_classes_of_marks_and_words_are_tables():
    """No range stands in the classes that every character of a text is compared with: they cost several times as much."""
    assert not re.search(r"[a-z0-9]-[a-z0-9]", priority.MARKS) and "a-z-" not in X.WORD_PAIR
