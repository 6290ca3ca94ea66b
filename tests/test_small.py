"""The small functions: each once, on own rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import candidates, gates, grounding, items, lines, priority, similarity, spans, structure
from marginalia.sources import files
from marginalia.streaming import review_state


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    assert one(spark, X.safe_name(F.lit(" a b/c.pdf "))) == "a-b-c.pdf"
    assert [one(spark, X.half_up(F.lit(v))) for v in (2.5, -2.5, 1.4)] == [3, -2, 1]
    assert [one(spark, priority.rank_of(F.lit(v))) for v in ("low", "very_high", "none")] == [1, 4, 0]
    assert one(spark, grounding.folded(F.lit("The  Monte Carlo variance"))) == "the mc var"
    assert [one(spark, gates.adaptive_least(F.lit(n))) for n in (3, 15, 51)] == [8, 15, 25]
    assert [one(spark, spans.least_blocks(F.lit(n))) for n in (30, 31, 90, 900)] == [0, 5, 13, 30]
    assert one(spark, candidates.compact(F.lit("One ends. Two goes on"), 14)) == "One ends." and one(spark, candidates.compact(F.lit("abcdef"), 3)) == "abc"
    kinds = [one(spark, candidates.formula_kind(F.lit(t))) for t in ("123 456 789 012 345", "x = 1", "Bayes rule", "a " * 80)]
    assert kinds == ["broken_math", "raw_equation", "formula_name", "concept_formula"]


def test_maps_of_roles(spark):
    rows = spark.createDataFrame([("a", "past_paper"), ("a", "past_paper"), ("a", None)], "k string, role string")
    got = rows.groupBy("k").agg(X.role_counts(F.col("role")).alias("m")).first()["m"]
    assert got["past_paper"] == 2 and sum(got.values()) == 2 and len(got) == len(X.ROLES)


def test_topics_and_cues(spark):
    heads = spark.createDataFrame([("1.2 Random walks",), ("Games",)], "topic string")
    pairs = spark.createDataFrame([("random walks", 9), ("fair games", 7)], "phrase string, hits long")
    assert [tuple(r) for r in lines.canonical_topics(heads, pairs).collect()] == [("random walks", 3), ("games", 2), ("fair games", 1)]
    table = lines.lines(spark.createDataFrame([(1, "Theorem 1\nDefinition 2\nProof\nx = 1")], "doc_id long, text string"))
    cues = {r["cue"]: r["lines"] for r in structure.inline_cues(table, "doc_id").collect()}
    assert cues == {"definitions": ["Definition 2"], "theorems": ["Theorem 1"], "proofs": ["Proof"], "formulas": ["x = 1"]}


def test_patterns_definitions_steps(spark):
    docs = spark.createDataFrame([(1, "the variance of a walk is V"), (2, "variance")], "doc_id long, text string")
    rules = spark.createDataFrame([("Variance", r"\bvariance\b", "walk"), ("V", "V", None)], "name string, pattern string, context string")
    assert {tuple(r) for r in candidates.pattern_hits(docs, rules).collect()} == {(1, "Variance"), (1, "V")}
    with pytest.raises(ValueError):
        candidates.pattern_hits(docs, rules, most=1)
    said = spark.createDataFrame([(1, "We define a fair game as one without gain."), (1, "This is called a fair game."), (1, "A walk is defined as a sum.")], "doc_id long, sentence string")
    assert {(r["term"], r["sentence"]) for r in candidates.definition_sentences(said).collect()} == {("fair game", "We define a fair game as one without gain."), ("walk", "A walk is defined as a sum.")}
    blocks = spark.createDataFrame([(1, 1, "1: add all 2: take half"), (1, 2, "First do it. Then stop.")], "doc_id long, run int, body string")
    assert [(r["run"], r["step"], r["text"]) for r in candidates.steps(blocks).orderBy("run", "step").collect()] == [(1, 1, "add all"), (1, 2, "take half"), (2, 1, "First do it."), (2, 2, "Then stop.")]
    long_ = spark.createDataFrame([(1, 1, "(a) " + "w " * 450 + "(b) more"), (1, 2, "(a) x (b) y")], "doc_id long, run int, body string")
    assert {(r["run"], r["part"]) for r in candidates.sub_questions(long_, 900).collect() if r["text"].strip()} >= {(2, 0)} and candidates.sub_questions(long_, 900).where("run = 1").count() == 2


def test_health_and_files(spark):
    stages = spark.createDataFrame([("a", True, 1), ("c", False, 3), ("b", False, 2)], "stage string, passed boolean, position int")
    assert tuple(gates.health(stages).first()) == (False, "b,c")
    assert gates.report(gates.gate(stages, [(~F.col("passed"), "reject", "failed")])).where("decision = 'reject'").first()["share"] == pytest.approx(0.666667)
    rows = spark.createDataFrame([("j", "u", "p", "n", "past_paper", 50 << 20), ("j", "u", "p", "m", "odd", 1), ("j", "", "p", "m", "odd", 1)], "job_id string, url string, path string, name string, role string, size long")
    assert {(r["name"], r["role"], r["mode"]) for r in files.manifest(rows).collect()} == {("n", "past_paper", "fast"), ("m", "other", "fast")}
    notes = spark.createDataFrame([("T", "a\n b")], "title string, statement string")
    assert files.as_markdown(notes).first()[0] == "- **T**: a b"
    parts = {"past_paper": spark.createDataFrame([(1, None), (2, "other")], "doc_id long, role string"), "lecture_notes": spark.createDataFrame([(3,)], "doc_id long")}
    assert {tuple(r) for r in files.union_by_role(parts).collect()} == {(1, "past_paper"), (2, "other"), (3, "lecture_notes")}


def test_ranges_shorten_and_numbers(spark):
    chapters = spark.createDataFrame([(1, 1, 1, 9), (1, 2, 5, 9)], "doc_id long, number int, start int, end int")
    assert {(r["number"], r["end"]) for r in spans.shortened(chapters, "doc_id").collect()} == {(1, 4), (2, 9)}
    rows = spark.createDataFrame([(k % 3 if k % 7 else None, k % 50, k) for k in range(700)], "g int, at int, id int")
    got = spans.numbered(rows, ["g"], "at", ["id"], "n").collect()
    for g in (0, 1, 2, None):
        own = sorted((r["at"], r["id"], r["n"]) for r in got if r["g"] == g)
        assert [n for *_, n in own] == list(range(1, len(own) + 1))
    ranked = similarity.first_by_key(rows, F.col("g"), "id").where("id = 0").first()
    assert (ranked["rank"], ranked["copies"]) == (1, 100)


def test_first_similar_equals_brute_force(spark):
    import random

    rnd = random.Random(2)
    base = [[f"w{rnd.randrange(80)}" for _ in range(20)] for _ in range(6)]
    sets = {}
    for k in range(120):
        w = set(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            w.add(f"x{rnd.randrange(30)}")
        sets.setdefault(tuple(sorted(w)), k)
    rows = [(k, list(w)) for w, k in sets.items()]
    want = {}
    for k, w in rows:
        near = [j for j, v in rows if j < k and len(set(v) & set(w)) / len(set(v) | set(w)) > 0.85]
        if near:
            want[k] = min(near)
    got = similarity.first_similar(spark.createDataFrame(rows, "node long, tokens array<string>"), 0.85)
    assert {r["node"]: r["near"] for r in got.collect()} == want and want


def test_grounded_forms(spark):
    docs = spark.createDataFrame([(1, "A Monte Carlo method and its variance are all we need here today"), (2, "other words altogether")], "doc_id long, text string")
    ask = spark.createDataFrame([("a", "monte carlo method and its variance are all we"), ("b", "method and its variance"), ("c", "other words"), ("d", "the words of nobody at all"), ("e", "MC method and its var")], "item_id string, text string")
    assert {tuple(r) for r in grounding.grounded(ask, docs).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    twice = {(r["item_id"], r["doc_id"], r["folded"]) for r in grounding.grounded_twice(ask, docs).collect()}
    assert twice == {("a", 1, False), ("b", 1, False), ("c", 2, False), ("e", 1, True)}


def test_round_robin(spark):
    slots = spark.range(5).select(F.col("id").alias("slot"))
    choices = spark.createDataFrame([(0, "a"), (1, "b")], "position long, name string")
    assert [r["name"] for r in items.round_robin(slots, choices).orderBy("slot").collect()] == list("ababa")
    assert items.round_robin(slots, choices.limit(0)).count() == 0


def test_windows_of_a_stream(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1, 12)
    rows = [(k, 1, ts + datetime.timedelta(hours=12 * k), "view" if k % 2 else "error") for k in range(8)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = review_state.live_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), late="1 hour")
    got = review_state.run_to_table(stream, "closed_windows", str(tmp_path / "check"), "append").collect()
    assert sorted(r["reviews"] for r in got) == [1, 2, 2]  # the last two windows are still open


def test_math_tokens_and_audit(spark):
    texts = spark.createDataFrame([(r"a \\(x\\) b",), (r"Xt1 and rho and Sigma",), ("gamma",), ("",), (None,), (r"{a \\(",)], "text string")
    got = [tuple(r) for r in texts.select(*grounding.math_tokens(F.col("text"))).collect()]
    assert [q for _, q in got] == ["high", "low", "medium", "low", "low", "medium"] and got[1][0] == ["raw Xt1", "raw Sigma", "raw rho"]
    assert {r["issue"]: r["texts"] for r in grounding.math_audit(texts).collect()} == {"raw Xt1": 1, "raw Sigma": 1, "raw rho": 2, "delimiters": 1, "unbalanced braces": 1}


def test_absent_terms_in_other_spellings(spark):
    docs = spark.createDataFrame([("the reparametrization of it, and counter-intuitively so",)], "text string").selectExpr("1L as doc_id", "text")
    ask = spark.createDataFrame([("a", "reparametrisation counterintuitively overgeneralisations unreparametrizationable")], "item_id string, text string")
    absent = grounding.absent_terms(ask, docs)
    assert {r["term"] for r in absent.collect()} == {"reparametrisation", "counterintuitively", "overgeneralisations", "unreparametrizationable"}
    left = grounding.truly_absent(absent, docs)
    assert {r["term"] for r in left.collect()} == {"overgeneralisations", "unreparametrizationable"}
    assert [(r["terms"], r["stale"]) for r in grounding.stale(left, 2).collect()] == [(["overgeneralisations", "unreparametrizationable"], True)]


def test_item_changes_reviews_and_jobs(spark):
    own = spark.createDataFrame([("a", "A", "x", False, None), ("b", "B", "x", False, "keep"), ("c", "C", "x", True, None), ("d", "D", "x", False, None)], "item_id string, title string, text string, deleted boolean, decision string")
    log = spark.createDataFrame([("a", 1, "upsert", "A2", None), ("a", 2, "delete", None, None), ("b", 1, "reject", None, None), ("c", 3, "restore", None, None), ("d", 1, "purge", None, None), ("e", 1, "upsert", "E", "new")], "item_id string, ts int, change string, title string, text string")
    got = {r["item_id"]: (r["title"], r["text"], r["deleted"], r["decision"]) for r in items.with_changes(own, log).collect()}
    assert got == {"a": ("A2", "x", True, "keep"), "b": ("B", "x", False, "reject"), "c": ("C", "x", False, "keep"), "e": ("E", "new", False, "keep")}
    kind = "item_id string, decision string, deleted boolean, standalone_value string, answer string, importance string, extraction_warning string, warnings array<string>, priority_label string, priority_score int, category string"
    rows = [("a", None, None, None, "x", None, None, None, "high", 1, "k"), ("b", "needs_review", False, "high", "x", None, None, [], "high", 1, "k"), ("c", "keep", False, "low", "x", None, None, [], "high", 1, "k"), ("d", "keep", False, "high", "x", None, None, ["Over-merged card"], "high", 1, "k"), ("e", "keep", False, "high", "x", None, None, [], "low", 70, "m"), ("f", "keep", False, "high", "x", None, None, [], "low", 2, "k")]
    table = spark.createDataFrame(rows, kind)
    ids = lambda **how: sorted(r["item_id"] for r in items.reviewable(table, **how).collect())
    assert ids() == ["a", "e"] and ids(needs_review=True) == ["a", "b", "e"] and ids(medium=True, category_="k") == ["a", "f"]
    errors = spark.createDataFrame([("JOB_CANCELLED", "x", None, None), (None, "quota met", None, None), (None, "timed out", None, None), (None, "x", "merging_chunks", "c"), (None, "x", None, "c"), (None, None, None, None)], "code string, message string, stage string, chunk string")
    assert [r[0] for r in errors.select(items.error_code(*[F.col(c) for c in errors.columns])).collect()] == ["JOB_CANCELLED", "OPENAI_RATE_LIMIT", "OPENAI_TIMEOUT", "MERGE_FAILED", "CHUNK_FAILED", "PDF_PARSE_FAILED"]
    status = spark.createDataFrame([("b", "running"), ("a", "queued"), ("c", "completed")], "job_id string, status string")
    assert [r["job_id"] for r in items.open_jobs(status).collect()] == ["a", "b"]
    chunks = spark.createDataFrame([("j", "1"), ("j", "2")], "job_id string, chunk_id string")
    assert {(r["chunk_id"], r["status"]) for r in items.kept_status(chunks, chunks.limit(1).withColumn("status", F.lit("completed"))).collect()} == {("1", "completed"), ("2", "pending")}
    topics = spark.createDataFrame([("a", 1, "high"), ("b", 2, "low"), ("c", 3, None)], "title string, position int, importance string")
    assert [r["topic"] for r in items.drill(topics, 3).orderBy("n").collect()] == ["b", "c", "b"] and items.drill(topics.limit(0)).count() == 0
