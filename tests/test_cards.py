"""Items, decisions, gates and cards on small own rows."""

from pyspark.sql import functions as F

from marginalia.operators import cards, curate

KIND = "course string, candidate_id string, type string, kind string, number string, title string, concept string, statement string, raw string, proof string, page int"


def made(spark, rows):
    return spark.createDataFrame([("c", str(i), t, k, n, None, None, s, s, None, 1) for i, (t, k, n, s) in enumerate(rows)], KIND)


def test_items_of_candidates(spark):
    got = {r["candidate_id"]: r for r in cards.items_of(made(spark, [
        ("theorem", None, "2.1", "Mean value. The mean of a walk is zero at all times."), ("definition", None, None, "A walk is a sum of steps that are taken one after the other."), ("formula", None, None, "Variance formula. V = E - M^2"),
        ("algorithm", "test_statistic", None, "Compute it"), ("remark", None, None, "The condition applies when steps are lazy"), ("proof", None, "2.1", "Add the means."),
    ])).collect()}
    assert (got["0"]["title"], got["0"]["concept"], got["0"]["statement"], got["0"]["purpose"]) == ("Theorem 2.1. Mean value", "Mean value", "The mean of a walk is zero at all times.", "theorem_statement")
    assert got["1"]["title"] == "Definition: A walk is a sum of..." and got["1"]["purpose"] == "definition_recall" and got["1"]["prompt"] == "Recall the exact definition."
    assert got["2"]["answer"].startswith("V = E - M^2\n\nExplain") and got["2"]["standalone_value"] == "low" and got["2"]["tags"] == ["formula"]
    assert got["3"]["purpose"] == "test_statistic" and got["4"]["purpose"] == "condition_recall" and got["5"]["prompt"] == "Reproduce the proof." and got["5"]["concept"] == "Proof 2.1"


def scored(spark, rows, guidance):
    g = spark.createDataFrame([("c", guidance)] if guidance else [], "course string, guidance string")
    return {r["candidate_id"]: r for r in cards.relevance_scores(cards.with_guidance(cards.items_of(made(spark, rows)), g)).collect()}


def test_relevance_decisions(spark):
    long_ = " and it goes on in plain words for a while"
    rows = [
        ("definition", None, None, "See the Springer textbook, second edition of 2001" + long_), ("definition", None, None, "@@@@ #### %%%% &&&& @@@@ ####"), ("proof", None, "2.1", "Add the means and they cancel" + long_), ("proof", None, "7.7", "Add the means of others" + long_),
        ("formula", None, None, "variogram = half the variance of a difference" + long_), ("formula", None, None, "a = b + c + d" + long_), ("formula", None, None, "one term of it" + long_), ("theorem", None, "3.4", "Mean rule. Steps cancel in the end" + long_),
        ("theorem", None, None, "Terms cancel in the end" + long_), ("definition", None, None, "A walk is a sum of steps" + long_), ("remark", None, None, "The process has an important condition" + long_), ("remark", None, None, "Some plain talk" + long_),
        ("example", None, None, "Calculate the mean of it" + long_), ("example", None, None, "A walk in town" + long_), ("other", "conceptual_distinction", None, "Kriging differs from others" + long_), ("other", None, None, "Plain talk" + long_),
    ]
    got = scored(spark, rows, "You must prove 2.1 in the paper.")
    why = [got[str(i)]["reason"] for i in range(len(rows))]
    assert why == ["bibliography", "parse noise", "proof asked for", "proof not asked for", "central formula", "background formula", "formula of its parent", "theorem", "theorem of uncertain support", "definition or method", "remark on a trap", "ordinary remark", "pattern of calculation", "background example", "distinction", "low value"]
    assert got["2"]["support"] == 5 and got["2"]["decision"] == "keep" and got["6"]["decision"] == "embed_in_parent"
    none = scored(spark, rows[2:3], None)["0"]
    assert none["support"] == 0 and none["decision"] == "reject"
    out = scored(spark, [("definition", None, "2.1", "A walk is a sum of steps" + long_)], "2.1 is not required")["0"]
    assert out["not_asked"] and out["reason"] == "definition or method" and out["support"] == 5


def test_importance(spark):
    g = spark.createDataFrame([("c", "know 2.1")], "course string, guidance string")
    items = cards.items_of(made(spark, [("theorem", None, "2.1", "The mean of a walk is zero at all times."), ("remark", None, None, "Plain talk of a walk that goes on")]))
    got = {r["candidate_id"]: (r["importance"], r["standalone_value"]) for r in cards.importance_of(cards.relevance_scores(cards.with_guidance(items, g))).collect()}
    assert got == {"0": ("must_know", "high"), "1": ("unknown", "low")}


def test_quality_gate(spark):
    text = "A long enough statement of something"
    rows = [("a", "formula", "hence " + text, "x", "must_know", "high", False), ("b", "definition", text, "Definition 2", "must_know", "high", False), ("c", "definition", text + " offset 12", "x", "must_know", "high", False), ("d", "definition", text, "x", "unknown", "high", False), ("e", "definition", text, "x", "unknown", "medium", False),
            ("f", "definition", text, "x", "unknown", "low", False), ("g", "formula", text, "x", "partial", "medium", False), ("h", "theorem", text, "x", "partial", "high", False), ("i", "theorem", text, "x", "partial", "high", True), ("j", "definition", text, "x", "must_know", None, None)]
    items = spark.createDataFrame(rows, "id string, type string, statement string, concept string, importance string, standalone_value string, mentioned boolean").withColumns({"title": F.lit("t"), "answer": F.col("statement")})
    got = {r["id"]: (r["decision"], r["reason"]) for r in cards.quality_gate(items).collect()}
    assert got == {"a": ("reject", "low value or noise"), "b": ("needs_review", "generic name"), "c": ("needs_review", "low quality"), "d": ("keep", "high value of its own"), "e": ("needs_review", "medium value of its own"), "f": ("reject", "low value of its own"), "g": ("needs_review", "formula of unclear value"), "h": ("needs_review", "theorem not clearly central"), "i": ("keep", "passed"), "j": ("keep", "passed")}


def test_review_gate(spark):
    rows = [("a", "x" * 1801, "c", [], "p", "keep"), ("b", "x", "Theorem 2", [], "p", None), ("c", "x", "c", ["Debug"], "p", "keep"), ("d", "x", "c", [], "p", "reject"), ("e", "x [PDF placeholder]", "c", None, "p", "keep"), ("f", "y" * 901, "c", [], "background_context", "keep"), ("g", "x", "c", [], "p", "keep")]
    items = spark.createDataFrame(rows, "id string, answer string, concept string, tags array<string>, purpose string, decision string").withColumns({"statement": F.col("answer"), "title": F.lit("t")})
    got = {r["id"]: (r["decision"], r["review_reasons"]) for r in cards.review_gate(items).collect()}
    assert got == {"a": ("needs_review", ["long answer"]), "b": ("needs_review", ["generic front"]), "c": ("needs_review", ["debug"]), "d": ("reject", []), "e": ("needs_review", ["placeholder"]), "f": ("needs_review", ["long background"]), "g": ("keep", [])}


def test_relevance_filter(spark):
    text = " words that go on for long enough"
    rows = [("a", "definition", "Springer textbook" + text, 0), ("b", "formula", "V of it" + text, 0), ("c", "formula", "V of it" + text, 4), ("d", "remark", "plain" + text, 0), ("e", "example", "plain" + text, 0), ("f", "definition", "It is called a walk" + text, 0), ("g", "definition", "w " * 230, 0)]
    items = spark.createDataFrame(rows, "id string, type string, statement string, support int").withColumns({"title": F.lit("t"), "answer": F.lit(None).cast("string"), "raw": F.lit(None).cast("string"), "importance": F.lit("unknown"), "standalone_value": F.lit("medium")})
    got = {r["id"]: r["reason"] for r in cards.relevance_filter(items).collect()}
    assert got == {"a": "bibliography_or_reference", "b": "formula_not_standalone", "c": "kept", "d": "low_value", "e": "ordinary_explanatory_text", "f": "kept", "g": "too_broad"}


def test_grounding_audit(spark):
    rows = [("a", "definition", "short", "t"), ("b", "definition", "an excerpt of it", "t"), ("c", "formula", "an excerpt of it", "(( X_i"), ("d", "definition", "an excerpt of it", "t"), ("e", "definition", "an excerpt of it", "t")]
    items = spark.createDataFrame(rows, "item_id string, kind string, excerpt string, text string")
    ok = spark.createDataFrame([("c",), ("d",), ("e",)], "item_id string")
    absent = spark.createDataFrame([("d", f"t{k}") for k in range(8)] + [("e", f"label{k}") for k in range(6)], "item_id string, term string")
    got = {r["item_id"]: (r["reason"], r["warned"]) for r in cards.grounding_audit(items, ok, absent, tuple(f"label{k}" for k in range(6))).collect()}
    assert got == {"a": ("missing_source_excerpt", False), "b": ("weak_grounding", False), "c": ("broken_math_extraction", False), "d": ("stale_template_technical_term", False), "e": ("passed", True)}
    assert [r[0] for r in spark.createDataFrame([("x" * 48,), ("x" * 20,), (None,)], "e string").select(cards.excerpt_confidence(F.col("e"))).collect()] == [0.88, 0.72, 0.45]


def test_cards_and_sheets(spark):
    d = spark.createDataFrame([("p", "Walk", "a sum", "definition"), ("p", "Core idea 3", "x", "definition"), ("p", "Mean", "zero", "theorem")], "pack_id string, term string, definition string, item_kind string")
    f = spark.createDataFrame([("p", "V", "V = 1")], "pack_id string, name string, latex string")
    p = spark.createDataFrame([("p", "P", "add", None)], "pack_id string, name string, skeleton string, mistake string")
    m = spark.createDataFrame([("p", "M", ["one", "two"])], "pack_id string, problem string, steps array<string>")
    got = {(r["type"], r["question"], r["answer"]) for r in cards.flashcards(d, f, p, m).collect()}
    assert got == {("definition", "What is Walk?", "a sum"), ("theorem", "What is Mean?", "zero"), ("formula", "State or derive: V", "V = 1"), ("proof", "Prove or explain: P", "add\n\nCommon mistake: "), ("algorithm", "Outline the procedure: M", "one\n\ntwo")}
    rows = [("p", "definition", k, f"d{k}", "b" * 101) for k in range(14)] + [("p", "formula", 0, "Algorithm 2", "x"), ("p", "formula", 1, "F", "y"), ("p", "proof", 0, "Q", "first\nsecond")]
    table = spark.createDataFrame(rows, "pack_id string, kind string, position int, name string, body string")
    sheet = cards.cram_sheet(table).first()
    assert len(sheet["definitions"]) == 12 and sheet["definitions"][0] == "d0: " + "b" * 100 + "…" and sheet["formulas"] == ["F: y"] and sheet["proofs"] == ["Q: first"]
    asked = cards.quick_recall(table.unionByName(table.limit(1)), 16).orderBy("n").collect()
    assert len(asked) == 16 and asked[0]["question"] == "State the definition of “d0” in exam form (one short paragraph)." and asked[15]["question"].startswith("Write F")


def test_dashboard_and_weak_topics(spark):
    kind = "type string, category string, purpose string, decision string, deleted boolean, next_due timestamp, reviewed boolean"
    rows = [("definition", None, None, None, None, None, True), ("other", "mustKnowDefinitions", None, "keep", False, None, False), ("formula", None, "calculation_template", "reject", False, None, None), ("proof", None, None, None, True, None, None), ("algorithm", None, "calculation_template", None, None, None, None)]
    got = cards.dashboard(spark.createDataFrame(rows, kind).withColumn("as_of", F.lit("2024-01-01").cast("timestamp"))).first()
    assert got.asDict() == {"definitions": 2, "formulas": 0, "proofs": 0, "practice": 1, "due": 3, "reviewed_definitions": 1}
    topics = spark.createDataFrame([("a", 1, "high"), ("b", 2, "low"), ("c", 3, None)], "title string, position int, importance string")
    assert [r["title"] for r in cards.weak_topics(topics).collect()] == ["b", "c"]


def test_warnings_chapters_completeness(spark):
    kind = "type string, title string, prompt string, statement string, answer string, importance string, location string, excerpt string, extraction_warning string"
    good = ("definition", "Walk", "Recall it.", "A walk is a sum of steps taken in turn", "A walk is a sum.", "must_know", "p. 1", "A walk is", None)
    rows = [good, (None, "", "", "", "", "unknown", None, " ", None), ("definition", "T" * 121, "p" * 181, ", which was begun before Theorem 2.1 and Lemma 2.2", "x" * 2501, "must_know", "p", "e", "Over-merged card."), ("theorem", "Lemma 3", "p", "Definition 1 and then Theorem 2 in 3.1 Other Matters of it", "a", "partial", "p", "e", None)]
    got = curate.warnings(spark.createDataFrame(rows, kind)).collect()
    assert got[0]["warnings"] == got[0]["hard_warnings"] == [] and got[0]["valid"]
    assert got[1]["warnings"] == ["Missing title.", "Missing type.", "Missing question prompt.", "Missing answer.", "Importance is unknown.", "Source location is missing.", "Source excerpt is missing."] and got[1]["hard_warnings"] == ["Source location is missing.", "Source excerpt is missing."]
    assert len(got[2]["hard_warnings"]) == 6 and "Definition statement starts suspiciously and may be missing its beginning." in got[2]["suspicious"] and "Type conflicts with labelled source text (theorem)." in got[2]["warnings"]
    assert "Over-merged card: theorem statement contains a preceding definition." in got[3]["hard_warnings"] and "Type conflicts with labelled source text (lemma)." in got[3]["warnings"] and "Statement appears to include unrelated section text." in got[3]["warnings"]
    full = '{"id":"a","type":"t","title":"x","statement":"s","sourceFile":"f","tags":[],"importance":"i","questionPrompt":"q","answer":"a","createdAt":"c","updatedAt":"u"}'
    raw = spark.createDataFrame([(1, full), (2, '{"id":"a"}'), (3, "no")], "position int, json string")
    errors = {r["position"]: r["error"] for r in curate.import_errors(raw).collect()}
    assert set(errors) == {2, 3} and errors[2].startswith("Item 2: missing required field(s): type, title") and errors[3] == "Item 3: must be an object."
    chapters = spark.createDataFrame([(1, 1, "A", 1, 4), (1, 2, "B", 5, 9)], "doc_id long, number int, title string, start int, end int")
    placed = spark.createDataFrame([(1, 2)] * 7 + [(1, 6)], "doc_id long, page int")
    assert {(r["number"], r["items"], r["risk"]) for r in curate.chapter_counts(placed, chapters).collect()} == {(1, 7, "medium"), (2, 1, "low")}
    five = spark.createDataFrame([(f"k{k}",) for k in range(5)], "kind string")
    assert [curate.completeness(five, F.col("kind"), n).first()["level"] for n in (5, 7, 8)] == ["high", "medium", "low"]
    said = spark.createDataFrame([("a", 1, 6, None), ("b", 1, 99, "More of B"), ("c", 1, None, "x"), ("d", 2, 1, "x")], "item_id string, doc_id long, page int, section string")
    assert {r["item_id"]: r["number"] for r in curate.chapter_of(said, chapters).collect()} == {"a": 2, "b": 2, "c": 1, "d": None}


def test_topics_proof_cards_and_scores(spark):
    items = spark.createDataFrame([("a", "theorem", "Random walks", "T", "they end", "add", True, "keep"), ("b", "theorem", "x", "T2", "walks of a random kind", "add", True, "needs_review"), ("c", "definition", "x", "y", "z", None, True, None)], "item_id string, type string, concept string, title string, statement string, proof string, proof_asked boolean, decision string")
    assert {r["item_id"]: (r["topic"], r["topic_label"]) for r in curate.topic_of(items, [("Fair games", "low"), ("Random Walks!", "high")]).collect()} == {"a": ("Random Walks!", "high"), "b": ("Random Walks!", "high"), "c": (None, None)}
    assert [(r["item_id"], r["title"], r["answer"]) for r in curate.proof_cards(items).collect()] == [("a-proof", "Proof of T", "add")]
    rows = items.withColumns({"purpose": F.lit("theorem_statement"), "front": F.col("concept"), "math": F.lit("medium")})
    assert tuple(curate.pack_scores(rows, ["random walks", "games", "x y"], 2).first()) == (20, 67, 70, 67)
    kept = spark.createDataFrame([("remark", None, False, ["past_paper"], "high", 1, None, 0, False, "calculation_template")], "type string, number string, generic boolean, roles array<string>, topic_label string, templates int, required_label string, centrality int, kept boolean, purpose string")
    assert curate.exam_priority(kept).first()["priority_score"] == 75
