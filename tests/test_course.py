"""Courses, signals, headings and blocks on small own rows: each rule of the operators at least once."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import candidates, course, lines, structure


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sentences(spark, rows):
    return spark.createDataFrame([(i, r, i, s) for i, (r, s) in enumerate(rows)], "doc_id long, role string, sentence_index int, sentence string")


@pytest.mark.parametrize("name, role", [
    ("chapter 3 exam notes.pdf", "lecture_notes"), ("Lecture_2.pdf", "lecture_notes"), ("exam format.pdf", "exam_guidance"), ("syllabus.txt", "exam_guidance"), ("2020-paper-mark-scheme.pdf", "mark_scheme"), ("marking scheme 1.pdf", "mark_scheme"),
    ("mock 2020.pdf", "past_paper"), ("past_paper.pdf", "past_paper"), ("problem sheet 4.pdf", "problem_sheet"), ("ps 3.pdf", "problem_sheet"), ("worksheet.pdf", "problem_sheet"), ("answers.pdf", "solution_sheet"), ("formulae.pdf", "formula_sheet"), ("picture.png", "other"),
])
def test_roles_of_file_names(spark, name, role):
    assert spark.range(1).select(X.role_of_name(F.lit(name))).first()[0] == role


def test_course_type(spark):
    table = spark.createDataFrame([("a", "f", "A random field and its variogram"), ("a", "g", "kriging"), ("b", "f", "a matrix"), ("c", "time series", "forecasting"), ("d", "f", None)], "course string, source string, text string")
    got = {r["course"]: (r["course_type"], r["score"]) for r in course.course_type(table, "course").collect()}
    assert got == {"a": ("spatial_statistics", 3), "b": ("unknown", 1), "c": ("time_series", 2), "d": ("unknown", 0)}


def test_seeds_locations_and_chapters(spark):
    titles = spark.createDataFrame([(1, "1.2 Random walks"), (2, "Definition of a walk"), (3, "Fair games"), (4, "Random walks"), (5, "abc")], "k int, title string")
    assert [tuple(r) for r in course.title_seeds(titles, ["k"]).collect()] == [("Random walks", 1), ("Fair games", 2)]
    pages = spark.createDataFrame([(1, 1, "x" * 300 + " Random  Walks begin here"), (1, 2, "fair games"), (2, 1, None)], "doc_id long, page int, text string")
    names = ["random  walks", "Fair games"]
    got = {r["name"]: r for r in course.topic_locations(pages, names).collect()}
    assert got["random  walks"]["excerpt"].endswith("x Random Walks begin here") and len(got["random  walks"]["excerpt"]) == 160 + 23 and got["Fair games"]["page"] == 2
    known = spark.createDataFrame([(1, 2, "FAIR GAMES")], "doc_id long, page int, concept string")
    assert [tuple(r) for r in course.topics_missing(pages, names, known).collect()] == [(1, 1, "random  walks")]
    assert tuple(course.first_page_of(pages, ["games"]).first()) == (1, 2) and course.first_page_of(pages, ["none"]).count() == 0
    many = spark.range(60).select((F.col("id") + 1).cast("int").alias("page"), F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("w "), 50)).otherwise("short").alias("text"))
    assert [r["page"] for r in course.filler_pages(many, known, enough=4).orderBy("page").collect()] == [1, 3, 5]
    assert course.filler_pages(pages, known).count() == 0
    parts = spark.createDataFrame([(1, "2.1", "A", 3, 5), (1, "2.2", "B", 6, 9), (1, None, "C", 1, 2)], "doc_id long, number string, title string, start int, end int")
    assert {tuple(r) for r in course.chapters_of(parts).collect()} == {(1, "2", "Chapter 2", 3, 9, 2), (1, "C", "C", 1, 2, 1)}


def test_signals(spark):
    rows = [("lecture_notes", "State the mean of random walks."), ("past_paper", "Prove that random walks are fair."), ("problem_sheet", "Calculate the likelihood of fair games."), ("exam_guidance", "Compare strict and weak forms of it."), ("past_paper", "Estimate random walks and fair games, and compare them.")]
    said = sentences(spark, rows)
    got = {(r["kind"], r["name"]): (r["label"], r["n"], r["first_docs"]) for r in course.required_signals(said, [("random walks", "high"), ("fair games", "low")]).collect()}
    assert got[("proof", "random walks")] == ("high", 1, [1]) and got[("formula", "fair games")] == ("low", 1, [2]) and ("definition", "random walks") not in got
    assert course.required_signals(said, []).where("kind = 'proof'").first()["name"] == rows[1][1][:60]
    steps = {r["name"]: (r["steps"][0], r["n"]) for r in course.calculation_templates(said, ["random walks", "fair games"]).collect()}
    assert steps == {"random walks": ("Identify inputs", 1), "fair games": ("Write likelihood", 2)}
    apart = course.distinctions(said, ["random walks", "fair games"]).orderBy("k").collect()
    assert [(r["name"], r["concepts"]) for r in apart] == [(rows[3][1], ["random walks", "fair games"]), ("random walks vs fair games", ["random walks", "fair games"])]
    boosts = {(r["signal"], r["doc_id"]): (r["name"], r["boost"]) for r in course.assessment_signals(said, ["random walks"]).collect()}
    assert boosts[("proof", 1)] == ("random walks", 40) and boosts[("calculation", 2)] == (rows[2][1], 25) and boosts[("conceptual", 3)][1] == 20
    places = spark.createDataFrame([("a", "past_paper"), ("a", "past_paper"), ("b", "other")], "name string, role string")
    assert {tuple(r) for r in course.entity_scores(places).collect()} == {("a", 90, "very_high"), ("b", 45, "medium")}


def test_evidence_rows(spark):
    e = spark.createDataFrame([(1, "past_paper", "fair games", 0, "Fair games are fair.")], "doc_id long, role string, phrase string, sentence_index int, sentence string")
    pages = spark.createDataFrame([(1, 1, "none"), (1, 2, "so: Fair games are fair."), (1, 3, "Fair games are fair.")], "doc_id long, page int, text string")
    got = course.evidence_rows(e, pages).first()
    assert got["page"] == 2 and got["explanation"] == "Past paper uses fair games, so it is an assessment pattern signal."


def test_question_patterns(spark):
    text = "Question 1.\nShow that a walk is fair.\n\nProve it again.\nFind the mean.\nof the walk over time\nOther words here"
    got = course.question_patterns(lines.lines(docs(spark, text))).orderBy("position").collect()
    assert [(r["position"], r["style"]) for r in got] == [(1, "Proof or derivation question"), (4, "Calculation or applied method question")]
    assert got[0]["evidence"] == "Question 1. Show that a walk is fair. Prove it again."


def test_seed_items_and_file_topics(spark):
    seeds, own = spark.createDataFrame([("Random Walks!",), ("Games",)], "front string"), spark.createDataFrame([("random walks",)], "front string")
    assert [r["front"] for r in course.missing_seeds(seeds, own).collect()] == ["Games"]
    files = spark.createDataFrame([("walk_1.pdf", "lecture_notes"), ("walk-1.txt", "other"), ("_.x", None)], "name string, role string")
    assert {(r["title"], tuple(r["files"]), r["importance"]) for r in course.topics_of_files(files).collect()} == {("walk 1", ("walk-1.txt", "walk_1.pdf"), "high"), ("Topic", ("_.x",), "medium")}


def test_layout(spark):
    glued = "It ends here Theorem 2.1 (Mean) says so Proof. Done\n\n\n\nsee text [Page 3]"
    assert spark.range(1).select(lines.broken_lines(F.lit(glued))).first()[0] == "It ends here\nTheorem 2.1 (Mean) says so\nProof. Done\n\nsee text\n[Page 3]"
    long_ = "w " * 100 + "end. Chapter 4 begins"
    assert spark.range(1).select(lines.reflowed(F.lit("short. Chapter 1\n" + long_))).first()[0] == "short. Chapter 1\n" + "w " * 100 + "end. \nChapter 4 begins"
    pages = spark.createDataFrame([(1, 1, "# A\nChapter one\nabc\n" + "x" * 121 + "\n1.2 Steps\n")], "doc_id long, page int, text string")
    assert lines.light_headings(pages, "doc_id").first()["headings"] == ["Chapter one", "1.2 Steps"]
    assert lines.light_headings(pages.select("doc_id", "page", F.lit(None).cast("string").alias("text")), "doc_id").first()["headings"] == []


def test_pages(spark):
    ruled = "\n---\nPage 2 of 3\n---\nfirst\n---\nPage 3\n---\nsecond"
    got = lines.pages_or_whole(docs(spark, ruled, "[Page 1]\nmarked", "plain")).orderBy("doc_id", "page").collect()
    assert [tuple(r) for r in got] == [(0, 2, "first"), (0, 3, "second"), (1, 1, "marked"), (2, 1, "plain")]
    pages = spark.createDataFrame([(1, 1, "w" * 200, 0), (1, 2, "w" * 200, 3), (1, 3, "w" * 79, None), (2, 1, "w" * 110, 0)], "doc_id long, page int, text string, images int")
    assert {tuple(r) for r in lines.pages_to_recognise(pages).collect()} == {(1, 2), (1, 3), (2, 1)}
    named = pages.select("doc_id", "page", F.lit("t").alias("text"), F.lit("f.pdf").alias("file"))
    assert lines.render(named, source="file", first=2, last=2).where("doc_id = 1").first()["text"] == "[f.pdf]\n\n[Page 2]\nt"


def test_layers_keep_blank_lines(spark):
    got = lines.layers(docs(spark, "one line\r\n\r\nanother line\nWhat???!!! is this\na..b")).first()
    assert got["printed_text"] == "one line\n\nanother line" and got["n_printed"] == 2 and got["n_handwritten"] == 1 and got["noise_text"] == "a..b"
    assert lines.usable_text(lines.layers(docs(spark, "short")), 80).first()["text"].startswith("short")


def test_heading_rejections(spark):
    rows = {"Chapter 1": None, "12": None, "0.1 0.2 0.3 0.4": None, "Table 2 games": None, "1.1 page 3 of 9": "footer_or_header", "2.1 " + "and more words, " * 12: "too_long_or_body", "1 Walks and games": None}
    found = {r["line"]: r["rejection_reason"] for r in structure.headings(lines.lines(docs(spark, "\n".join(rows))).withColumn("page", F.lit(1))).collect()}
    assert found["Chapter 1"] is None and found["1.1 page 3 of 9"] == "footer_or_header" and found["1 Walks and games"] is None
    assert found[("2.1 " + "and more words, " * 12).strip()] == "figure_axis_noise"
    body = "1.2 " + "a b c d e; " * 7
    assert structure.headings(lines.lines(docs(spark, body)).withColumn("page", F.lit(1))).first()["rejection_reason"] == "body_sentence"


def test_structural_headings_and_context(spark):
    text = "Chapter 2\nRandom walks\n1 Regular walks\n99 Bottles of it\n2.1 Steps we take\n2.1.1 Small steps\nProof of it\nWorked example: a walk\nAR (p)\nChapter 3: Games\nlast line"
    table = lines.lines(docs(spark, text))
    found = structure.structural_headings(table)
    assert [(r["kind"], r["label"], r["title"], r["level"]) for r in found.orderBy("line_index").collect()] == [
        ("chapter", "Chapter 2", "Random walks", 1), ("section", "1", "Regular walks", 2), ("section", "2.1", "Steps we take", 2), ("section", "2.1.1", "Small steps", 3), ("section", "Worked example", "a walk", 2), ("section", "AR", "AR (p)", 3), ("chapter", "Chapter 3", "Games", 1)]
    at = {r["line_index"]: (r["chapter"], r["chapter_title"], r["section"]) for r in structure.chapter_context(table, found).collect()}
    assert at[5] == ("Chapter 2", "Random walks", "2.1.1") and at[10] == ("Chapter 3", "Games", "Chapter 3")


def test_heading_blocks(spark):
    body = ["2.1 Walks"] + ["plain words in a row"] * 30 + ["the condition holds"] + ["plain words in a row"] * 30 + ["x = 1 + 2"] + ["plain words in a row"] * 5 + ["2.2 Games", "a short block under it, long enough"]
    table = lines.lines(docs(spark, "\n".join(body)))
    got = candidates.heading_blocks(table, structure.structural_headings(table)).orderBy("heading_line", "part").collect()
    assert [(r["type"], r["kind"], r["title"], r["part"]) for r in got] == [("property", "condition", "the condition holds", 1), ("formula", "formula", "x = 1 + 2", 2), ("other", "heading", "Games", 0)]


def test_unlabelled_and_distinctions(spark):
    table = docs(spark, "Theorem 1. It holds.", "  no label at all ", "", "two sections")
    marked = candidates.markers(table)
    parts = spark.createDataFrame([(3, "S", "first part"), (0, "S", "not wanted")], "doc_id long, title string, text string")
    assert {tuple(r) for r in candidates.unlabelled(table, marked, parts).collect()} == {(1, "Other", "no label at all", False), (3, "S", "first part", False)}
    text = "Here weak forms are not the same, whereas strict forms of it always hold for all of us. Other."
    got = candidates.distinction_sentences(docs(spark, text)).collect()
    assert [r["text"] for r in got] == ["weak forms are not the same, whereas strict forms of it always hold for all of us."]


def test_distinct_patterns(spark):
    """Near copies of a pattern that stays go, those of one that went don't count, and the cap counts those that stay."""
    base = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma"
    one, two = base + " omega", base.replace("alpha", "other")
    rows = [(0, 3, base), (0, 9, one), (0, 12, two), (0, 20, "a b"), (0, 25, "a b"), (0, 30, None), (1, 1, one)] + [(2, k, f"word{k // 2} only{k // 2}") for k in range(24)]
    got = course.distinct_patterns(spark.createDataFrame(rows, "doc_id long, position long, evidence string"))
    # one is 10 of 11 words like base; two 9 of 11, which is less than .82; without long words nothing is similar
    assert sorted((r.doc_id, r.position) for r in got.collect()) == [(0, 3), (0, 12), (0, 20), (0, 25), (0, 30), (1, 1)] + [(2, k) for k in range(0, 16, 2)]
    assert got.limit(0).collect() == []
