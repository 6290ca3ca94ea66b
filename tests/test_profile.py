"""Document profiles and section blocks on small own rows."""

from pyspark.sql import functions as F

from marginalia.operators import blocks, lines, profile, profiles, structure


def table(spark, *texts, per_page=8):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return lines.lines(docs).withColumn("page", (F.floor(F.col("line_index") / per_page) + 1).cast("int"))


NOTES = """Department of Mathematics
University of Somewhere
MATH 60046 Autumn 2023
Prof. A Person
someone@example.org
Introduction to random walks and games
Assessment is by exam
Chapter 2
Steps and sums
2.1 Steps
Theorem 2.1 says so
Proof. Done.
Worked example of it, and X_t with μ and μ
Exercise 3 is open"""


def test_front_matter_and_titles(spark):
    got = table(spark, NOTES, "short\n1.2 Steps", "Chapter 4 Games of chance\nthe end of it, x = y = z")
    front = {r["doc_id"]: r for r in profile.front_matter(got).collect()}
    first = front[0]
    assert (first["code"], first["department"], first["institution"], first["instructor"], first["contact"]) == ("MATH60046", "Department of Mathematics", "University of Somewhere", "Prof. A Person", "someone@example.org")
    assert (first["term"], first["title"], first["title_page"], first["chapter"]) == ("MATH 60046 Autumn 2023", "MATH 60046 Autumn 2023", 1, "2")
    assert (front[2]["chapter"], front[2]["chapter_title"]) == ("4", "Games of chance") and front[1]["title"] is None
    early = {r["doc_id"]: r for r in profile.early_title(got).collect()}
    assert early[0]["title"] == "Introduction to random walks and games" and early[0]["score"] == 7 and early[0]["confidence"] == 0.84 and 1 not in early
    files = spark.createDataFrame([(0, "a.pdf"), (1, "my_walks-1.pdf"), (2, "b.pdf"), (3, "x.y")], "doc_id long, name string")
    found = structure.headings(got)
    chosen = {r["doc_id"]: (r["title"], r["reason"]) for r in profile.chosen_title(profile.front_matter(got).where("doc_id <> 2"), profile.early_title(got).where("doc_id <> 2"), found, files).collect()}
    assert chosen == {0: ("MATH 60046 Autumn 2023", "explicit_front_matter_title"), 1: ("my walks 1", "document_file_fallback"), 2: ("Chapter 4 Games of chance", "first_top_level_heading_candidate"), 3: (None, "no_reliable_title")}


def test_flags_and_types(spark):
    exam = "Final exam of it\nTime allowed: two hours\n" + "\n".join(f"Question {k}. It asks something (5 marks)" for k in range(1, 5))
    sheet = "Problem sheet 2\n" + "\n".join(f"Problem {k}. Do it" for k in range(1, 10))
    solved = "\n".join(["Solution"] * 6)
    signs = "\n".join(["a = b"] * 120)
    cram = "Must know for it\nplain words"
    got = {r["doc_id"]: r for r in profile.flags(table(spark, NOTES, exam, sheet, solved, signs, cram, "plain words")).collect()}
    assert [got[k]["type"] for k in range(7)] == ["lecture_notes", "past_paper", "problem_sheet", "solutions", "formula_sheet", "revision_guide", "unknown"]
    assert got[0]["has_worked_examples"] and got[0]["has_exercises"] and got[0]["has_proofs"] and got[0]["has_theorems"] and not got[0]["has_lemmas"] and got[1]["past_paper"] and not got[6]["has_examples"]
    assert {(r["meaning"], r["hits"]) for r in profile.notation(table(spark, NOTES)).collect()} == {("Time series value at time t", 1), ("Mean", 2)}


def test_noise_pages_and_confidence(spark):
    noisy = table(spark, "fine line of it\n" + "\n".join(["a..b.. @@ %%"] * 2) + "\nDopulation is here", "all fine here")
    got = profile.noise_pages(noisy).collect()
    assert [(r["doc_id"], r["page"], r["score"]) for r in got] == [(0, 1, 18)] and "Dopulation is here" in got[0]["examples"]
    one = spark.range(1)
    assert one.select(profile.confidence(F.lit(True), F.lit(5), F.lit(True), F.lit(9))).first()[0] == 0.95 and one.select(profile.confidence(F.lit(False), F.lit(1), F.lit(False), F.lit(0))).first()[0] == 0.45
    toc = table(spark, "Contents\n1 Random walks ........ 12", "Contents\nplain")
    none = spark.createDataFrame([], "doc_id long")
    assert [r["doc_id"] for r in profile.contents_failed(toc, none).collect()] == [0] and profile.contents_failed(toc, toc.select("doc_id")).count() == 0


def test_spans_and_block_choice(spark):
    got = table(spark, "\n".join(f"line {k} of it" for k in range(6)), per_page=2)
    spans = spark.createDataFrame([(0, "A", 1, 2), (0, "A", 1, 2), (0, "B", 3, 3), (0, "C", 9, 9)], "doc_id long, heading string, start int, end int")
    assert {(r["heading"], r["text"]) for r in profile.span_texts(got, spans).collect()} == {("A", "line 0 of it\nline 1 of it\nline 2 of it\nline 3 of it"), ("B", "line 4 of it\nline 5 of it")}
    long_ = spark.createDataFrame([(0, "A", 3, 30), (0, "B", 1, 2)], "doc_id long, heading string, start int, end int")
    assert [(r["start"], r["end"]) for r in profile.split_spans(long_).where("heading = 'A'").orderBy("part").collect()] == [(3, 14), (15, 26), (27, 30)]
    rows = lambda *counts: spark.createDataFrame([(d, f"h{k}") for d, n in enumerate(counts) for k in range(n)], "doc_id long, heading string")
    docs = spark.createDataFrame([(0, 5, 9, 0), (1, 5, 9, 3), (2, 5, 1, 0), (3, 40, 9, 0), (4, 60, 0, 0)], "doc_id long, pages int, headings int, chapters int")
    chosen = blocks.chosen_blocks(rows(2, 0, 0, 1, 0), rows(0, 1, 0, 0, 0), rows(0, 4, 0, 0, 0), rows(0, 0, 3, 1, 0), rows(9, 0, 0, 6, 0), rows(0, 0, 0, 5, 5), docs)
    assert {(r["doc_id"], r["strategy"]) for r in chosen.collect()} == {(0, "semantic"), (1, "mapped"), (2, "structural"), (3, "graph"), (4, "windows")}


def test_wide_profile(spark):
    """One row a file with all parts; a file without lines has a title from its name."""
    toc = "Contents\nRandom walks and games ........ 1\nMarkov chains of it ........ 2\nPoisson processes now ........ 3\n" + "\n".join(f"plain line {k} of the text" for k in range(30))
    got = {r.doc_id: r for r in profiles.document_profiles(table(spark, NOTES, toc), spark.createDataFrame([(0, "a.pdf"), (1, "toc_file.pdf"), (2, "no_lines-here.pdf")], "doc_id long, name string")).collect()}
    assert len(got) == 3 and got[0]["title"] == "MATH 60046 Autumn 2023" and got[0]["type"] == "lecture_notes" and got[0]["people"] == ["Prof. A Person"]
    assert got[0]["admin_notes"][:2] == ["Department of Mathematics", "University of Somewhere"] and {n.meaning: n.hits for n in got[0]["notation"]} == {"Time series value at time t": 1, "Mean": 2}
    assert [(c.title, c.start) for c in got[1]["chapters"]] == [("Random walks and games", 1), ("Markov chains of it", 2), ("Poisson processes now", 3)] and got[1]["chapter_source"] == "contents" and got[1]["contents_found"] and not got[1]["contents_failed"] and got[1]["warnings"] == []
    last = got[2]
    assert (last["title"], last["reason"], last["pages"], last["chapters"], last["topics"], last["confidence"]) == ("no lines here", "document_file_fallback", None, [], [], 0.63)


def test_words_and_starts_miss_no_match(spark):
    """Whatever a pattern matches holds one of its words, and a heading starts as one does."""
    parts = ["Department of", "faculty OF x", "School of", "University", "a.b+c@d-e.org", "Prof. A", "DR. B", "professor C", "Autumn 2023", "term 1999", "2023 - 2024", "Moodle", "assessment", "course  materials", "Office b123", "room 12", "lecture notes", "Module handout", "SW7", "w12", "postcode", "POSTAL", "uk 3", "[page", "Fig. 3", "figure 1", "table 2", "mark", "Marks", "minutes allowed", "Instructions", "answer all", "attempt", "Worked Example", "example: a", "EXAMPLE (b)", "example 3", "for instance", "Exercise 2", "problem 3", "question4", "Proof.", "show that", "lemma 1", "Theorem 2", "proposition 3", "corollary 4", "algorithm 5", "pseudocode", "definition 1", "is called", "is defined as", "Contents", "chapter 2", "Chapter 3. Ab", "1.2.3.4 x", "1.2.3 x", "1.2 x", "3 Abcdef", "Remark", "Solution", "check that", "derive", "determine whether", "AB CD EF GH", "É", "\u212a"]
    texts = [q.strip() for p in parts for o in ["", *parts[::7]] for q in (p, f"{p} {o}", f"{o} {p}", p.upper(), p.lower())]
    rows = profile._with_text(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, line string"), F.trim("line")).cache()
    patterns = list(profile.NEEDED)
    seen = rows.agg(*[F.count_if(F.col("t").rlike(p)) for p in patterns]).first()
    kept = rows.agg(*[F.count_if(profile.matches(p)) for p in patterns]).first()
    assert list(seen) == list(kept) and min(seen) > 0
    rules = rows.agg(*[F.count_if(F.col("t").rlike(r[2]) & ~F.left("t", F.lit(3)).rlike(structure.STARTS)) for r in structure.HEADING_RULES], *[F.count_if(F.col("t").rlike(r[2])) for r in structure.HEADING_RULES]).first()
    assert set(rules[: len(structure.HEADING_RULES)]) == {0} and min(rules[len(structure.HEADING_RULES) :]) > 0


def test_a_line_is_collapsed_once(spark):
    """In the optimized plans the texts that patterns look at aren't computed again for each use, and front matter is read once."""
    got = table(spark, NOTES)
    early = profile.early_title(got)._jdf.queryExecution().optimizedPlan().toString()
    assert early.count("regexp_replace") <= 12
    docs = spark.createDataFrame([(0, NOTES)], "doc_id long, text string")
    paged = lines.lines(docs).withColumn("page", F.lit(1))
    files = docs.select("doc_id", F.lit("a").alias("name"))
    wide = profiles.document_profiles(paged, files).select("doc_id", "title", "contact", F.size("admin_notes").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert wide.count("posexplode") <= 3  # front matter, early titles, headings


def test_titles_that_end_in_marks(spark):
    ends = [",", " -", ", –", "-\u2028", "\u0085", ".", "", " Dr. Who", " school of"]
    got = {r.doc_id: r.title for r in profile.early_title(table(spark, *[f"A theory of many small things{e}" for e in ends])).collect()}
    head = "A theory of many small things"
    assert [got[k] for k in range(len(ends))] == [head, head, head, head + "\u2028", head + "\u0085", head + ".", head, head, head]
