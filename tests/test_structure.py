"""Structure, candidates and curation on small own rows."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import candidates, chunks, curate, gates, grounding, items, lines, spans, structure
from marginalia.sources import files

NOTES = """Chapter 1
Random walks
1.1 Steps
A walk moves at each step.
Definition 1.1 (Walk). A walk is a sum of steps.
Remark 1.2. Steps may be lazy.
Theorem 1.3 (Mean). The mean of a walk is zero.
Proof. Add the means. They cancel.
3
Chapter 2 Martingales
2.1 Fair games
S = a + b = c
Table 2 shows the games
Exercise 2.4 Show that a fair game stays fair.
2.10 Later games
The variance is given by:
V = E - M^2"""


@pytest.fixture(scope="module")
def noted(spark):
    docs = spark.createDataFrame([(1, NOTES)], "doc_id long, text string")
    return docs, lines.lines(docs).withColumn("page", (F.floor(F.col("line_index") / 6) + 1).cast("int"))


def test_headings_and_rejections(noted):
    got = [(r["kind"], r["level"], r["rejection_reason"]) for r in structure.unique_headings(structure.headings(noted[1])).orderBy("line_index").collect()]
    assert [g[0] for g in got] == ["chapter", "section", "definition", "remark", "theorem", "proof", "chapter", "section", "exercise", "section"]
    assert all(g[2] is None for g in got)


def test_titles_join(noted):
    assert [r["line"] for r in structure.joined_titles(noted[1]).collect()] == ["Chapter 1 Random walks"]


def test_sections_sort_by_version(noted):
    got = structure.merged_sections(structure.section_headings(noted[1])).collect()
    assert [r["number"] for r in got][-3:] == ["1.1", "2.1", "2.10"][-3:] and got[-1]["title"] == "Later games"


def test_chapters_have_ranges(spark, noted):
    last = noted[1].groupBy("doc_id").agg(F.max("page").alias("last_page"))
    got = structure.chapters_from_markers(structure.headings(noted[1]), last).orderBy("number").collect()
    assert [(r["number"], r["start"], r["end"]) for r in got] == [(1, 1, 1), (2, 2, 3)]
    toc = spark.createDataFrame([(1, "1", "Random walks", 1), (1, "2", "Martingales", 2)], "doc_id long, label string, title string, start int")
    titled = structure.titled(structure.chapters_from_markers(structure.headings(noted[1]), last), toc)
    assert titled.where("number = 1").first()["title"] == "Random walks"
    best = structure.best_source([("markers", titled.select("doc_id", "number").limit(1)), ("contents", toc.select("doc_id", F.col("label").cast("int").alias("number")))])
    assert {r["source"] for r in best.collect()} == {"contents"}


def test_contents(spark):
    text = "Contents\n1 Walks ........ 3\n1.1 Steps and their\nmeans ...... 4\n2 Games\n9\nIntroduction part ..... 2"
    toc = structure.contents(lines.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("page", F.lit(1)))
    assert {(r["label"], r["title"], r["start"]) for r in toc.collect()} == {("1", "Walks", 3), ("1.1", "Steps and their means", 4), ("2", "Games", 9), ("u1", "Introduction part", 2)}


def test_candidates_and_proofs(spark, noted):
    found = candidates.candidates(candidates.markers(noted[0]))
    assert [r["label"] for r in found.orderBy("start").collect()][:4] == ["definition", "remark", "theorem", "proof"]
    attached = {r["label"]: r for r in candidates.with_proofs(found).collect()}
    assert "proof" not in attached and attached["theorem"]["proofs"][0].startswith("Add the means")
    assert attached["definition"]["name"] == "Walk" and "Remark" not in attached["definition"]["body"]
    cited = candidates.markers(spark.createDataFrame([(1, "Theorem 1. It holds, see Theorem 2. for more.")], "doc_id long, text string"))
    assert cited.count() == 1
    assert candidates.segmentation_report(found).first()["candidates"] == found.count()


def test_collected_spans_and_formulas(noted):
    got = {(r["type"], r["first_line"], r["last_line"]) for r in candidates.collected(noted[1]).collect()}
    assert {("definition", 4, 4), ("theorem", 6, 6), ("proof", 7, 8), ("exercise", 13, 13)} <= got
    assert [(r["line"], r["cued"]) for r in candidates.formula_lines(noted[1]).orderBy("line_index").collect()] == [("S = a + b = c", False), ("V = E - M^2", True)]


def brute_spans(rows, most):
    out, k = [], 0
    while k < len(rows):
        if rows[k] != "s":
            k += 1
            continue
        e = k + 1
        while e < len(rows) and rows[e] == "x" and e - k < most:
            e += 1
        out.append((k, e - 1))
        k = e
    return out


def test_block_spans_equal_brute_force(spark):
    rnd = random.Random(2)
    docs = {i: [rnd.choice("sxxxe") for _ in range(rnd.randrange(1, 25))] for i in range(40)}
    rows = spark.createDataFrame([(i, k, c) for i, cs in docs.items() for k, c in enumerate(cs)], "doc_id long, line_index int, line string")
    got = {(r["doc_id"], r["first_line"], r["last_line"]) for r in spans.block_spans(rows, "^s", "^[se]", 4, 1000).collect()}
    assert got == {(i, a, b) for i, cs in docs.items() for a, b in brute_spans(cs, 4)}


def test_chunks_of_the_known_case(spark):
    pages = spark.createDataFrame([(1, p, 4870, False) for p in range(1, 12)], "doc_id long, page int, chars int, headed boolean")
    got = chunks.chunk_pages(pages, (4, 30_000, 10_000)).groupBy("chunk").agg(F.min("page").alias("a"), F.max("page").alias("b")).orderBy("chunk").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 4), (5, 8), (9, 11)]


def test_marked_text_round_trip(spark):
    docs = spark.createDataFrame([(1, "[Page 1]\nfirst\n\n[Page 3]\nthird")], "doc_id long, text string")
    pages = lines.marked_pages(docs)
    assert sorted((r["page"], r["text"]) for r in pages.collect()) == [(1, "first"), (3, "third")]
    assert lines.render(pages).first()["text"] == docs.first()["text"]


def test_small_text_operators(spark):
    docs = spark.createDataFrame([(1, "It is de-\nfined ﬁne.\n" + "x" * 100 + "\nReferences\n[1] A book")], "doc_id long, text string")
    assert docs.select(X.repair(F.col("text"))).first()[0].startswith("It is defined fine.")
    assert [r["line"] for r in lines.cut_after(lines.lines(docs), "(?i)^references$", 80).orderBy("line_index").collect()][-1] == "x" * 100
    new, audit = lines.rewrite(docs, [("book", "book", "paper"), ("none", "qqq", "")])
    assert new.first()["text"].endswith("A paper") and {tuple(r) for r in audit.collect()} == {("book", 1), ("none", 0)}
    a, b = spark.createDataFrame([(1, 1, "seen by the machine in full, all of it")], "doc_id long, page int, text string"), spark.createDataFrame([(1, 1, "layer"), (1, 2, "only")], "doc_id long, page int, text string")
    assert {r["page"]: r["text"] for r in lines.merge_page_text(a, b).collect()} == {1: "seen by the machine in full, all of it\nlayer", 2: "only"}
    put = spark.createDataFrame([(1, 1, 0.0, 90.0, 10.0, "ab"), (1, 1, 15.0, 91.0, 10.0, "cd"), (1, 1, 0.0, 50.0, 5.0, "e"), (1, 1, 5.5, 50.0, 5.0, "f")], "doc_id long, page int, x double, y double, width double, str string")
    assert sorted(r["line"] for r in lines.positioned_lines(put).collect()) == ["ab cd", "ef"]
    names = spark.createDataFrame([("past paper 2020.pdf", "past_paper"), ("Solutions-3.pdf", "solution_sheet"), ("week_2_notes.pdf", "lecture_notes"), ("x.bin", "other")], "n string, r string")
    assert names.where(X.role_of_name(F.col("n")) != F.col("r")).count() == 0
    assert files.union_by_role({"other": docs, "past_paper": docs.withColumn("role", F.lit("mark_scheme"))}).select("role").distinct().count() == 2


def test_priority_score_keeps_the_order_of_caps_and_floors(spark):
    kind = "id int, type string, number string, generic boolean, roles array<string>, topic_label string, templates int, required_label string, centrality int, kept boolean"
    rows = [(1, "definition", None, False, [], "high", 0, None, 1, False), (2, "formula", None, False, ["past_paper"], "medium", 0, None, 5, True), (3, "theorem", "1.2", False, [], None, 0, None, 0, False), (4, "remark", None, False, ["past_paper", "exam_guidance"], "very_high", 1, "high", 0, False), (5, "formula", None, False, ["past_paper"], "low", 1, None, 0, False), (6, "definition", None, True, [], "very_high", 0, None, 4, False)]
    got = {r["id"]: (r["priority_score"], r["priority_decision"]) for r in curate.exam_priority(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (70, "keep"), 2: (40, "reject"), 3: (45, "needs_review"), 4: (39, "reject"), 5: (71, "keep"), 6: (70, "needs_review")}


def test_curation_details(spark):
    it = spark.createDataFrame([("f", 1, 1, "definition"), ("f", 1, 2, "remark"), ("f", 2, 3, "remark")], "source_file string, page int, position int, type string")
    assert [r["parent_order"] for r in curate.parent_items(it).orderBy("position").collect()] == [None, 1, None]
    text = "Theorem 1. " + "a" * 700 + "\n\nProof. " + "b" * 700
    parts = curate.split_long(spark.createDataFrame([("x", text), ("y", "short"), ("z", "c" * 1300)], "item_id string, statement string")).collect()
    assert {(r["item_id"], r["part"]) for r in parts} == {("x", "statement"), ("x", "proof"), ("y", "whole"), ("z", "review")}
    said = spark.createDataFrame([("Understand 2.1 and 2.2.",), ("You must prove the result of 2.1.",)], "sentence string")
    assert {tuple(r) for r in curate.required_sections(said).collect()} == {("2.1", "prove"), ("2.2", "understand")}
    raw = spark.createDataFrame([('{"item_id":"a","type":"poem","score":140}',), ("not json",)], "json string")
    got = curate.coerced(raw).collect()
    assert (got[0]["type"], got[0]["score"], got[0]["decision"], got[0]["corrupt"], got[1]["corrupt"]) == ("other", 100.0, "keep", False, True)
    tests = gates.acceptance(spark.createDataFrame([(1, 2)], "a int, b int"), {"p": F.col("a") == 1, "q": F.col("b") == 1})
    assert gates.verdict(tests, ("p",), 0.5).first()["level"] == "relaxed" and gates.verdict(tests, ("q",)).first()["level"] == "failed"
    math = spark.createDataFrame([("$x^2$", "ok"), (r"\frac{a}{b", "broken"), (r"\alpha + 1", "needs_check")], "t string, s string")
    assert math.where(grounding.math_quality(F.col("t"))[1] != F.col("s")).count() == 0


def test_every_row_ends_in_one_decision(spark):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    gated = gates.gate(rows, [(F.col("v") == 0, "reject", "zero"), (F.col("v") < 3, "review", "small")])
    assert {r["decision"]: r["count"] for r in gated.groupBy("decision").count().collect()} == {"reject": 15, "review": 29, "keep": 56}
    assert gates.report(gated).agg(F.sum("rows")).first()[0] == 100


def test_projects_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_project(spark, spark.createDataFrame([(1, "a"), (2, "b")], "v int, project_id string"), path)
    files.replace_project(spark, spark.createDataFrame([(9, "a")], "v int, project_id string"), path)
    assert {(r["v"], r["project_id"]) for r in spark.read.parquet(path).collect()} == {(9, "a"), (2, "b")}
    (tmp_path / "Lecture notes 1.md").write_text("# Title\n" + "text " * 100)
    got = files.read_texts(spark, str(tmp_path / "*.md")).first()
    assert (got["file_type"], got["extraction_quality"]) == ("markdown", "medium")


def test_job_progress(spark):
    log = spark.createDataFrame([("j", 1, "extracting_text", None, None, False), ("j", 2, "extracting_candidates", 2, 4, False), ("k", 5, "completed", 4, 4, False)], "job_id string, ts int, stage string, chunk int, chunks int, failed boolean")
    assert {r["job_id"]: (r["percent"], r["status"]) for r in items.job_progress(log).collect()} == {"j": (54, "running"), "k": (100, "completed")}
