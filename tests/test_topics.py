"""Topics by page, the maps of a course and related topics on own rows."""

from marginalia.operators import topics

HEADS = "doc_id long, page int, line string"


def test_document_topics_and_pages(spark):
    heads = [(0, 2, "1.2 Random field models"), (0, 5, "Random field models"), (0, 7, "3 Kriging"), (0, 9, "See the department address"), (0, 9, "ab"), (0, 9, "  "), (0, 11, "One two three four five six seven words of it"), (1, 1, "Kriging predictors in space")]
    text = "ordinary kriging " * 6 + "such that " * 9 + "spatial models of " * 4
    docs = spark.createDataFrame([(0, text), (1, None), (2, "")], "doc_id long, text string")
    h = spark.createDataFrame(heads, HEADS)
    got = {(r.doc_id, r.topic): r for r in topics.topic_pages(topics.document_topics(docs, h), h).collect()}
    # two different lines name random field models; stop phrases, admin words and pairs seen four times are none
    assert {k: r.weight for k, r in got.items()} == {(0, "random field models"): 4, (0, "kriging"): 2, (0, "one two three four five"): 2, (0, "ordinary kriging"): 1, (1, "kriging predictors in space"): 2}
    first = got[0, "random field models"]
    assert (first.pages, first.confidence) == ([2, 5], 0.62) and (got[0, "kriging"].pages, got[0, "kriging"].confidence) == ([7], 0.49)
    assert (got[0, "ordinary kriging"].pages, got[0, "ordinary kriging"].confidence) == ([7], 0.42)  # a heading inside the topic names it, without weight
    assert got[0, "one two three four five"].pages == [11]
    assert topics.topic_pages(topics.document_topics(docs.limit(0), h.limit(0)), h.limit(0)).collect() == []


def test_maps(spark):
    kind = "course string, role string, doc_id long, sentence_index int, sentence string"
    rows = [("a", "exam_guidance", 1, k, f"Kriging is asked {k}") for k in range(7)] + [("a", "lecture_notes", 2, 0, "Isotropy of kriging and likelihood"), ("b", "lecture_notes", 3, 0, "Isotropy alone"), ("b", "lecture_notes", 3, 0, "Isotropy alone")]
    terms = spark.createDataFrame([("isotropy", 1), ("kriging", 2), ("likelihood", 3), ("absent", 4)], "topic string, position int")
    known = topics.knowledge_map(spark.createDataFrame(rows, kind), terms)
    got = {(r.course, r.topic): (r.importance, r.evidence, r.likely_use) for r in known.collect()}
    assert got == {
        ("a", "kriging"): ("core", [f"Kriging is asked {k}" for k in range(5)], "calculation"), ("a", "isotropy"): ("supporting", [], "conceptual_explanation"), ("a", "likelihood"): ("supporting", [], "calculation"),
        ("b", "isotropy"): ("supporting", ["Isotropy alone"], "conceptual_explanation"),
    }
    sections = spark.createDataFrame([("a", 1, "1", "T", "On kriging\n and  isotropy", 1, 2), ("a", 1, "2", "T", "On kriging", 3, 3), ("b", 1, "1", None, "kriging", 1, 1), ("a", 1, None, None, None, None, None)], "course string, doc_id long, number string, title string, text string, start int, end int")
    placed = sorted((r.course, r.number or "", r.summary, r.importance) for r in topics.structure_map(sections.where("text is not null"), known, terms).collect())
    assert placed == [("a", "1", "On kriging and isotropy", "supporting"), ("a", "2", "On kriging", "core"), ("b", "1", "kriging", "unknown")]
    assert topics.structure_map(sections, known, terms).count() == 4
    items = spark.createDataFrame([("a", 9, "KRIGING here"), ("a", 3, "kriging"), ("b", 4, "kriging")], "course string, id long, text string")
    assert [(r.course, r.topic, r.items) for r in topics.related_items(known, items).collect()] == [("a", "kriging", [3, 9])]


def test_related_topics(spark):
    held = [(k, t) for k in range(30) for t in (["x", "y"] if k % 2 else ["x", "z", "z"])] + [(99, "alone")] + [(100 + k, t) for k in range(9) for t in ("x", f"w{k}")]
    got = [(r.topic, r.related, r.weight, r.k) for r in topics.related_topics(spark.createDataFrame(held, "id long, topic string")).collect()]
    assert sorted(r for r in got if r[0] == "x") == [("x", "w0", 1, 3), ("x", "w1", 1, 4), ("x", "w2", 1, 5), ("x", "y", 15, 1), ("x", "z", 15, 2)]
    assert ("y", "x", 15, 1) in got and not [r for r in got if "alone" in r[:2]]
