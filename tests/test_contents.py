"""Contents in each of their forms."""

from marginalia.operators import contents


def parse(spark, *docs, last=60):
    rows = [(k, p, t) for k, pages in enumerate(docs) for p, t in enumerate([pages] if isinstance(pages, str) else pages, 1)] + [(k, last, "the end") for k in range(len(docs))]
    got = contents.contents_entries(spark.createDataFrame(rows, "doc_id long, page int, text string")).orderBy("doc_id", "position").collect()
    return [[(r.label, r.title, r.start, r.end, r.level) for r in got if r.doc_id == k] for k in range(len(docs))]


def test_forms(spark):
    leaders = "Front\nTable of Contents\n1 Random walks ........ 3\n2 Games of chance … 9\n3 Markov chains . . . . 20"
    below = "Contents\n1 Random walks\n3\n2 Games of\nchance and skill\n9\n3 Markov chains\n20\nIt goes on in prose"
    plain = "Contents\nIntroduction ........ 1\n1 Random walks .... 3\nAppendix of tables .... 40\nPage .... 2"
    nested = "1 Random walks .... 3\n1.1 Simple ones with a longer title .... 4\n2 Games .... 9\n2 Games of chance .... 10\n3 Chains .... 12"
    got = parse(spark, leaders, below, plain, nested)
    assert got[0] == [("1", "Random walks", 3, 8, 1), ("2", "Games of chance", 9, 19, 1), ("3", "Markov chains", 20, 60, 1)]
    assert got[1] == [("1", "Random walks", 3, 8, 1), ("2", "Games of chance and skill", 9, 19, 1), ("3", "Markov chains", 20, 60, 1)]
    assert got[2] == [("u1", "Introduction", 1, 2, 1), ("1", "Random walks", 3, 39, 1), ("u2", "Appendix of tables", 40, 60, 1)]
    assert got[3] == [("1.1", "Simple ones with a longer title", 4, 9, 2), ("2", "Games of chance", 10, 11, 1), ("3", "Chains", 12, 60, 1)]


def test_fallbacks_and_bounds(spark):
    same = "1.1 First part .... 3\n1.2 Second part .... 5\n1.3 Third part of it .... 7"  # one leading number: all rows count
    outside = "Contents\n1 Too far away .... 99\n2 Games .... 9\n3 Year 2023 in it\n7"
    far = "x" * 26_000 + "\n1 Random walks .... 3\n2 Games .... 9"
    late = "words " * 5000 + "\nContents\n1 Random walks .... 3\n2 Games .... 9"
    deep = [f"page {k}" for k in range(15)] + ["Contents\n1 Random walks .... 3\n2 Games .... 9"]
    got = parse(spark, same, outside, far, late, deep, "", "1 One .... 1\n2 Two .... 2")
    assert got[0] == [("1.1", "First part", 3, 4, 2), ("1.2", "Second part", 5, 6, 2), ("1.3", "Third part of it", 7, 60, 2)]
    assert got[1] == got[2] == got[4] == got[5] == []  # beyond the document, numbers of three digits in a title; out of the window; after the first 15 pages
    assert got[3] == [("1", "Random walks", 3, 8, 1), ("2", "Games", 9, 60, 1)]
    assert parse(spark, "1 One .... 1\n2 Two .... 1", last=1) == [[]]  # a document of one page
    assert contents.contents_entries(spark.createDataFrame([], "doc_id long, page int, text string")).collect() == []
