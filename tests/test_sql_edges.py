"""Registered queries against their SQL on documents that the given tables hold rarely or only when they are large."""

import duckdb

from marginalia.plans.queries import ORACLES, QUERIES
from marginalia.sources import files


def both(spark, tmp_path, name, texts):
    """Rows of the query and of its SQL over documents with these texts."""
    docs = [(k, t, "en", f"src{k % 8}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    got, c = QUERIES[name](spark, str(tmp_path)), duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(ORACLES[name])
    return sorted(tuple(r[x] for x in sorted(got.columns)) for r in got.collect()), sorted(tuple(r[want.columns.index(x)] for x in sorted(want.columns)) for r in want.fetchall())


def test_all_chapters_of_a_long_document(spark, tmp_path):
    got, want = both(spark, tmp_path, "chapter_blocks", ["\n".join(f"line {k:05d}" for k in range(720)), "one line."])
    assert got == want and len(got) == 720


def test_contents_of_headings_without_letters(spark, tmp_path):
    got, want = both(spark, tmp_path, "contents_entries", ["A heading\n12345 6\nAnother one\n....\nThe last"])
    assert got == want and [r[-1] for r in got].count("Title end") == 2


def test_noise_at_the_border(spark, tmp_path):
    # answer and raw text are empty lines of the judged text: 31 odd characters of 104, not of 102
    got, want = both(spark, tmp_path, "relevance_filter", ["Ñ" * 31 + " " + "a" * 65, "Ñ" * 32 + " " + "a" * 64])
    assert got == want and [r[1] for r in got] == ["kept", "parse_noise"]


def test_block_strategies_in_turns(spark, tmp_path, monkeypatch):
    """Documents are taken in turns, and of their blocks only the lengths are kept."""
    seen, staged = [], files.staged
    monkeypatch.setattr(files, "FEW", 0)
    monkeypatch.setattr(files, "staged", lambda df, label: seen.append((label, df.columns)) or staged(df, label))
    line = "a line of text that is too long to be a heading, as it has more than so many characters"
    texts = ["\n".join(line if (k * (d + 3)) % 5 else f"heading {'x' * (k % (d + 2))}" for k in range(20 * d + 1)) for d in range(9)]
    got, want = both(spark, tmp_path, "block_strategy", [*texts, "", line])
    assert got == want and len(got) >= 8
    assert [label for label, _ in seen].count("strategies") == files.TURNS and {c for label, cols in seen if label == "block-sizes" for c in cols} == {"doc_id", "way", "chars"}


def test_whole_texts_of_long_blocks(spark, tmp_path):
    long_ = "\n".join("a long line of one block and its words " * 60 for _ in range(55))
    got, want = both(spark, tmp_path, "block_strategy", [f"one heading\n{long_}\nits sibling\n{long_}", "A line."])
    assert got == want and max(r[0] for r in got) > 2 * 120_000


def test_topics_at_the_end_of_long_texts(spark, tmp_path):
    got, want = both(spark, tmp_path, "document_topics", ["ab cd ef\n" * 25_000 + "later pairs\n" * 6, "plain words " * 6])
    assert got == want and {"later pairs", "plain words"} <= {r[3] for r in got}
