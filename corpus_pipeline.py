"""A corpus made ready for training: five stages over documents, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bloom_langid, decontam, parity_join, piece_codec, secret_forest
from marginalia.llm.common import staged, table


def _unused(docs: DataFrame, name: str) -> str:
    """name, with underscores where documents have such a column already."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], needed: list[str], wanted: dict[str, Column]) -> DataFrame:
    """docs with the columns wanted from operator's rows, which sees only the columns needed: names of others can't clash."""
    rest = [F.col(c) for c in docs.columns if c not in needed]
    rows = operator(docs.select(*needed, F.struct(F.lit(0).alias("none"), *rest).alias("carried")))
    own = [F.col(c) if c in needed else F.col("carried").getField(c).alias(c) for c in docs.columns]
    return rows.select(*own, *[value.alias(name) for name, value in wanted.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identified language; lang stays as given."""
    filters = bloom_langid.train(docs.where(~bloom_langid.held_out()).select("text", "lang"))
    known = _unused(docs, "known")
    judged = _beside(docs, lambda d: bloom_langid.identify(d, filters), ["text"], {known: F.col("lang_pred") != "und"})
    return judged.where(known).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies (five-word shingles, Jaccard 0.8).

    Rows that share a doc_id with others or have none are judged by their own texts; they yield to near copies with a
    doc_id of their own. Of rows that are alike in doc_id and text the least one, by all columns, stays.
    """
    row, other, mark = (_unused(docs, n) for n in ("row", "row_id", "row_shared"))
    own, rest = F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 62)  # ids from 2**62 on: rows without a doc_id of their own
    shared = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null or doc_id >= 1L << 62").select(F.col("doc_id").alias(other), F.lit(True).alias(mark))
    if shared.isEmpty():
        known = docs.withColumn(row, F.col("doc_id"))
    else:
        marked = docs.join(staged(shared, "pipeline-shared"), F.col("doc_id").eqNullSafe(F.col(other)), "left")
        known = marked.withColumn(row, F.when(F.col(mark), rest + F.pmod(own, rest)).otherwise(F.col("doc_id"))).drop(other, mark)
    groups = parity_join.similar_groups(known.select(F.col(row).alias("doc_id"), "text"), 5, Fraction(4, 5))
    first = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(row)).count()
    stay = known.join(first.where("count = 1").select(row), row, "left_semi").select(docs.columns)
    alike = known.join(first.where("count > 1").select(row), row, "left_semi")
    order = F.struct(*[F.col(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    one = alike.groupBy(row).agg(F.min_by(F.struct(*docs.columns), order).alias("r"))
    return stay.unionByName(one.select("r.*"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item, each row by its own text."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] in place of secrets; all documents stay."""
    forest, clean = secret_forest.train(docs), _unused(docs, "clean")
    found = _beside(docs, lambda d: secret_forest.scan(d, forest), ["text", "source"], {clean: F.col("redacted")})
    return found.withColumns({"text": F.col(clean), "n_chars": F.length(clean).cast("long")}).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their number, and whether they decode to the text; an underscore follows a name that documents have already."""
    pieces = piece_codec.load()
    same = F.col("decoded") == F.coalesce(F.replace("text", F.lit("▁"), F.lit(" ")), F.lit(""))
    added = {"ids": F.col("ids"), "n_tokens": F.size("ids").cast("long"), "round_trip": same}
    return _beside(docs, lambda d: piece_codec.decode(piece_codec.encode(d, pieces), pieces), ["text"], {_unused(docs, k): v for k, v in added.items()})


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("secret scans", secrets), ("SentencePiece encoding and decoding", tokens)]

#: Language models, the forest and the tokenizer aren't SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
