"""Raw candidates of nine types from the printed lines of pages; no candidate crosses a page.

Runs of formula lines and examples with their solutions are folds over one page's lines, labelled blocks are
spans.block_spans. Blank lines count as places, but aren't part of a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

from . import spans

#: Signs of formulas, words around them, starts of labelled blocks, and lines that end a proof.
TRIGGERS = r"[=∫∑√×^_→⇒⇔≤≥≈∝∂∇]|\\int|\\sum|\\partial|\\nabla|⟨|⟩|〈|〉|\|\s*\||\|\||\bcov\b|\bvar\b|\bVar\b|\bstd\b|\bMSE\b|\bRMSE\b|\bRAE\b|\bE\s*\{|\bE\s*\[|\bP\s*\(|\blog\b|\bexp\b|\bargmin\b|\bargmax\b|\bsup\b|\binf\b|\bdet\b|\btr\b|d\s*/\s*d\s*t|\bgrad\b|\bdiv\b|\bcurl\b|[φϕδσμλπ]"
CONTEXT = r"(?i)\b(defined\s+as|given\s+by|we\s+define|satisfies|where|hence|therefore|model|estimator|likelihood|density|prior|posterior|covariance|curvature|transition|kernel|differential\s+equation|loss|objective|constraint|theorem|proposition)\b"
DEFINITION, RESULT, ALGORITHM = r"(?i)^Definition\s+[0-9.]+", r"(?i)^(Theorem|Proposition|Lemma|Corollary)\s+[0-9.]+", r"(?i)^Algorithm\s+[0-9.]+"
EXERCISE, EXAMPLE, SOLUTION = r"(?i)^(exercise|problem|question)\s+[0-9.]+[.:)]?\s+", r"(?i)^(Example|Exercise|Question)\s+[0-9.]+", r"(?i)^Solution[.:]?\b"
PROOF, NO_PAIR = r"(?i)^(proof|worked\s+example|example)\b|^show\s+that|^check\s+that|^derive\b|^determine\s+whether", r"(?i)^(Theorem|Lemma|Definition|Proposition|Chapter)\b"
BOUNDARY = r"(?i)^(theorem|lemma|proposition|corollary|definition|remark|example|exercise|question|algorithm)\b|^Proof[.:]?\b|^Chapter\s*[0-9]|^Section\s+[0-9]|^(?=.{1,139}$)(?![0-9]+\.[0-9])[0-9]{1,2}\s+[A-Za-zÀ-ɏ(]|^[0-9]+(\.[0-9]+){1,3}\s+\S"
INFORMAL = r"(?i)\b(we\s+define|recall\s+that|throughout\s+we\s+assume|throughout\s+this)\b"
BROKEN = r"(?i)\b(therfore|varience|poputation|fii+i+n|Dopulation)\b"
CHAIN_STOP = r"(?i)^(theorem|lemma|proposition|corollary|definition|remark|example|exercise|question|algorithm)\s+[0-9.]+|^Chapter\s*[0-9]|^[0-9]+\.[0-9]+\s+\S"
REASONS, SIGNS = r"(?i)^(hence|therefore|thus|it\s+follows|we\s+have|observe\s+that)\b", "[=∫∑∂]"
#: Type, start, stop, most lines and characters, least characters, excerpt, confidence, reason and how many of a document.
BLOCKS = [
    ("proof", PROOF, BOUNDARY, 120, 3500, 12, 420, 0.72, "block_starting_with_proof_or_example_marker", 400), ("exercise", EXERCISE, r"(?i)^(theorem|lemma|proof|chapter|section)\b", 45, 2800, 16, 400, 0.68, "exercise_problem_question_stem_block", 200),
    ("definition", DEFINITION, rf"{RESULT}|^Proof[.:]?\b", 35, 2800, 20, 400, 0.7, "definition_labelled_block", 200), ("theorem", RESULT, rf"{DEFINITION}|^Proof[.:]?\b", 35, 2800, 20, 400, 0.7, "theorem_like_labelled_block", 200), ("method_template", ALGORITHM, rf"{DEFINITION}|{RESULT}", 55, 4000, 24, 420, 0.66, "algorithm_block", 80),
]
SPAN = "array<struct<first:int,last:int,text:string>>"


def _pages(lines: DataFrame, *flags: Column) -> DataFrame:
    """doc_id, page, rows: a page's lines in order, with flags of the trimmed line t."""
    t = lines.select("doc_id", "page", "line_index", F.trim("line").alias("t"))
    return t.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_index", "t", *flags))).alias("rows"))


def _push(a, done: str = "done"):
    return F.concat(a[done], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"), a["text"].alias("text"))))


def _spans(pages: DataFrame, start: Column, step, end) -> DataFrame:
    each = pages.select("doc_id", "page", F.explode_outer(F.aggregate("rows", start, step, end)).alias("b")).where("b is not null")
    return each.select("doc_id", "page", F.col("b.first").alias("first_line"), F.col("b.last").alias("last_line"), F.col("b.text").alias("text"))


def formula_runs(lines: DataFrame, triggers: str = TRIGGERS, most: int = 8) -> DataFrame:
    """doc_id, page, first_line, last_line, text: runs of up to most lines of lines(doc_id, page, line_index, line) with signs of a formula.

    A run begins with a line of 8 to 500 characters that has one and doesn't begin with a relation, and goes on over
    lines that have one or begin with a sign, to a line that doesn't.
    """
    t, n = F.col("t"), F.length("t")
    begins = n.between(8, 500) & t.rlike(triggers) & ~t.rlike("^[=≤≥<>]")
    goes_on = n.between(1, 500) & (t.rlike(triggers) | t.rlike(r"^[=+\-]"))
    kind = f"struct<done:{SPAN},first:int,last:int,text:string>"
    none = F.struct(F.array().cast(SPAN).alias("done"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit("").alias("text")).cast(kind)
    closed = lambda a: F.when(a["first"] >= 0, _push(a)).otherwise(a["done"])

    def step(a, r):
        on = (a["first"] >= 0) & r["c"] & (r["line_index"] - a["first"] < most)
        more = F.struct(a["done"].alias("done"), a["first"].alias("first"), r["line_index"].alias("last"), F.concat(a["text"], F.lit("\n"), r["t"]).alias("text"))
        new = F.struct(closed(a).alias("done"), F.when(r["s"], r["line_index"]).otherwise(-1).alias("first"), r["line_index"].alias("last"), F.when(r["s"], r["t"]).otherwise("").alias("text"))
        return F.when(on, more.cast(kind)).otherwise(new.cast(kind))

    return _spans(_pages(lines, begins.alias("s"), goes_on.alias("c")), none, step, closed)


def example_solutions(lines: DataFrame) -> DataFrame:
    """doc_id, page, first_line, last_line, text: examples, exercises and questions with the solution that follows within 40 lines.

    What starts a chapter or a formal result before the solution, or another example, breaks the search off; the text goes on
    after the solution to the next boundary, at most 50 lines or 4,000 characters.
    """
    t = F.col("t")
    flags = [t.rlike(EXAMPLE).alias("e"), t.rlike(NO_PAIR).alias("x"), t.rlike(SOLUTION).alias("s"), t.rlike(BOUNDARY).alias("b")]
    kind = f"struct<done:{SPAN},first:int,last:int,text:string,sol:int>"
    make = lambda done, first, last, text, sol: F.struct(done.alias("done"), first.alias("first"), last.alias("last"), text.alias("text"), sol.alias("sol")).cast(kind)
    no = F.lit(-1)
    none = make(F.array().cast(SPAN), no, no, F.lit(""), no)
    closed = lambda a: F.when(a["sol"] >= 0, _push(a)).otherwise(a["done"])

    def step(a, r):
        at = r["line_index"]
        longer = F.concat(a["text"], F.lit("\n"), r["t"])
        ends = (a["sol"] >= 0) & (((at > a["sol"] + 2) & r["b"]) | (at >= a["sol"] + 50) | (F.length(a["text"]) > 4000))
        fails = (a["first"] >= 0) & (a["sol"] < 0) & (r["x"] | r["e"] | (at >= a["first"] + 40))
        fresh = (a["first"] < 0) | ends | fails
        new = make(closed(a), F.when(r["e"], at).otherwise(no), at, F.when(r["e"], r["t"]).otherwise(""), no)
        more = make(a["done"], a["first"], at, longer, F.when((a["sol"] < 0) & r["s"], at).otherwise(a["sol"]))
        return F.when(fresh, new).otherwise(more)

    return _spans(_pages(lines, *flags), none, step, closed)


def formula_kind(text: Column) -> Column:
    """raw_equation, formula_name, broken_math or concept_formula."""
    n, digits, letters, words = F.length(text), X.count_of(text, "[0-9]"), X.count_of(text, "[A-Za-z]"), X.count_of(text, "[A-Za-z]{4,}")
    signs = text.rlike(r"[=∫∑∂∇√]|\\(frac|sum|int|partial|nabla|mathbb|mathrm|hat|bar)")
    broken = text.rlike(BROKEN) | ((n > 12) & (digits / F.greatest(n, F.lit(1)) > 0.42) & (letters < 4))
    return X.first_match([("broken_math", broken), ("raw_equation", signs & (n < 520)), ("formula_name", words.between(1, 8) & (n < 110) & ~signs)], "concept_formula")


def _chains(blocks: DataFrame) -> DataFrame:
    """Blocks led by a result that hold a proof, or three steps of reasoning."""
    lines = F.split("text", "\n")
    proof = F.exists(lines, lambda t: t.rlike(r"(?i)^Proof[.:]?\b"))
    steps = F.aggregate(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda t: t.rlike(REASONS).cast("int") + (t.rlike(SIGNS) & (F.length(t) < 400)).cast("int")), F.lit(0), lambda a, b: a + b)
    return blocks.withColumns({"_proof": proof, "_steps": steps}).where("_proof or _steps >= 3")


def raw_candidates(lines: DataFrame) -> DataFrame:
    """doc_id, page, type, first_line, last_line, text, excerpt, confidence, reason, cleanup, formula_kind of all nine kinds of candidates.

    lines(doc_id, page, line_index, line) are printed ones. Of each reason the first so many of a document are kept, repeated
    ones (page, line, type and first 80 characters) once, by the earlier rule. A block ends at the next label, also on the line right after its own.
    """
    full = lines.where(F.trim("line") != "").withColumns({"line": F.trim("line"), "_page": F.struct("doc_id", "page")})
    no = F.lit(None).cast("string")

    found: list[DataFrame] = []

    def row(df: DataFrame, kind, least: int, cut: int, excerpt: int, confidence, reason, cleanup, most: int, formula=no) -> DataFrame:
        col = lambda v: v if isinstance(v, Column) else F.lit(v)
        text = F.trim("text")
        return df.where(F.length(text) >= least).select(
            "doc_id", "page", col(kind).alias("type"), "first_line", "last_line", F.substring(text, 1, cut).alias("text"), F.substring(text, 1, excerpt).alias("excerpt"), col(confidence).alias("confidence"), col(reason).alias("reason"), col(cleanup).alias("cleanup"), formula.alias("formula_kind"), F.lit(most).alias("_most"), F.lit(len(found)).alias("_rank"),
        )

    of_page = lambda start, stop, n, chars: spans.block_spans(full, start, stop, n, chars, "_page").select("_page.doc_id", "_page.page", "first_line", "last_line", "text")
    for kind, start, stop, n, chars, least, excerpt, sure, reason, most in BLOCKS:
        name = F.when(F.col("text").rlike("(?i)^(example|worked)"), "worked_example").otherwise("proof") if kind == "proof" else kind
        found.append(row(of_page(start, stop, n, chars), name, least, 4000, excerpt, sure, reason, "ok", most))
    chains = _chains(of_page(RESULT, CHAIN_STOP, 120, 4500))
    yes = F.col("_proof")
    found.append(row(chains, "proof", 40, 4500, 420, F.when(yes, 0.74).otherwise(0.55), F.when(yes, "theorem_or_lemma_then_proof_block").otherwise("theorem_or_lemma_then_reasoning_chain"), F.when(yes, "ok").otherwise("needs_review"), 120))
    found.append(row(example_solutions(lines), "worked_example", 24, 4000, 420, 0.75, "example_or_exercise_then_solution", "ok", 120))
    shape = formula_kind(F.col("text"))
    found.append(row(formula_runs(lines), "formula", 1, 4000, 400, F.when(F.col("text").rlike(CONTEXT), 0.78).otherwise(0.55), "formula_like_printed_line", F.when((F.length("text") > 200) | (shape == "broken_math"), "needs_review").otherwise("ok"), 2500, shape))
    said = full.where(F.length("line").between(24, 320) & F.col("line").rlike(INFORMAL) & ~F.col("line").rlike(f"{DEFINITION}|{RESULT}")).select("doc_id", "page", F.col("line_index").alias("first_line"), F.col("line_index").alias("last_line"), F.col("line").alias("text"))
    found.append(row(said, "concept", 24, 320, 360, 0.52, "informal_definition_or_recall_line", "needs_review", 200))
    every = reduce(DataFrame.unionByName, found)
    alike = Window.partitionBy("doc_id", "page", "first_line", "type", F.substring("text", 1, 80)).orderBy("_rank", "reason")
    once = every.withColumn("_k", F.row_number().over(alike)).where("_k = 1")
    first = Window.partitionBy("doc_id", "reason").orderBy("page", "first_line", "text")
    return once.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= F.col("_most")).drop("_k", "_most", "_rank")
