"""The profile of a document from its line table: front matter, title, flags, type, notation, noise pages and confidence.

All functions take lines(doc_id, page, line_index, line, layer). Everything is conditional aggregation by document; what
has to be the first or the best of something is a minimum or maximum of a struct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Lines that can't be titles, whatever their length or up to a length (0: any).
NO_TITLE = [(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", 0), (r"(?i)\b(room|office)\s+[a-z]?\d{2,4}\b", 100), (r"(?i)\b(moodle|blackboard|canvas)\b", 0), (r"(?i)\bassessment\b", 160), (r"(?i)\bcourse\s+materials\b", 0), (r"(?i)^(department|faculty|school)\s+of\b", 0), (r"(?i)\b(lecture\s+notes|module\s+handout)\b", 42), (r"(?i)^(professor|prof\.|dr\.)\s+", 0), (r"(?i)\b(sw7|w12|postcode|postal|uk\s+\d)\b", 0), (r"(?i)^\[page\b", 0), (r"(?i)^(figure|fig\.|table)\s+\d+", 0), (r"(?i)\b(marks?|minutes\s+allowed|total\s+marks)\b", 120), (r"(?i)^(instructions|answer\s+all|attempt)\b", 0)]
NUMBERED = r"(?i)^\d+\.\d+\s+\S|^(theorem|lemma|proposition|definition|example|exercise)\s+\d"
CODE = r"\b([A-Z]{2,10}\d{3,6}[A-Z]?|[A-Z]{3,10}\s*\d{3,6}[A-Z]?)\b"
#: Parts of the front matter by the line that has them, first match wins.
FRONT = [("department", r"(?i)^(department|faculty|school)\s+of\b"), ("institution", r"(?i)^(imperial|university|college)\b"), ("contact", r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"), ("instructor", r"(?i)^(professor|prof\.|dr\.)\s+"), ("term", r"(?i)\b(autumn|spring|summer|winter|term)\s+\d{4}\b|\b20\d{2}\s*[-–]\s*20\d{2}\b"), ("admin", r"(?i)\b(moodle|blackboard|canvas)\b|\bassessment\b|\bcourse\s+materials\b")]
#: Lines that early titles skip, and the points of a title line (pattern, points); length and page give more.
SKIPPED = r"(?i)^(?:\[Page\s*\d+|\[Source\b|contents?$|table\s+of\s+contents$|module\s+code|credits?:|version\s+\d|last\s+updated|(chapter|section)\s+\d+|page\s+\d+\s+of\s+\d+|(department|faculty|school|institute)\s+of\b|(imperial|university|college|london|oxford|cambridge|mit|harvard)\b)"
POINTS = [(r"(?i)\b(analysis|statistics|probability|calculus|algebra|geometry|series|inference|modelling|modeling)\b", 2), (r"(?i)^(time\s+series|spatial|stochastic|numerical|bayesian)\b", 2)]
#: Signs of a document's parts, each a flag.
FLAGS = {
    "has_worked_examples": r"(?i)\bworked\s+example\b|^\s*example\s*[:.-]|\bexample\s*\(\s*\w+", "has_exercises": r"(?i)\b(exercise|problem)\s+\d|^\s*(question|problem)\s*\d", "has_proof_marks": r"(?i)^\s*proof\s*[.:]|\bshow\s+that\b|\b(lemma|theorem|proposition|corollary)\s+\d", "has_algorithms": r"(?i)\balgorithm\s+\d|\bpseudocode\b",
    "has_definitions": r"(?i)\bdefinition\s+\d|\bis\s+(called|defined\s+as)\b", "has_lemmas": r"(?i)\blemma\s+\d", "has_propositions": r"(?i)\bproposition\s+\d", "has_theorems": r"(?i)\btheorem\s+\d", "has_proofs": r"(?i)^\s*proof\s*[.:]", "has_examples": r"(?i)\bworked\s+example\b|\bexample\s+\d|\bfor\s+instance\b", "has_contents": r"(?i)\b(table\s+of\s+)?contents\b",
}
#: Notation with what it probably means.
NOTATION = [(r"\bX_t\b", "Time series value at time t"), ("μ", "Mean"), (r"\\mu\b", "Mean (LaTeX)"), ("σ", "Std dev / innovation scale"), (r"\\sigma\b", "Std dev (LaTeX)"), (r"(?i)\bs_tau\b|\bs_τ\b|γ\s*\(\s*τ\s*\)", "Autocovariance at lag τ"), (r"(?i)\brho_tau\b|ρ_τ|\brho\s*_\s*τ", "Autocorrelation at lag τ"), (r"(?i)\b(ε_t|epsilon_t)\b", "White-noise / innovation term"), (r"\bΦ\(B\)|\\Phi\(B\)", "AR polynomial in backshift"), (r"\bΘ\(B\)|\\Theta\(B\)", "MA polynomial in backshift"), (r"\bB\b(?=\s*\))", "Backshift operator")]
#: Words, in lower case, of which a text has one if the pattern matches it. They are looked for first: a pattern costs as much as dozens of words.
NEEDED = {p: words for (p, _), words in zip(NO_TITLE, ["@", "room office", "moodle blackboard canvas", "assessment", "course", "department faculty school", "lecture module", "prof dr.", "sw7 w12 post uk", "[page", "fig table", "mark minutes", "instructions answer attempt"], strict=True)}
NEEDED |= {p: words for (_, p), words in zip(FRONT, ["department faculty school", "imperial university college", "@", "prof dr.", "autumn spring summer winter term 20", "moodle blackboard canvas assessment course"], strict=True)}
NEEDED |= {p: words for p, words in zip(FLAGS.values(), ["example", "exercise problem question", "proof show lemma theorem proposition corollary", "algorithm pseudocode", "definition called defined", "lemma", "proposition", "theorem", "proof", "example instance", "contents"], strict=True)}
ADMIN = ("department", "institution", "contact", "instructor", "admin")
NOISE_WORDS = r"(?i)\b(T\s+is\s+z|Dopulation|fii+i+n\.?to|antititin|poputation|varience|covarance)\b"


def _first(found: Column, value: Column) -> Column:
    """The value of the first line in order where found."""
    return F.min(F.when(found, F.struct("page", "line_index", value.alias("v"))))["v"]


def _with_text(lines: DataFrame, text: Column) -> DataFrame:
    """lines with t, the text, and low, t in lower case.

    They go through outer explodes, so that they are computed once for each line: filters and aggregates on a plain column
    compute it again for each use.
    """
    return lines.withColumn("t", F.explode_outer(F.array(text))).withColumn("low", F.explode_outer(F.array(F.lower("t"))))


def _any_word(words: str) -> Column:
    return reduce(Column.__or__, [F.contains(F.col("low"), F.lit(w)) for w in words.split()])


def matches(pattern: str) -> Column:
    """Whether pattern matches t, of lines with t and low."""
    return _any_word(NEEDED[pattern]) & F.col("t").rlike(pattern)


def front_matter(lines: DataFrame, pages: int = 8, most: int = 24) -> DataFrame:
    """doc_id, code, department, institution, contact, instructor, term, title, title_page, chapter, chapter_title, people, admin_notes of the first pages.

    The title is the first line of 10 to 160 characters that nothing speaks against; what follows "Department of" is cut.
    people are the lines that name people, admin_notes the first most that are of administration, in order.
    """
    nxt = F.lead("line").over(Window.partitionBy("doc_id", "page").orderBy("line_index"))
    some = _with_text(lines.where(F.col("page").between(1, pages)).withColumn("_next", X.collapse(nxt)), X.collapse(F.col("line"))).where("t <> ''").withColumn("_part", X.first_match([(name, matches(p)) for name, p in FRONT], ""))
    n, part = F.length("t"), F.col("_part")
    spoken = reduce(Column.__or__, [matches(p) & ((n < most) if most else F.lit(True)) for p, most in NO_TITLE])
    cut = F.when(_any_word("department faculty"), F.trim(F.regexp_replace("t", r"(?i)\b(Department|Faculty)\s+of.+$", ""))).otherwise(F.col("t"))
    title = F.when(F.length(cut) >= 10, cut).otherwise(F.col("t"))
    titled = (n.between(10, 160)) & ~spoken & ~F.col("t").rlike(NUMBERED) & ~part.isin(*ADMIN)
    banner, bare = r"(?i)^Chapter\s*(\d+(?:\.\d+)?)\s*[.:]?\s+(.+)$", r"(?i)^Chapter\s*(\d+(?:\.\d+)?)\s*$"
    chapter = F.when(F.col("t").rlike(bare), F.struct(F.regexp_extract("t", bare, 1).alias("n"), F.when(F.length("_next").between(6, 119) & ~F.col("_next").rlike(r"^\d+\.\d+"), F.col("_next")).alias("t"))).when(F.col("t").rlike(banner), F.struct(F.regexp_extract("t", banner, 1).alias("n"), F.substring(F.regexp_extract("t", banner, 2), 1, 120).alias("t")))
    # only what is asked for of a line goes on to be sorted by document
    marked = some.withColumns({"_said": F.when(part != "", F.col("t")), "_title": F.when(titled, F.substring(title, 1, 120)), "_code": F.upper(F.regexp_replace(F.nullif(F.regexp_extract("t", CODE, 1), F.lit("")), r"\s+", "")), "_chapter": chapter})
    spot = F.struct("page", "line_index", "_said")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["_said"])
    by = marked.groupBy("doc_id").agg(
        _first(F.col("_code").isNotNull(), F.col("_code")).alias("code"), *[_first(F.col("_part") == p, F.col("_said")).alias(p) for p, _ in FRONT if p != "admin"],
        F.min(F.when(F.col("_title").isNotNull(), F.struct("page", "line_index", F.col("_title").alias("v")))).alias("_t"), _first(F.col("_chapter").isNotNull(), F.col("_chapter")).alias("_c"),
        listed(F.when(part == "instructor", spot)).alias("people"), F.slice(listed(F.when(part.isin(*ADMIN), spot)), 1, most).alias("admin_notes"),
    )
    return by.select("doc_id", "code", *[p for p, _ in FRONT if p != "admin"], F.col("_t.v").alias("title"), F.col("_t.page").alias("title_page"), F.col("_c.n").alias("chapter"), F.col("_c.t").alias("chapter_title"), "people", "admin_notes")


def early_title(lines: DataFrame, pages: int = 8) -> DataFrame:
    """doc_id, title, score, confidence, page: the best-scored line of the first pages; ties: the longer one, then the first."""
    some = _with_text(lines.where(F.col("page").between(1, pages) & (F.length(F.trim("line")) >= 4) & ~F.trim("line").rlike(SKIPPED)), X.collapse(F.col("line")))
    bare = X.collapse(F.regexp_replace(F.regexp_replace("t", r"(?i)^(.{11,}?)\b(Department|Faculty|School|Institute)\s+of\b.*$", "$1"), r"(?i)^(.{13,}?)\b(Professor|Prof\.|Dr\.)\s+[A-Z].*$", "$1"))
    some = some.withColumn("t", F.explode_outer(F.array(F.when(_any_word("department faculty school institute prof dr."), bare).otherwise(F.col("t"))))).drop("low")
    # what can end in a mark, or in one before a line's end, as $ has it
    some = some.withColumn("t", F.explode_outer(F.array(F.when(F.right("t", F.lit(1)).rlike(r"[,\s–\x{85}\x{2028}\x{2029}-]"), F.regexp_replace("t", r"[,\s–-]+$", "")).otherwise(F.col("t")))))
    n = F.length("t")
    #: Shapes of lines that can't be titles, and the points of the others.
    fits = n.between(8, 180) & (X.count_of(F.col("t"), r"\S+") <= 22) & (X.count_of(F.col("t"), "=") < 2) & ~((X.count_of(F.col("t"), "[∫∑∏√∂∇]") >= 2) & (n > 40)) & ~F.col("t").rlike(r"(?i)\b(theorem|lemma|proposition|definition)\s+\d|^\d+\.\d+") & ~(F.col("t").rlike(r"(?i)^(lecture\s+notes|module\s+handout|course\s+notes|autumn|spring|summer|term|year|20\d{2})") & (n < 30)) & (X.count_of(F.col("t"), "[A-Za-z]") / F.greatest(n, F.lit(1)) >= 0.45)
    module = r"\b[A-Z]{2,6}\s*\d{3,5}[A-Z]?\b"
    score = F.lit(3) + F.when(n.between(16, 90), 2).otherwise(0) + F.when(F.col("t").rlike(r"[—–-].{4,}") & F.col("t").rlike(module), 1).otherwise(0) - F.when(F.col("t").rlike(r"^[A-Z]{2,6}\s*\d{2,5}\b") & (n < 48) & ~F.col("t").rlike(r"(?i)\b(lecture|course|modelling|modeling|analysis|theory|methods)\b"), 4).otherwise(0)
    score = score + sum((F.when(F.col("t").rlike(p), k).otherwise(0) for p, k in POINTS), F.lit(0)) + F.when(F.col("t").rlike(r"(?i)\b(applied|mathematical|advanced|introduction\s+to)\b") & (n >= 12), 1).otherwise(0) + F.when(F.col("page") <= 2, 1).otherwise(0)
    best = some.where(fits).groupBy("doc_id").agg(F.max(F.struct(score.alias("score"), n.alias("n"), (-F.col("page")).alias("p"), (-F.col("line_index")).alias("l"), F.substring("t", 1, 160).alias("t"))).alias("b"))
    return best.select("doc_id", F.trim("b.t").alias("title"), F.col("b.score").alias("score"), F.round(F.least(F.lit(0.95), F.lit(0.42) + F.col("b.score") * 0.06), 2).alias("confidence"), (-F.col("b.p")).alias("page"))


def chosen_title(front: DataFrame, early: DataFrame, headings: DataFrame, files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, title, reason and the columns keep of front for each row of files(doc_id, name): front matter, a sure early line, the first chapter heading, an early line, the file's name.

    headings(doc_id, page, line_index, line, kind, rejection_reason) are those of structure.headings.
    """
    first = headings.where("kind = 'chapter' and rejection_reason is null").groupBy("doc_id").agg(F.min(F.struct("page", "line_index", F.substring(X.collapse(F.col("line")), 1, 160).alias("v")))["v"].alias("_h"))
    stem = F.trim(F.regexp_replace(F.regexp_replace("name", r"\.[^.]+$", ""), "[_-]+", " "))
    every = files.select("doc_id", F.when(F.length(stem).between(4, 119), stem).alias("_f")).join(front.select("doc_id", F.col("title").alias("_m"), *keep), "doc_id", "left").join(early.select("doc_id", F.col("title").alias("_e"), F.col("confidence").alias("_c"), F.col("page").alias("_p")), "doc_id", "left").join(first, "doc_id", "left")
    sure = F.col("_e").isNotNull() & (F.col("_c") >= 0.48) & (F.col("_p") <= 14)
    ranked = [(F.col("_m").isNotNull(), "_m", "explicit_front_matter_title"), (sure, "_e", "early_page_title_inference"), (F.length("_h") >= 6, "_h", "first_top_level_heading_candidate"), (F.col("_e").isNotNull(), "_e", "early_page_title_inference_weak"), (F.col("_f").isNotNull(), "_f", "document_file_fallback")]
    title, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for holds, column, why in ranked:
        title, reason = title.when(holds, F.col(column)), reason.when(holds, why)
    return every.select("doc_id", title.alias("title"), reason.otherwise("no_reliable_title").alias("reason"), *keep)


def flags(lines: DataFrame) -> DataFrame:
    """doc_id, pages, lines, the flags of FLAGS, formula_signs, past_paper, solutions, hand_share and type: what the lines show.

    The type weighs structure (chapters, sections), cues of lecture notes, exam words, questions with marks, headings of
    solutions and the share of signs, in the order of the rules below.
    """
    lines, t = _with_text(lines, F.trim("line")), F.col("t")
    any_ = lambda p: F.coalesce(F.bool_or(matches(p) if p in NEEDED else t.rlike(p)), F.lit(False))
    n = lambda p: F.coalesce(F.sum(X.count_of(t, p)), F.lit(0))
    # signs other than = are beyond ASCII, so that a text without either has none
    signs = lambda p: F.coalesce(F.sum(F.when(F.contains(t, F.lit("=")) | (F.octet_length(t) > F.length(t)), X.count_of(t, p)).otherwise(0)), F.lit(0))
    rows = lambda p: F.count_if(t.rlike(p))
    early = lambda p: F.coalesce(F.bool_or((F.col("page") <= 18) & t.rlike(p)), F.lit(False))
    short = F.length(t) <= 180
    #: The patterns, points and borders of a document's type, from here to the rules of kind.
    solved = F.sum(F.when(~short | t.rlike("(?i)worked\\s+example"), 0).when(t.rlike(r"(?i)^solutions?\s+to\b"), 2).when(t.rlike(r"(?i)^solutions?\s*[.:]?\s*$"), 3).when(t.rlike(r"(?i)^solution\s+\d+[.:)]"), 2).when(t.rlike(r"(?i)^answers?\s*[.:]?\s*$"), 2).when(t.rlike(r"(?i)mark\s+scheme|examiner\s+report|official\s+solutions"), 4).otherwise(0))
    by = lines.groupBy("doc_id").agg(
        F.max("page").alias("pages"), F.count("*").alias("lines"), F.sum(F.length("line") + 1).alias("_size"), *[any_(p).alias(k) for k, p in FLAGS.items()], signs("[=∑∫∇∂′″√〈〉]").alias("formula_signs"), signs("[=∫∑∏√∂∇]").alias("_signs"), n(r"(?i)\b(the|and|therefore|because|however)\b").alias("_prose"),
        rows(r"(?i)^chapter\s+\d").alias("_chapters"), rows(r"^\d{1,2}(\.\d{1,2}){1,2}\s+\S").alias("_sections"), early(r"(?i)\bchapter\s+\d+").alias("_c1"), early(r"(?i)\d+\.\d+\s+[a-z]").alias("_c2"), any_(r"(?i)\b(lecture\s+notes|course\s+notes|module\s+handout)\b").alias("_c3"), early(r"(?i)\b(imperial|department|faculty)\b").alias("_c4"),
        early(r"(?i)\bcontents\b").alias("_toc"), any_(r"\d{1,2}\s+[A-Za-z].{6,120}(\.{2,}|…|\s{4,})\s*\d{1,3}$").alias("_leaders"), n(r"(?i)\b\d+\s*(marks?|pts?)\b").alias("_marks"), rows(r"(?i)^(question|problem)\s+\d{1,2}\s*[.:)]").alias("_questions"), any_(r"(?i)\b(marks?|points?)\b").alias("_points"),
        any_(r"(?i)\b(total\s+marks|minutes\s+allowed|time\s+allowed|candidate\s+number|desk\s+number)\b").alias("_exam1"), any_(r"(?i)\b(final\s+exam|examination|past\s+paper)\b").alias("_exam2"), any_(r"(?i)\b(problem\s+sheet|homework\s*\d|assignment\s*\d|due\s+date)\b").alias("_sheet"), solved.alias("_solved"), any_(r"(?i)\b(answer\s+key|official\s+solutions)\b").alias("_key"),
        any_(r"(?i)\b(cram|must\s+know|checklist|exam\s+tips|last\s+minute|revision\s+guide|key\s+ideas)\b").alias("_cram"), rows(r"(?i)^(question\s+\d|(q\.?|part)\s*\d)").alias("_parts"), rows(r"(?i)^(solution|answer|mark\s+scheme)\b").alias("_answers"), F.sum(F.when(F.col("layer") == "handwritten", F.length("line")).otherwise(0)).alias("_hand"), F.sum(F.when(F.col("layer") == "printed", F.length("line")).otherwise(0)).alias("_printed"),
    )
    c = F.col
    yes = lambda holds, k: F.when(holds, k).otherwise(0)
    lecture = F.when(c("_chapters") >= 2, 5).when(c("_chapters") >= 1, 3).otherwise(0) + F.when(c("_sections") >= 15, 5).when(c("_sections") >= 10, 4).when(c("_sections") >= 6, 2).when(c("_sections") >= 3, 1).otherwise(0) + yes(c("_c1"), 3) + yes(c("_c2"), 2) + yes(c("_c3"), 3) + yes(c("_c4") & (c("_chapters") >= 1), 1) + yes(c("_toc") & c("_leaders"), 7)
    exam, sheet = c("_exam1") & c("_exam2"), (c("_marks") >= 10) | ((c("_questions") >= 14) & c("_points")) | (c("_sheet") & (c("_questions") >= 8))
    answers = (c("_solved") >= 16) | ((c("_solved") >= 9) & c("_key"))
    signs = (c("_size") > 400) & (c("_signs") > F.greatest(F.lit(25.0), c("_size") / 90)) & (c("_prose") < c("_size") / 420)
    kind = X.first_match([
        ("revision_guide", c("_cram") & (c("_chapters") < 2) & (lecture < 8) & ~exam & ~answers), ("formula_sheet", signs & ~exam & (lecture < 6) & (c("_chapters") < 2) & ~sheet), ("past_paper", exam & (lecture < 7)), ("problem_sheet", sheet & (lecture < 8) & ~answers),
        ("lecture_notes", (lecture >= 6) | ((c("_chapters") >= 1) & (c("_sections") >= 8))), ("solutions", answers & (lecture < 7)), ("mixed", answers), ("lecture_notes", (c("_chapters") >= 1) | (c("_sections") >= 5)), ("problem_sheet", sheet),
    ], "unknown")
    past, solutions = c("_exam1") & (c("_parts") > 0), (c("_answers") >= 10) & ~(c("_c1") & (c("_answers") < 14))
    share = c("_hand") / F.greatest(F.lit(1), c("_printed") + c("_hand"))
    return by.select("doc_id", "pages", "lines", *FLAGS, "formula_signs", past.alias("past_paper"), solutions.alias("solutions"), F.round(share, 4).alias("hand_share"), kind.alias("type"))


def notation(lines: DataFrame, most: int = 48) -> DataFrame:
    """doc_id, meaning, hits of notation, the first most of a document."""
    hits = [F.sum(X.count_of(F.col("line"), p)).alias(f"n{k}") for k, (p, _) in enumerate(NOTATION)]
    rows = F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, F.struct(F.col(f"n{k}").alias("hits"), F.lit(-k).alias("k"), F.lit(m).alias("meaning"))) for k, (_, m) in enumerate(NOTATION)]))
    best = F.slice(F.sort_array(rows, asc=False), 1, most)
    return lines.groupBy("doc_id").agg(*hits).select("doc_id", F.explode_outer(best).alias("b")).where("b is not null").select("doc_id", F.col("b.meaning").alias("meaning"), F.col("b.hits").alias("hits"))


def noise_pages(lines: DataFrame, most: int = 120) -> DataFrame:
    """doc_id, page, score, examples (at most four) of pages with noise, or handwriting where a page has no noise, that looks bad enough."""
    marked = lines.where(F.col("layer").isin("noise", "handwritten")).withColumn("_noise", F.max((F.col("layer") == "noise").cast("int")).over(Window.partitionBy("doc_id", "page")))
    use = marked.where((F.col("layer") == "noise") | (F.col("_noise") == 0)).withColumn("t", X.collapse(F.col("line")))
    n, share = F.length("t"), X.count_of(F.col("t"), "[A-Za-z0-9]") / F.greatest(F.length("t"), F.lit(1))
    bad = n.between(5, 90) & (F.col("t").rlike(NOISE_WORDS) | (~((share >= 0.58) & (X.count_of(F.col("t"), r"\S+") >= 6)) & ((share < 0.48) | (n <= 16) | F.col("t").rlike(r"\S{22,}|[!?.]{3,}"))))
    by = use.groupBy("doc_id", "page").agg(F.count("*").alias("_n"), F.slice(F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("line_index", "t")))), lambda s: s["t"]), 1, 4).alias("examples"))
    score = F.least(F.lit(28), F.col("_n") * 4 + F.when(F.exists("examples", lambda e: e.rlike(NOISE_WORDS)), 6).otherwise(0))
    found = by.where(F.size("examples") > 0).withColumn("score", score).where("score >= 5")
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("_k") <= most).select("doc_id", "page", "score", "examples")


def confidence(titled: Column, chapters: Column, contents: Column, topics: Column) -> Column:
    """How sure a profile is: a title, five chapters, contents and eight topics add to it."""
    return F.round(F.least(F.lit(0.95), F.lit(0.45) + F.when(titled, 0.18).otherwise(0) + F.when(chapters >= 5, 0.15).otherwise(0) + F.when(contents, 0.12).otherwise(0) + F.when(topics >= 8, 0.08).otherwise(0)), 2)


def contents_failed(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc_id of documents with a contents banner and rows of contents, but without a chapter in chapters(doc_id)."""
    t = F.trim("line")
    leaders = t.rlike(r"^\d{1,2}(\.\d+){0,2}\s+.{6,180}?(\.{3,}|…|(\s\.){3,}|\s{5,})\s*\d{1,4}$|^[A-Za-z][^.]{6,140}(\.{3,}|…|(\s\.){3,}|\s{5,})\s*\d{1,4}$")
    shown = lines.groupBy("doc_id").agg(F.bool_or(t.rlike(FLAGS["has_contents"])).alias("_b"), F.bool_or(leaders).alias("_l")).where("_b and _l").select("doc_id")
    return shown.join(chapters.select("doc_id").distinct(), "doc_id", "left_anti")


def span_texts(lines: DataFrame, spans: DataFrame, least: int = 8) -> DataFrame:
    """doc_id, heading, start, end, text of spans(doc_id, heading, start, end: closed page ranges): the lines of their pages; shorter texts are left out.

    Blocks that share heading and span with another one count once.
    """
    l, s = lines.alias("l"), spans.select("doc_id", "heading", "start", "end").distinct().alias("s")
    inside = (F.col("l.doc_id") == F.col("s.doc_id")) & F.col("l.page").between(F.col("s.start"), F.col("s.end"))
    held = l.join(s, inside).groupBy("s.doc_id", "s.heading", "s.start", "s.end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l.page", "l.line_index", "l.line"))), lambda r: r["line"]), "\n").alias("text"))
    return held.where(F.length(F.trim("text")) >= least)


def split_spans(spans: DataFrame, most: int = 12) -> DataFrame:
    """spans(doc_id, heading, start, end) cut into ranges of at most most pages; part counts them from 0."""
    n = F.ceil((F.col("end") - F.col("start") + 1) / most).cast("int")
    each = spans.select("doc_id", "heading", "start", "end", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("part"))
    start = F.col("start") + F.col("part") * most
    return each.select("doc_id", "heading", "part", start.alias("start"), F.least("end", start + most - 1).alias("end"))
