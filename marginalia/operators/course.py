"""What a set of documents is about: its type, its topics and where they stand, and what assessments ask of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import priority
from marginalia.operators.priority import literals

#: Terms that tell a course's type, types in order of preference.
COURSE_TERMS = {
    "monte_carlo_sampling": ["monte carlo integration", "importance sampling", "self-normalised importance sampling", "self-normalized importance sampling", "proposal distribution", "importance weights", "mc estimator", "snis estimator"],
    "time_series": ["time series", "stationary process", "autocovariance", "autocorrelation", "ar(p)", "ma(q)", "arma", "arima", "arch", "spectral density", "periodogram", "ljung-box", "forecasting"],
    "spatial_statistics": ["spatial statistics", "random field", "semivariogram", "variogram", "kriging", "isotropy", "anisotropy", "point process", "sar", "car", "mrf"],
    "financial_math": ["black-scholes", "option", "portfolio", "martingale", "volatility", "arbitrage"],
    "statistics": ["estimator", "hypothesis test", "confidence interval", "likelihood", "regression"],
    "probability": ["random variable", "expectation", "martingale", "markov chain", "distribution"],
    "linear_algebra": ["matrix", "eigenvalue", "vector space", "linear transformation"],
    "calculus": ["derivative", "integral", "series", "differentiation"],
    "machine_learning": ["machine learning", "neural network", "classifier", "loss function", "gradient descent"],
    "generic_math": ["theorem", "definition", "lemma", "proof"],
}
#: What the evidence of a role says of a topic.
EXPLAINED = {"exam_guidance": "Exam guidance mentions %s.", "past_paper": "Past paper uses %s, so it is an assessment pattern signal.", "problem_sheet": "Problem sheet practises %s, so it is a skill signal.", "solution_sheet": "Solution sheet shows methods involving %s."}
NOTES = "Lecture notes provide source material for %s."
#: Verbs that ask for an item of a type.
REQUIRED = {"proof": r"prove|proof|show that|derive", "formula": r"formula|equation|calculate|compute", "theorem": r"theorem|state|result", "definition": r"definition|define|state"}
#: Words of calculations and of distinctions.
CALCULATES = r"\b(calculate|compute|estimate|derive|solve|predict|kriging|likelihood|valid)\b"
DISTINCT = r"\b(compare|distinguish|difference|versus|vs\.?|strict|weak|isotropic|anisotropic)\b"
#: The steps of a calculation by a word of it, first match wins.
STEPS = [
    (r"kriging", ["Identify covariance/variogram model", "Assemble covariance matrix and vector", "Solve weights", "Compute predictor and uncertainty"]),
    (r"covariance|positive", ["State required validity condition", "Check symmetry", "Check positive semi-definiteness"]),
    (r"likelihood", ["Write likelihood", "Simplify log-likelihood", "Differentiate or optimise", "Interpret estimator"]),
    (r"", ["Identify inputs", "Select the relevant formula or theorem", "Carry out calculation", "Interpret the result"]),
]
#: Signals of assessment sentences with what they add to the boost of their role.
SIGNALS = {"proof": (r"\b(prove|show that|derive)\b", 10), "calculation": (r"\b(calculate|compute|determine|estimate|forecast|fit|show whether|test)\b", 5), "formula": (r"\b(formula|statistic|equation|write down|state)\b", 0), "conceptual": (r"\b(compare|distinguish|explain the difference|versus|vs\.?|interpret)\b", 0)}
ROLE_BOOST = {"lecture_notes": 0, "exam_guidance": 20, "past_paper": 30, "problem_sheet": 20, "solution_sheet": 15, "formula_sheet": 10, "mark_scheme": 25, "other": 0}
ASSESSING = ("exam_guidance", "past_paper", "problem_sheet", "solution_sheet", "mark_scheme")
#: Lines that start a question, and its style by the first verbs that match.
QUESTION_START = r"(?i)^(question|problem|exercise)\s+[0-9]+[A-Za-z]?([).:\s]|$)|^([0-9]+|[a-z])\)\s+|^(show|prove|derive|calculate|compute|find|explain|state|define|estimate|simulate|discuss)\b"
STYLES = [("Proof or derivation question", r"\b(show|prove|derive)\b"), ("Calculation or applied method question", r"\b(calculate|compute|find|estimate|simulate)\b"), ("Short-answer conceptual question", r"\b(state|define|explain|discuss)\b")]


def with_names(rows: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """rows with held: those of names that the column text holds in any case, in the order of names."""
    # both go through an explode of their own, or Catalyst would lower the text for each name inside the lambda and filter again for an explode of held
    low = rows.withColumn("_low", F.explode_outer(F.array(F.lower(text))))
    return low.select(*rows.columns, "_low", F.explode_outer(F.array(F.filter(literals(names), lambda n: F.contains(F.col("_low"), F.lower(n))))).alias("held"))


def course_type(documents: DataFrame, by: str, name: str = "source", terms: dict[str, list[str]] = COURSE_TERMS, first: int = 20_000, least: int = 2) -> DataFrame:
    """by, course_type, score: the type most of whose terms stand in the names and first characters of a group's documents, unknown below least."""
    low = F.lower(F.concat_ws("\n", name, F.substring("text", 1, first)))
    words = sorted({t for ts in terms.values() for t in ts})
    at = {t: f"t{k}" for k, t in enumerate(words)}
    seen = documents.select(by, low.alias("_s")).groupBy(by).agg(*[F.max(F.contains(F.col("_s"), F.lit(t)).cast("int")).alias(at[t]) for t in words])
    scores = [F.struct(reduce(Column.__add__, [F.coalesce(F.col(at[t]), F.lit(0)) for t in ts]).alias("score"), F.lit(-k).alias("order"), F.lit(kind).alias("kind")) for k, (kind, ts) in enumerate(terms.items())]
    best = seen.select(by, F.array_max(F.array(*scores)).alias("b"))
    return best.select(by, F.when(F.col("b.score") >= least, F.col("b.kind")).otherwise("unknown").alias("course_type"), F.col("b.score").cast("long").alias("score"))


def title_seeds(titles: DataFrame, order: list[str], most: int = 30) -> DataFrame:
    """name, position of the first most distinct titles without their numbers, of 4 to 60 characters and without words of labels."""
    name = F.trim(F.regexp_replace("title", r"(?i)^(chapter|section)?\s*[0-9]+(\.[0-9]+)*\s*", ""))
    fit = titles.withColumn("name", name).where(F.length("name").between(4, 60) & ~F.col("name").rlike("(?i)definition|theorem|proof"))
    first = fit.groupBy("name").agg(F.min(F.struct(*order)).alias("_at")).orderBy("_at", "name").limit(most)
    return first.withColumn("position", F.row_number().over(Window.orderBy("_at", "name"))).select("name", "position")  # at most most rows


def topic_locations(pages: DataFrame, names: list[str], most: int = 8, before: int = 160, size: int = 700) -> DataFrame:
    """name, k, doc_id, page, excerpt: the first most pages that hold a name, with what stands around it."""
    hit = with_names(pages.select("doc_id", "page", "text"), names).select("doc_id", "page", "text", F.explode_outer("held").alias("name")).where("name is not null")
    first = hit.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("doc_id", "page"))).where(F.col("k") <= most)
    start = F.greatest(F.lit(1), F.position(F.lower("name"), F.lower("text")) - before)
    return first.select("name", "k", "doc_id", "page", X.collapse(F.substring(F.col("text"), start, F.lit(size))).alias("excerpt"))


def topics_missing(pages: DataFrame, names: list[str], candidates: DataFrame) -> DataFrame:
    """doc_id, page, name of pages that hold a name for which candidates(doc_id, page, concept) have no row: candidates to add."""
    hit = with_names(pages.select("doc_id", "page", "text"), names).select("doc_id", "page", F.explode_outer("held").alias("name")).where("name is not null")
    known = candidates.select("doc_id", "page", F.lower("concept").alias("_n"))
    return hit.withColumn("_n", F.lower("name")).join(known, ["doc_id", "page", "_n"], "left_anti").select("doc_id", "page", "name")


def filler_pages(pages: DataFrame, candidates: DataFrame, long: int = 50, enough: int = 80, least: int = 80) -> DataFrame:
    """doc_id, page in order, where there are more than long pages but fewer than enough candidates: pages with least characters, until enough."""
    n = pages.agg(F.count("*").alias("pages")).crossJoin(candidates.agg(F.count("*").alias("known")))  # two counts
    room = F.when((F.col("pages") > long) & (F.col("known") < enough), F.lit(enough) - F.col("known")).otherwise(0)
    some = pages.where(F.length(F.trim("text")) >= least).orderBy("doc_id", "page").limit(enough).select("doc_id", "page")
    ranked = some.withColumn("k", F.row_number().over(Window.orderBy("doc_id", "page")))  # at most enough rows
    return ranked.join(F.broadcast(n.select(room.alias("room")))).where(F.col("k") <= F.col("room")).select("doc_id", "page")


def chapters_of(sections: DataFrame) -> DataFrame:
    """doc_id, chapter, title, start, end, sections: sections(doc_id, number, title, start, end) by the first part of their number, else each by its title."""
    lead = F.nullif(F.regexp_extract(F.coalesce("number", F.lit("")), r"^([0-9]+)", 1), F.lit(""))
    keyed = sections.withColumns({"_c": lead, "chapter": F.coalesce(lead, F.col("title"))})
    got = keyed.groupBy("doc_id", "chapter").agg(F.max("_c").alias("_c"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("sections"))
    return got.select("doc_id", "chapter", F.when(F.col("_c").isNotNull(), F.concat(F.lit("Chapter "), "_c")).otherwise(F.col("chapter")).alias("title"), "start", "end", "sections")


def evidence_rows(evidence: DataFrame, pages: DataFrame, cut: int = 80, most: int = 360) -> DataFrame:
    """doc_id, role, phrase, sentence_index, page, excerpt, explanation; page is the first that holds the sentence's first cut characters."""
    e, p = evidence.alias("e"), pages.alias("p")
    held = (F.col("e.doc_id") == F.col("p.doc_id")) & F.contains(F.col("p.text"), F.substring("e.sentence", 1, cut))
    at = e.join(p, held, "left").groupBy("e.doc_id", "e.role", "e.phrase", "e.sentence_index", "e.sentence").agg(F.min("p.page").alias("page"))
    said = reduce(lambda c, r: c.when(F.col("role") == r, F.format_string(EXPLAINED[r], "phrase")), EXPLAINED, F.when(F.lit(False), "")).otherwise(F.format_string(NOTES, "phrase"))
    return at.select("doc_id", "role", "phrase", "sentence_index", "page", F.substring("sentence", 1, most).alias("excerpt"), said.alias("explanation"))


def required_signals(sentences: DataFrame, topics: list[tuple[str, str]], kinds: dict[str, str] = REQUIRED, most: int = 5) -> DataFrame:
    """kind, name, label, n, first_docs: what sentences outside the notes ask for, by the first topic (name, label) that they hold.

    A sentence without a topic counts for the first topic of all, and where there are none for its own first 60
    characters. label is the strongest of the topic's and of those before; first_docs are the documents of the first most.
    """
    names = [n for n, _ in topics]
    other = F.lit(names[0]) if names else F.substring("sentence", 1, 60)
    asks = F.array_compact(F.array(*[F.when(F.lower("sentence").rlike(v), k) for k, v in kinds.items()]))
    named = with_names(sentences.where("role <> 'lecture_notes'"), names, "sentence")
    each = named.select("doc_id", "sentence_index", F.coalesce(F.get("held", F.lit(0)), other).alias("name"), F.explode_outer(asks).alias("kind")).where("kind is not null")
    label = reduce(lambda c, t: c.when(F.col("name") == t[0], t[1]), topics, F.when(F.lit(False), "")).otherwise("medium")
    w = Window.partitionBy("kind", "name").orderBy("doc_id", "sentence_index")
    first = each.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("_k", "doc_id"))).alias("_f"))
    counted = each.groupBy("kind", "name").agg(F.count("*").alias("n")).join(first, ["kind", "name"])
    return counted.select("kind", "name", label.alias("label"), "n", F.transform("_f", lambda f: f["doc_id"]).alias("first_docs"))


def calculation_templates(sentences: DataFrame, names: list[str], pattern: str = CALCULATES, most: int = 4) -> DataFrame:
    """name, steps, n of topics with calculations in papers, sheets and solutions; steps follow from the words of the first most sentences."""
    asked = sentences.where(F.col("role").isin("past_paper", "problem_sheet", "solution_sheet") & F.lower("sentence").rlike(pattern))
    hit = with_names(asked, names, "sentence").select("doc_id", "sentence_index", "sentence", F.explode_outer("held").alias("name")).where("name is not null")
    first = hit.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("doc_id", "sentence_index"))).where(F.col("_k") <= most)
    said = first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "sentence"))), lambda s: s["sentence"]), " ").alias("_t"), F.count("*").alias("n"))
    low = F.lower(F.concat_ws(" ", "name", "_t"))
    steps = reduce(lambda c, r: c.when(low.rlike(r[0]), literals(r[1])), STEPS[1:-1], F.when(low.rlike(STEPS[0][0]), literals(STEPS[0][1]))).otherwise(literals(STEPS[-1][1]))
    return said.select("name", steps.alias("steps"), "n")


def distinctions(sentences: DataFrame, names: list[str], pattern: str = DISTINCT, most: int = 8) -> DataFrame:
    """k, name, concepts of the first most sentences outside the notes that compare: named after the first two topics that they hold."""
    first = sentences.where((F.col("role") != "lecture_notes") & F.lower("sentence").rlike(pattern)).orderBy("doc_id", "sentence_index").limit(most)
    k = F.row_number().over(Window.orderBy("doc_id", "sentence_index"))  # at most most rows
    held = with_names(first, names, "sentence").select(k.alias("k"), "sentence", F.col("held").alias("h"))
    name = F.when(F.size("h") >= 2, F.concat_ws(" vs ", F.get("h", F.lit(0)), F.get("h", F.lit(1)))).otherwise(F.substring("sentence", 1, 70))
    return held.select("k", name.alias("name"), F.when(F.size("h") > 0, F.col("h")).otherwise(literals(names[:2])).alias("concepts"))


def assessment_signals(sentences: DataFrame, names: list[str], signals: dict[str, tuple[str, int]] = SIGNALS) -> DataFrame:
    """signal, name, doc_id, sentence_index, boost of assessment sentences: the first topic that they hold, or their first 80 characters."""
    role = reduce(lambda c, r: c.when(F.col("role") == r[0], r[1]), ROLE_BOOST.items(), F.when(F.lit(False), 0)).otherwise(0)
    found = F.array_compact(F.array(*[F.when(F.lower("sentence").rlike(p), F.struct(F.lit(k).alias("signal"), F.lit(b).alias("extra"))) for k, (p, b) in signals.items()]))
    name = F.coalesce(F.get("held", F.lit(0)), F.substring("sentence", 1, 80))
    each = with_names(sentences.where(F.col("role").isin(*ASSESSING)), names, "sentence").select("doc_id", "sentence_index", name.alias("name"), role.alias("_r"), F.explode_outer(found).alias("s")).where("s is not null")
    return each.select("s.signal", "name", "doc_id", "sentence_index", (F.col("_r") + F.col("s.extra")).cast("long").alias("boost"))


def entity_scores(locations: DataFrame, adjustment: int = 0, most: int = 45) -> DataFrame:
    """name, score, label: 45 and the boosts of the roles of locations(name, role), together at most most, and an adjustment, within 0 to 100."""
    role = reduce(lambda c, r: c.when(F.col("role") == r[0], r[1]), ROLE_BOOST.items(), F.when(F.lit(False), 0)).otherwise(0)
    total = locations.groupBy("name").agg(F.least(F.lit(most), F.sum(role)).alias("b"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(45 + adjustment) + F.col("b"))).cast("long")
    return total.select("name", score.alias("score"), priority.score_label(score).alias("label"))


def question_patterns(lines: DataFrame, start: str = QUESTION_START, styles: list[tuple[str, str]] = STYLES, least: int = 24) -> DataFrame:
    """doc_id, position, style, evidence, practice: a question's first line and the two after it, which start no other question.

    lines(doc_id, line_index, line); blank ones don't count. Which starts are inside a question before is a fold
    over the places of one document's starts.
    """
    some = lines.select("doc_id", "line_index", X.collapse(F.col("line")).alias("t")).where("t <> ''")
    w = Window.partitionBy("doc_id").orderBy("line_index")
    seen = some.withColumns({"position": F.row_number().over(w), "body": X.collapse(F.concat_ws(" ", "t", F.lead("t", 1).over(w), F.lead("t", 2).over(w)))})
    starts = seen.where(F.col("t").rlike(start) & (F.length("body") >= least))
    grown = starts.groupBy("doc_id").agg(F.array_sort(F.collect_list("position")).alias("at"))
    taken = F.aggregate("at", F.array().cast("array<int>"), lambda a, p: F.when((F.size(a) == 0) | (p >= F.element_at(a, -1) + 3), F.concat(a, F.array(p))).otherwise(a))
    chosen = grown.select("doc_id", taken.alias("taken")).select("doc_id", F.explode_outer("taken").alias("position"))
    low = F.lower("body")
    style = reduce(lambda c, s: c.when(low.rlike(s[1]), s[0]), styles, F.when(F.lit(False), "")).otherwise("Assessment question pattern")
    practice = F.when(F.length("body") > 220, F.concat(F.trim(F.substring("body", 1, 217)), F.lit("..."))).otherwise(F.col("body"))
    return starts.join(chosen, ["doc_id", "position"]).select("doc_id", F.col("position").cast("long").alias("position"), style.alias("style"), F.substring("body", 1, 360).alias("evidence"), practice.alias("practice"))


def distinct_patterns(patterns: DataFrame, most: int = 8, least: float = 0.82) -> DataFrame:
    """patterns(doc_id, position, evidence, ...) without those more similar than least to one that stays before them, the first most of a document.

    Similar are sets of words of three characters on; two without such words aren't. A fold over a document's patterns that holds
    at most most of them.
    """
    row = F.struct("position", X.token_set(F.col("evidence")).alias("w"))
    kind = "array<struct<position:bigint,w:array<string>>>"

    def step(kept, r):
        def near(k):
            common = F.size(F.array_intersect(k["w"], r["w"]))
            return F.coalesce(common / F.nullif(F.size(F.array_union(k["w"], r["w"])), F.lit(0)) > least, F.lit(False))

        return F.when((F.size(kept) >= most) | F.exists(kept, near), kept).otherwise(F.concat(kept, F.array(F.struct(r["position"].cast("long").alias("position"), r["w"].alias("w")))))

    kept = patterns.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("doc_id", F.explode_outer(F.aggregate("rows", F.array().cast(kind), step)).alias("b"))
    return patterns.join(kept.where("b is not null").select("doc_id", F.col("b.position").alias("position")), ["doc_id", "position"], "left_semi")


def first_page_of(pages: DataFrame, terms: list[str]) -> DataFrame:
    """The first page (doc_id, page) in order that holds any of the terms."""
    held = with_names(pages, terms).select("doc_id", "page", F.explode_outer("held").alias("name")).where("name is not null")
    return held.agg(F.min(F.struct("doc_id", "page")).alias("p")).where("p is not null").select("p.doc_id", "p.page")


def missing_seeds(seeds: DataFrame, items: DataFrame) -> DataFrame:
    """seeds(front, ...) whose front no item(front) has, by its letters and digits alone."""
    return seeds.withColumn("_f", X.key_text(F.col("front"))).join(items.select(X.key_text(F.col("front")).alias("_f")), "_f", "left_anti").drop("_f")


def topics_of_files(files: DataFrame) -> DataFrame:
    """title, files, importance: topics guessed from the names of files(name, role), those of lecture notes first."""
    stem = F.substring(F.trim(F.regexp_replace(F.regexp_replace("name", r"\.[^.]+$", ""), "[_-]+", " ")), 1, 60)
    by = files.groupBy(stem.alias("_s")).agg(F.array_sort(F.collect_set("name")).alias("files"), F.bool_or(F.coalesce(F.col("role") == "lecture_notes", F.lit(False))).alias("_n"))
    return by.select(F.when(F.col("_s") == "", "Topic").otherwise(F.col("_s")).alias("title"), "files", F.when(F.col("_n"), "high").otherwise("medium").alias("importance"))
