"""From candidates to decided items: projection, relevance, gates, and the cards, sheets and counts made of a pack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import gates
from marginalia.operators.curate import THEOREM_LIKE

#: Terms of central topics and of central formulas.
TOPIC_TERMS = [
    "monte carlo integration", "test function", "empirical distribution", "dirac delta measure", "importance sampling", "proposal distribution", "importance weights", "self-normalised importance sampling", "self-normalized importance sampling", "random field", "random vector", "stationarity", "strict stationarity", "weak stationarity",
    "intrinsic stationarity", "isotropy", "covariance", "semivariogram", "variogram", "kriging", "blup", "matheron", "estimator", "gaussian", "poisson", "conditional distribution", "white noise", "ma(q)", "ar(p)", "arma(p,q)", "arch(p)", "arima", "general linear process", "autocovariance sequence", "autocorrelation sequence", "toeplitz",
    "roots outside the unit circle", "periodogram", "spectral representation theorem", "integrated spectrum", "direct spectral estimator", "tapering", "ljung-box", "forecasting",
]
FORMULA_TERMS = [
    "monte carlo estimator", "mc estimator", "mc variance", "empirical variance estimate", "importance sampling estimator", "is estimator", "is variance", "optimal proposal", "self-normalised importance sampling", "self-normalized importance sampling", "snis estimator", "snis mse bound", "semivariogram", "variogram", "covariance function",
    "blup", "kriging predictor", "kriging system", "ordinary kriging", "simple kriging", "poisson process", "likelihood", "intensity", "conditional distribution", "local characteristic", "sar", "car", "autocovariance", "autocorrelation", "stationarity condition", "invertibility condition", "backshift", "arima", "periodogram", "spectral density", "ljung-box", "forecast",
]
#: Signs of a bibliography with their points, of which three make one; the sign of noise is a share of odd symbols.
BIBLIOGRAPHY = [
    (r"\[[A-Z]{1,4}\]\s+[A-Z][A-Za-z-]+,", 3), (r"\b(19|20)\d{2}\b", 1), (r"(?i)\b(CRC Press|Springer|Wiley|John Wiley|Cambridge|Oxford|Chapman|Hall|Routledge|Elsevier)\b", 3), (r"(?i)\b(bibliography|references|reading list|textbook|publisher|press|edition|isbn|pages?\s+\d+)", 2),
    (r"([A-Z][A-Za-z-]+,\s+[A-Z][A-Za-z-]+(,| and)\s*)+", 2), (r"(?i)\bTheory of\b|\bStatistics for\b|\bIntroduction to\b|\bSpatial statistics\b", 1), (r"(?i)john wiley & sons", 3),
]
ODD = r"[^A-Za-z0-9\s.,;:()\[\]{}_^=+\-*/\\]"
GENERIC = r"(?i)^(definition|theorem|formula|remark|question|example)(\s+\d+(\.\d+)*)?$"
#: Words of guidance and of statements that the decisions rest on.
STRONG = r"\bmust|required|examinable|derive|prove|state|use|know\b"
PROOF_ASKED = r"\b(prove|proof required|derive|show that)\b"
NOT_ASKED = r"\bnot required|excluded|do not need|without proof|proofs? are not required\b"
DEFINES = r"\b(is|are|called|defined as|we say that|denotes|consists of|if and only if)\b"
METHOD = r"\b(set up|calculate|compute|algorithm|procedure|steps|solve|estimate|predict|derive|use|estimator)\b|\bimportance sampling|monte carlo|rare events?|kriging system|likelihood|estimator|predictor\b"
TRAP = r"\b(condition|equivalent|not necessarily|only if|if and only if|trap|important|note that|therefore|distinction|assumption|required|valid|applies)\b"
TRAP_OF = r"\b(random field|process|covariance|stationary|gaussian|kriging|intensity|distribution|theorem|definition|formula|variogram)\b"
NAMED_BY = (r"\b(is|are|defined by|given by)\b", r"\b(monte carlo|importance sampling|snis|estimator|variance|semivariogram|variogram|kriging|blup|likelihood|intensity|covariance)\b")
TAGS = ["monte carlo", "importance sampling", "snis", "estimator", "variance", "stationarity", "covariance", "variogram", "semivariogram", "kriging", "blup", "proof", "formula", "theorem", "algorithm", "poisson", "gaussian"]
#: Prompts by purpose, then by type.
PROMPTS = {"model_definition": "Write the model and key properties.", "condition_recall": "State the condition and when it applies.", "test_statistic": "State the hypotheses, statistic, and decision rule.", "worked_example_pattern": "Recall the problem type and solution pattern.", "conceptual_distinction": "Explain the difference and implication relationship.", "calculation_template": "Set up the calculation template.", "method_steps": "Recall the method steps.", "application_condition": "State when this applies."}
TYPE_PROMPTS = {"definition": "Recall the exact definition.", "formula": "Write down the formula and explain each term."}
KIND_PURPOSES = {"calculation_template": "calculation_template", "worked_example": "worked_example_pattern", "test_statistic": "test_statistic", "conceptual_distinction": "conceptual_distinction", "condition": "condition_recall", "model_definition": "model_definition"}
#: Damage that extraction does to formulas.
DAMAGE = r"\\[A-Z](_|[)\s]|$)|\bp\?(?!\w)|(?i:[∑Σ]\s*N\s+1\s+N|\bN\s+i\s*=\s*1\b)|\\\(\s*$|^\s*\\\)|(\(\s*){2,}X_i|(X_i\)){2,}"


def _any_of(low: Column, terms: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(low, F.lit(t)) for t in terms]) if terms else F.lit(False)


def bibliography(text: Column) -> Column:
    """True where the points of the signs reach three."""
    return sum((F.when(text.rlike(p), n).otherwise(0) for p, n in BIBLIOGRAPHY), F.lit(0)) >= 3


def parse_noise(text: Column, most: float = 0.35) -> Column:
    """True for texts of fewer than 20 characters that aren't white space, or with more than a share of odd symbols."""
    return (F.length(F.regexp_replace(text, r"\s+", "")) < 20) | (X.count_of(text, ODD) / F.greatest(F.length(text), F.lit(1)) > most)


def generic_name(name: Column) -> Column:
    t = F.trim(name)
    return F.coalesce((F.length(t) > 80) | t.rlike(",$") | t.rlike(GENERIC), F.lit(False)) & (F.coalesce(name, F.lit("")) != "")


def numbered(title: Column) -> Column:
    """The first number with a point in a title, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), r"([A-Za-z]?\d+(\.\d+)+)", 1), F.lit(""))


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))


def _first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 100_000_000))


def with_guidance(items: DataFrame, guidance: DataFrame, topic_terms: list[str] = TOPIC_TERMS) -> DataFrame:
    """items(course, type, title, concept, number, statement, ...) with what the guidance of their course says of them.

    guidance(course, guidance) has a text for each course that has any. Added: support (0 to 5), proof_asked, not_asked,
    mentioned (number or concept stands in it).
    """
    both = items.join(guidance.select("course", F.lower("guidance").alias("_g")), "course", "left").withColumns({"_g": F.coalesce("_g", F.lit("")), "_n": F.lower(F.coalesce("number", numbered(F.col("title")))), "_c": X.key_text(F.coalesce("concept", "title", F.lit("")))})
    g, spoken = F.col("_g"), F.trim("_g") != ""
    by_number, by_concept = F.coalesce(F.contains(g, F.col("_n")), F.lit(False)), (F.col("_c") != "") & F.contains(g, F.col("_c"))
    low = F.lower(F.coalesce("statement", F.lit("")))
    by_topic = reduce(Column.__or__, [F.contains(low, F.lit(t)) & F.contains(g, F.lit(t)) for t in topic_terms]) if topic_terms else F.lit(False)
    support = F.when(~spoken, 0).when(by_number, 5).when(by_concept | by_topic, F.when(g.rlike(STRONG), 4).otherwise(3)).otherwise(0)
    by_word = F.exists(F.split("_c", " "), lambda w: (F.length(w) > 4) & F.contains(g, w))
    about = F.when(F.col("_n").isNotNull(), by_number).otherwise(by_word)
    asked = spoken & g.rlike(PROOF_ASKED) & (by_number | by_word)
    name = F.lower(F.coalesce("concept", F.lit("")))
    mentioned = F.coalesce(F.contains(g, F.lower("number")), F.lit(False)) | ((name != "") & F.contains(g, name))
    return both.withColumns({"support": support, "proof_asked": asked, "not_asked": spoken & about & g.rlike(NOT_ASKED), "mentioned": mentioned}).drop("_g", "_n", "_c")


def items_of(candidates: DataFrame) -> DataFrame:
    """candidates(course, candidate_id, type, kind, number, title, concept, statement, raw, proof, page) as items waiting for a decision.

    A short first sentence that states nothing is the title; concept, purpose, prompt and tags follow from type, kind and text.
    """
    s = X.collapse(F.coalesce("statement", F.regexp_replace(F.coalesce("raw", F.lit("")), r"(?i)^(definition|theorem|lemma|proposition|corollary|remark|example|formula|proof|algorithm)\s*[0-9.]*\s*[.:]?\s*", "")))
    split = candidates.withColumn("_s", s).withColumns({"_head": F.regexp_extract("_s", r"^([^.!?]{2,80})[.!?]\s+", 1), "_rest": F.regexp_replace("_s", r"^[^.!?]{2,80}[.!?]\s+", "")})
    head = F.col("_head")
    titled = (head != "") & (_words(head) <= 8) & ~head.rlike(r"(?i)\b(is|are|has|if|then|defined|called|given|equals|denotes|consists)\b") & ~head.rlike(r"[,()]|(^|\s)[A-Z][a-z]?\d\b|(^|\s)X_?\d\b") & ~head.rlike(r"(?i)^(A|An|The|Let|Suppose|Assume)\b")
    told = split.withColumns({"statement": F.when(titled, F.trim("_rest")).otherwise(F.col("_s")), "_t": F.when(titled, F.trim("_head")), "number": F.coalesce("number", numbered(F.col("title")))})
    told = told.withColumn("concept", F.coalesce("concept", "_t", F.when(F.col("number").isNotNull(), F.concat_ws(" ", _first(F.col("type")), "number"))))
    label, shown, words = _first(F.col("type")), F.coalesce("_t", "concept"), F.split("statement", " ")
    begin = F.concat(label, F.lit(": "), F.array_join(F.slice(words, 1, 6), " "), F.when(F.size(words) > 6, "...").otherwise(""))
    title = F.when(F.col("number").isNotNull() & shown.isNotNull(), F.concat(label, F.lit(" "), F.col("number"), F.lit(". "), _first(shown))).when(F.col("number").isNotNull(), F.concat(label, F.lit(" "), "number")).otherwise(begin)
    made = told.withColumn("title", title)
    low = F.lower(F.concat_ws(" ", "title", "statement"))
    contrast = low.rlike(r"\b(vs|versus|difference|distinction|strict|weak)\b")
    purpose = reduce(lambda c, k: c.when(F.col("kind") == k[0], k[1]), KIND_PURPOSES.items(), F.when(F.lit(False), ""))
    purpose = purpose.when(F.col("type") == "proof", "proof_recall").when(F.col("type") == "definition", F.when(contrast & low.rlike(r"\bstationarity|stationary\b"), "conceptual_distinction").otherwise("definition_recall")).when(F.col("type").isin(*THEOREM_LIKE), "theorem_statement")
    purpose = purpose.when(F.col("type") == "formula", F.when(low.rlike(r"\bkriging system|ordinary kriging|set up|calculate|solve\b"), "calculation_template").otherwise("formula_recall")).when(F.col("type") == "algorithm", "method_steps")
    purpose = purpose.when(low.rlike(r"\bcondition|applies|valid|when can|if and only if\b"), "condition_recall").when(contrast | low.rlike(r"\bcompare\b"), "conceptual_distinction").when(low.rlike(METHOD), "calculation_template").otherwise("definition_recall")
    made = made.withColumn("purpose", purpose)
    prompt = reduce(lambda c, k: c.when(F.col("purpose") == k[0], k[1]), PROMPTS.items(), F.when((F.col("purpose") == "proof_recall") & (F.col("type") == "proof"), "Reproduce the proof."))
    prompt = reduce(lambda c, k: c.when(F.col("type") == k[0], k[1]), TYPE_PROMPTS.items(), prompt).when(F.col("type").isin(*THEOREM_LIKE), "State the theorem and its conditions.").otherwise("Recall the key statement.")
    answer = F.when(F.col("type") == "formula", F.concat("statement", F.lit("\n\nExplain the notation and conditions under which the formula applies."))).otherwise(F.col("statement"))
    tags = F.array_distinct(F.concat(F.array("type"), F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in TAGS]))))
    return made.select("course", "candidate_id", "type", "kind", "number", "title", "concept", F.coalesce("concept", "title").alias("front"), "statement", "raw", F.nullif(X.collapse(F.coalesce("proof", F.lit(""))), F.lit("")).alias("proof"), "page", "purpose", prompt.alias("prompt"), answer.alias("answer"), tags.alias("tags"), F.lit("unknown").alias("importance"), F.when((F.col("type") == "formula") | (F.col("kind") == "formula"), "low").otherwise("medium").alias("standalone_value"))


def relevance_scores(items: DataFrame, topic_terms: list[str] = TOPIC_TERMS, formula_terms: list[str] = FORMULA_TERMS) -> DataFrame:
    """items after with_guidance, with centrality, standalone and exam (0 to 5 each), decision and reason.

    Decisions are keep, needs_review, embed_in_parent and reject, by the first rule that holds.
    """
    kind, s = F.col("type"), F.coalesce("statement", F.lit(""))
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), s, F.coalesce("raw", F.lit("")))
    seen = items.withColumns({"_text": text, "_low": F.lower(text)})
    low, theorem = F.col("_low"), kind.isin(*THEOREM_LIKE)
    central = F.greatest(
        F.when(_any_of(low, topic_terms) | _any_of(low, formula_terms) | ((kind == "definition") & low.rlike(DEFINES)) | low.rlike(METHOD), 4).otherwise(0),
        F.when(theorem & F.col("number").isNotNull(), 3).otherwise(0),
    )
    seen = seen.withColumns({"centrality": central, "_formula": _any_of(low, formula_terms) | low.rlike(r"\bformula for\b") | (low.rlike(NAMED_BY[0]) & low.rlike(NAMED_BY[1])), "_trap": low.rlike(TRAP) & low.rlike(TRAP_OF), "_method": low.rlike(METHOD)})
    support, c, many = F.col("support"), F.col("centrality"), _words(s)
    alone = F.when(F.length(s) < 20, 1).when((F.length(s) > 1800) | (many > 220), 1).when(kind == "formula", F.when(F.col("_formula") | (support >= 4), 4).otherwise(2)).when(kind.isin("remark", "example"), F.when(F.col("_trap") | F.col("_method"), 3).otherwise(1)).when(kind == "other", F.when(c >= 4, 3).otherwise(1)).when(kind == "proof", F.when(support >= 4, 4).otherwise(1)).otherwise(F.when((c >= 4) | (support >= 4), 4).otherwise(3))
    exam = F.greatest(support, F.when(c >= 4, 4).otherwise(c), F.when(F.col("importance") == "must_know", 5).otherwise(0))
    seen = seen.withColumns({"standalone": alone, "exam": exam})
    weak_formula = (support < 4) & (low.rlike(r"\bnormal density|normal pdf|density of (a )?normal|gaussian density\b") | (low.rlike(r"\bjoint cdf|cdf|distribution function\b") & ~low.rlike(r"\b(named|theorem|central)\b")) | (low.rlike(r"\bproof\b") & low.rlike("[=<>]")) | (~F.col("_formula") & (X.count_of(low, r"[=+\-*/<>]") >= 2) & (_words(low) < 60)))
    formula, proof, strong = kind == "formula", kind == "proof", support >= 4
    recalled = kind.isin("definition", "algorithm", "property", "assumption") & (strong | (c >= 4) | low.rlike(DEFINES))
    rules = [
        (bibliography(F.col("_text")), "reject", "bibliography"),
        (parse_noise(F.col("_text")), "reject", "parse noise"),
        (generic_name(F.coalesce("concept", "title")) & ~strong, "needs_review", "generic name"),
        (F.col("not_asked") & (support <= 2), "reject", "not required"),
        (proof & F.col("proof_asked"), "keep", "proof asked for"),
        (proof, "reject", "proof not asked for"),
        (formula & weak_formula, "reject", "background formula"),
        (formula & (F.col("_formula") | strong), "keep", "central formula"),
        (formula, "embed_in_parent", "formula of its parent"),
        (theorem & (strong | (c >= 4) | F.col("number").isNotNull()), "keep", "theorem"),
        (theorem, "needs_review", "theorem of uncertain support"),
        (recalled, "keep", "definition or method"),
        ((kind == "remark") & strong, "keep", "remark in guidance"),
        ((kind == "remark") & F.col("_trap"), "needs_review", "remark on a trap"),
        (kind == "remark", "reject", "ordinary remark"),
        ((kind == "example") & (strong | F.col("_method")), "needs_review", "pattern of calculation"),
        (kind == "example", "reject", "background example"),
        ((F.col("purpose") == "conceptual_distinction") & (c >= 3), "keep", "distinction"),
        ((c >= 4) & (F.col("standalone") >= 3), "needs_review", "central but not asked for"),
        ((F.col("standalone") <= 2) & (support <= 2), "reject", "low value"),
    ]
    return gates.gate(seen, rules, "needs_review", "borderline").drop("_text", "_low", "_formula", "_trap", "_method", "reasons")


def importance_of(scored: DataFrame) -> DataFrame:
    """scored items with importance and standalone_value after their relevance."""
    kind = F.when(F.col("not_asked"), "not_required").when((F.col("support") >= 4) | (F.col("exam") >= 5), "must_know").when((F.col("decision") == "needs_review") | (F.col("exam") >= 3), "partial").otherwise("unknown")
    return scored.withColumns({"importance": kind, "standalone_value": F.when(F.col("standalone") >= 4, "high").when(F.col("standalone") >= 3, "medium").otherwise("low")})


def quality_gate(items: DataFrame, math: Column | None = None) -> DataFrame:
    """items(type, title, statement, answer, concept, importance, standalone_value, mentioned) with decision and reason of six ordered tests.

    math is a column high, medium or low, the quality of the item's formulas.
    """
    text = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "statement", "answer")]))
    bad = (F.lit("high") if math is None else math) == "low"
    answer, s, said = F.coalesce("answer", F.lit("")), F.coalesce("statement", F.lit("")), F.coalesce("mentioned", F.lit(False))
    poor = bad | (F.length(answer) > 1800) | (_words(s) > 1200) | (_words(answer) > 1200) | (F.length(s) > 2500) | text.rlike(r"\boffsets?\s+\d+|startoffset|endoffset|label regex|candidate length|raw candidate|segmentation diagnostics")
    value, unknown = F.coalesce("standalone_value", F.lit("medium")), F.col("importance") == "unknown"
    rules = [
        (bibliography(text) | parse_noise(text) | (text.rlike("intermediate|hence|therefore") & (F.col("type") == "formula")), "reject", "low value or noise"),
        (generic_name(F.coalesce("concept", "title")) & ~said, "needs_review", "generic name"),
        (poor, "needs_review", "low quality"),
        (unknown & (value == "high"), "keep", "high value of its own"),
        (unknown & (value == "medium"), "needs_review", "medium value of its own"),
        (unknown, "reject", "low value of its own"),
        ((F.col("type") == "formula") & (value != "high") & ~said, "needs_review", "formula of unclear value"),
        (F.col("type").isin(*THEOREM_LIKE) & (F.col("importance") != "must_know") & ~said, "needs_review", "theorem not clearly central"),
    ]
    return gates.gate(items, rules).drop("reasons")


def review_gate(items: DataFrame, math: Column | None = None, most: int = 1800) -> DataFrame:
    """items with review_reasons (array) and decision: what is kept but can't be reviewed yet needs review."""
    d, tags = F.coalesce("decision", F.lit("keep")), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    blob = F.concat_ws("\n", "statement", "title")
    rules = {
        "long answer": F.length("answer") > most,
        "generic front": generic_name(F.coalesce("concept", "title")),
        "low math quality": (F.lit("high") if math is None else math) == "low",
        "debug": F.exists(tags, lambda t: t.isin("verification-missing", "debug")),
        "offsets": blob.rlike(r"(?i)\boffsets?\s+\d+\s*[-–]\s*\d+"),
        "placeholder": F.concat_ws("\n", "statement", "answer").rlike(r"(?i)placeholder\]"),
        "long background": (F.col("purpose") == "background_context") & (F.length("statement") > 900),
        "debug tag": F.exists(tags, lambda t: F.contains(t, F.lit("extraction-debug"))),
    }
    why = F.when(d == "keep", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).otherwise(F.array().cast("array<string>"))
    return items.withColumn("review_reasons", why).withColumn("decision", F.when((d == "keep") & (F.size("review_reasons") > 0), "needs_review").otherwise(d))


def relevance_filter(items: DataFrame) -> DataFrame:
    """items after with_guidance, with decision keep or reject and reason, the category of the rejection: the plain rules, without scores."""
    s = F.coalesce("statement", F.lit(""))
    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "statement", "answer", "raw")])
    low = F.lower(text)
    asked = F.col("support") >= 4
    #: Names of central objects, and words that define.
    named = low.rlike(r"\b(semivariogram|variogram|covariance function|likelihood|blup|kriging predictor|kriging|poisson intensity|conditional distribution|local characteristic|random field|stationary|isotropic|gaussian)\b")
    central = named | ((F.col("type") == "definition") & s.rlike(r"(?i)\b(is|are|called|defined|denotes)\b"))
    trap = low.rlike(TRAP) & low.rlike(TRAP_OF)
    rules = [
        (bibliography(text), "reject", "bibliography_or_reference"),
        (parse_noise(text, 0.3), "reject", "parse_noise"),
        ((F.length(s) > 1800) | (_words(s) > 220), "reject", "too_broad"),
        ((F.col("type") == "formula") & ~(asked | central), "reject", "formula_not_standalone"),
        ((F.col("type") == "remark") & ~(asked | trap), "reject", "low_value"),
        (F.col("type").isin("example", "other") & ~asked & ~central, "reject", "ordinary_explanatory_text"),
        ((F.col("importance") == "unknown") & (F.col("standalone_value") == "low"), "reject", "not_examinable"),
    ]
    return gates.gate(items, rules, "keep", "kept").drop("reasons")


def grounding_audit(items: DataFrame, grounded: DataFrame, absent: DataFrame, labels: tuple[str, ...] = (), stale: int = 8) -> DataFrame:
    """items(item_id, kind, excerpt, text) with decision and reason: what has no excerpt, isn't in the source, is damaged or stale goes.

    grounded(item_id) are the items whose excerpt stands in a document, absent(item_id, term) the long words that no
    document has; words of labels don't count as technical. warned marks items whose absent words are such labels.
    """
    technical = ~F.col("term").isin(*labels) if labels else F.lit(True)
    terms = absent.groupBy("item_id").agg(F.count("*").alias("_a"), F.count_if(technical).alias("_t"))
    known = items.join(grounded.select("item_id").distinct().withColumn("_g", F.lit(True)), "item_id", "left").join(terms, "item_id", "left")
    a, t = F.coalesce("_a", F.lit(0)), F.coalesce("_t", F.lit(0))
    rules = [
        (F.length(F.trim(F.coalesce("excerpt", F.lit("")))) < 8, "reject", "missing_source_excerpt"),
        (F.col("_g").isNull(), "reject", "weak_grounding"),
        ((F.col("kind") == "formula") & F.col("text").rlike(DAMAGE), "reject", "broken_math_extraction"),
        (t >= stale, "reject", "stale_template_technical_term"),
    ]
    return gates.gate(known.withColumn("warned", (a >= 6) & (t <= 2)), rules).drop("_g", "_a", "_t", "reasons")


def excerpt_confidence(excerpt: Column) -> Column:
    """How far an excerpt grounds an item, by its length."""
    n = F.length(F.trim(F.coalesce(excerpt, F.lit(""))))
    return F.when(n >= 48, 0.88).when(n >= 20, 0.72).otherwise(0.45)


def flashcards(definitions: DataFrame, formulas: DataFrame, proofs: DataFrame, methods: DataFrame, placeholder: str = r"(?i)^core idea\s+\d+$") -> DataFrame:
    """pack_id, type, front, question, answer, category: a card for each item of the pack's lists; terms that are placeholders have none."""
    term = F.col("term")
    card = lambda df, kind, front, question, answer, category: df.select("pack_id", kind.alias("type"), front.alias("front"), question.alias("question"), answer.alias("answer"), F.lit(category).alias("category"))
    kind = F.when(F.col("item_kind").isin(*THEOREM_LIKE), F.col("item_kind")).otherwise("definition")
    steps = F.array_join("steps", "\n\n")
    parts = [
        card(definitions.where(~term.rlike(placeholder)), kind, term, F.concat(F.lit("What is "), term, F.lit("?")), F.col("definition"), "mustKnowDefinitions"),
        card(formulas, F.lit("formula"), F.col("name"), F.concat(F.lit("State or derive: "), "name"), F.col("latex"), "formulasToKnow"),
        card(proofs, F.lit("proof"), F.col("name"), F.concat(F.lit("Prove or explain: "), "name"), F.concat("skeleton", F.lit("\n\nCommon mistake: "), F.coalesce("mistake", F.lit(""))), "proofsToKnow"),
        card(methods, F.lit("algorithm"), F.col("problem"), F.concat(F.lit("Outline the procedure: "), "problem"), steps, "methodsAndTemplates"),
    ]
    return reduce(DataFrame.unionByName, parts)


def cram_sheet(rows: DataFrame, order: str = "position") -> DataFrame:
    """pack_id, definitions, formulas, proofs (arrays of lines) of rows(pack_id, kind, position, name, body): the first 12, 12 and 10, cut."""
    most = F.when(F.col("kind") == "proof", 10).otherwise(12)
    cut = F.when(F.col("kind") == "definition", F.concat(F.substring("body", 1, 100), F.when(F.length("body") > 100, "…").otherwise(""))).when(F.col("kind") == "proof", F.substring(F.substring_index("body", "\n", 1), 1, 200)).otherwise(F.col("body"))
    w = Window.partitionBy("pack_id", "kind").orderBy(order)
    fit = rows.where(F.col("kind").isin("definition", "formula", "proof") & ~((F.col("kind") == "formula") & F.col("name").rlike(r"(?i)^algorithm\s+\d|\bpseudocode\b")))
    # a constant limit first: Spark then cuts each partition before the shuffle
    first = fit.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 12).where(F.col("_k") <= most)
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("_k", F.concat("name", F.lit(": "), cut).alias("t"))))), lambda s: s["t"])
    return first.groupBy("pack_id").agg(listed("definition").alias("definitions"), listed("formula").alias("formulas"), listed("proof").alias("proofs"))


def quick_recall(rows: DataFrame, most: int = 18) -> DataFrame:
    """pack_id, n, question, answer: definitions, formulas, proofs and derivations of rows(pack_id, kind, position, name, body) in turn, no question twice, the first most."""
    #: Fixed values.
    asks = {"definition": "State the definition of “%s” in exam form (one short paragraph).", "formula": "Write %s and identify each symbol; when does it apply?", "proof": "Give the proof outline for %s — main identities only.", "derivation": "Walk through the worked derivation: %s — main steps only."}
    rank = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(asks), F.when(F.lit(False), 0))
    question = reduce(lambda c, k: c.when(F.col("kind") == k, F.format_string(asks[k], "name")), asks, F.when(F.lit(False), ""))
    each = rows.where(F.col("kind").isin(*asks)).withColumns({"rank": rank, "question": question})
    key = F.substring(F.trim(F.regexp_replace(X.collapse(F.lower("question")), "[^a-z0-9? ]", "")), 1, 120)
    one = each.groupBy("pack_id", key.alias("_key")).agg(F.min(F.struct("rank", "position", "question", F.substring("body", 1, 800).alias("answer"))).alias("q"))
    n = F.row_number().over(Window.partitionBy("pack_id").orderBy("q.rank", "q.position", "q.question"))
    return one.withColumn("n", n).where(F.col("n") <= most).select("pack_id", "n", "q.question", "q.answer")


def dashboard(items: DataFrame) -> DataFrame:
    """One row of counts of items(type, category, purpose, decision, deleted, next_due, reviewed): kept ones by kind, what is due, reviewed definitions. as_of is a column of items."""
    live = ~F.coalesce("deleted", F.lit(False)) & (F.coalesce("decision", F.lit("keep")) == "keep")
    of = lambda kind, category: live & ((F.col("type") == kind) | F.coalesce(F.col("category") == category, F.lit(False)))
    defs = of("definition", "mustKnowDefinitions")
    practice = live & (F.coalesce(F.col("purpose").isin("calculation_template", "worked_example_pattern"), F.lit(False)) | F.coalesce(F.col("category") == "workedExamplePatterns", F.lit(False)))
    due = live & (F.col("next_due").isNull() | (F.col("next_due") <= F.col("as_of")))
    counts = {"definitions": defs, "formulas": of("formula", "formulasToKnow"), "proofs": of("proof", "proofsToKnow"), "practice": practice, "due": due, "reviewed_definitions": defs & F.coalesce("reviewed", F.lit(False))}
    return items.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])


def weak_topics(topics: DataFrame, most: int = 5) -> DataFrame:
    """title, position of the first most topics that aren't of high importance."""
    return topics.where(F.coalesce(F.col("importance") != "high", F.lit(True))).orderBy("position").limit(most).select("title", "position")
