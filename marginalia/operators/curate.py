"""Curation: relevance and priority scores with their reasons, parents, splits and required sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X

THEOREM_LIKE = ("theorem", "lemma", "proposition", "corollary")


#: Points by the role of the evidence, by the topic's label, by the required label (the last one for other labels); floors and caps.
ROLE_POINTS = {"exam_guidance": 25, "past_paper": 30, "problem_sheet": 20, "solution_sheet": 15}
TOPIC_POINTS, OTHER_TOPIC = {"very_high": 30, "high": 25, "medium": 12}, 6
REQUIRED_POINTS, OTHER_REQUIRED = {"very_high": 25, "high": 20}, 10
CORE_POINTS, TEMPLATE_POINTS, FORMULA_TEMPLATE_POINTS = 20, 20, 35
DEFINITION_FLOOR, THEOREM_FLOOR, KEPT_FLOOR, ORDINARY_CAP = 70, 45, 40, 39


def exam_priority(items: DataFrame) -> DataFrame:
    """items with priority_score, priority_decision from columns type, number, generic, roles (array of evidence roles), topic_label, templates, required_label, centrality, kept, and purpose if there is one.

    The steps are in a fixed order, because caps and floors don't commute. Distinctions and calculation templates
    aren't capped as ordinary text.
    """
    has = lambda r: F.array_contains("roles", r)
    high, theorem = F.coalesce(F.col("topic_label").isin("very_high", "high"), F.lit(False)), F.col("type").isin(*THEOREM_LIKE)

    def ranked(column: str, points: dict[str, int], other: int) -> Column:
        out = F.when(F.col(column).isNull(), 0)
        for label, n in points.items():
            out = out.when(F.col(column) == label, n)
        return out.otherwise(other)

    purpose = F.coalesce("purpose", F.lit("")) if "purpose" in items.columns else F.lit("")
    s = sum((F.when(has(r), n).otherwise(0) for r, n in ROLE_POINTS.items()), F.lit(0)) + ranked("topic_label", TOPIC_POINTS, OTHER_TOPIC)
    s = F.when((F.col("type") == "definition") & high, F.greatest(s, F.lit(DEFINITION_FLOOR))).when((F.col("type").isin("definition", "algorithm") | theorem) & (F.col("centrality") >= 4), s + CORE_POINTS).otherwise(s)
    s = F.when(theorem & F.col("number").isNotNull(), F.greatest(s, F.lit(THEOREM_FLOOR))).otherwise(s)
    s = s + F.when(F.col("templates") > 0, F.when(F.col("type") == "formula", FORMULA_TEMPLATE_POINTS).otherwise(TEMPLATE_POINTS)).otherwise(0) + ranked("required_label", REQUIRED_POINTS, OTHER_REQUIRED)
    s = F.when((F.col("type") == "formula") & (F.col("templates") == 0) & ~high, F.least(s, F.lit(ORDINARY_CAP))).otherwise(s)
    s = F.when(F.col("type").isin("remark", "example", "other") & ~purpose.isin("conceptual_distinction", "calculation_template"), F.least(s, F.lit(ORDINARY_CAP))).otherwise(s)
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.greatest(s, F.when(F.col("kept"), KEPT_FLOOR).otherwise(0))))
    scored = items.withColumn("priority_score", s)
    p = F.col("priority_score")
    decision = X.first_match([("needs_review", F.col("generic")), ("needs_review", (F.col("type") == "formula") & p.between(45, 64)), ("reject", (F.col("type") == "formula") & (p < 45)), ("keep", (p >= 70) | ((F.col("type") == "definition") & (F.col("centrality") >= 4))), ("needs_review", p >= 45)], "reject")
    return scored.withColumn("priority_decision", decision)


def topic_of(items: DataFrame, topics: list[tuple[str, str]]) -> DataFrame:
    """items with topic, topic_label of the first of topics (name, label; a bounded list) that their text holds, or all of whose longer words it has."""
    keyed = items.withColumn("_t", X.key_text(F.concat_ws(" ", "concept", "title", "statement")))
    out, label = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, kind in topics:
        key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split())
        words = [w for w in key.split() if len(w) > 3]
        if len(key) < 3:
            continue
        every = F.lit(bool(words))
        for w in words:
            every = every & F.contains("_t", F.lit(w))
        holds = F.contains("_t", F.lit(key)) | every
        out, label = out.when(holds, name), label.when(holds, kind)
    return keyed.withColumns({"topic": out, "topic_label": label}).drop("_t")


def proof_cards(items: DataFrame) -> DataFrame:
    """item_id, type, title, statement, answer of a card for each proof that is required of a theorem that doesn't wait for review: proof, proof_asked, decision are columns of items."""
    wanted = items.where(F.col("type").isin(*THEOREM_LIKE) & F.col("proof").isNotNull() & F.coalesce("proof_asked", F.lit(False)) & (F.coalesce("decision", F.lit("keep")) != "needs_review"))
    return wanted.select(F.concat("item_id", F.lit("-proof")).alias("item_id"), F.lit("proof").alias("type"), F.concat(F.lit("Proof of "), "title").alias("title"), "statement", F.col("proof").alias("answer"))


def parent_items(items: DataFrame) -> DataFrame:
    """items with parent_order: the last definition or theorem before on the same page of the same file."""
    w = Window.partitionBy("source_file", "page").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("parent_order", F.last(F.when(F.col("type").isin("definition", *THEOREM_LIKE), F.col("position")), True).over(w))


#: What parts of a long item are called, by the first rule that holds; each name is used once.
PARTS = [("statement", r"(?i)^(theorem|definition|lemma|proposition)\b"), ("proof", r"(?i)^proof\b"), ("formula", r"[=∑∫√]"), ("example", r"(?i)\bexample\b"), ("remark", r"(?i)\b(remark|note)\b")]


def split_long(items: DataFrame, least: int = 1200, most: int = 1100) -> DataFrame:
    """item_id, part, text: paragraphs of items longer than least, at most one of each part's name, cut at most characters; short items are one part, long ones without any part are for review."""
    paragraphs = items.where(F.length("statement") > least).select("item_id", F.posexplode_outer(F.split("statement", r"\n\s*\n")).alias("k", "p")).where("trim(p) <> ''")
    named = paragraphs.withColumn("part", X.first_match([(n, F.trim("p").rlike(r)) for n, r in PARTS], "")).where("part <> ''")
    first = named.withColumn("_k", F.row_number().over(Window.partitionBy("item_id", "part").orderBy("k"))).where("_k = 1").select("item_id", "part", F.substring(F.trim("p"), 1, most).alias("text"))
    long_ = items.where(F.length("statement") > least)
    rest = long_.join(first.select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.lit("review").alias("part"), F.col("statement").alias("text"))
    short = items.where(F.coalesce(F.length("statement"), F.lit(0)) <= least).select("item_id", F.lit("whole").alias("part"), F.col("statement").alias("text"))
    return first.unionByName(rest).unionByName(short)


#: What guidance asks of a section, the strongest last.
REQUIREMENTS = ["background", "awareness", "understand", "use", "state", "derive", "prove"]


def required_sections(sentences: DataFrame) -> DataFrame:
    """number, requirement: the strongest thing that any sentence of guidance asks of a section number."""
    rank = F.lit(0)
    for k, r in enumerate(REQUIREMENTS):
        rank = F.when(F.lower("sentence").rlike(rf"\b{r[:-1] if r.endswith('e') else r}\w*\b"), k + 1).otherwise(rank)
    each = sentences.withColumn("_r", rank).select("_r", F.explode_outer(F.regexp_extract_all("sentence", F.lit(r"\b([0-9]{1,2}(?:\.[0-9]{1,2})+)\b"))).alias("number")).where("number is not null and _r > 0")
    return each.groupBy("number").agg(F.max("_r").alias("_r")).select("number", F.element_at(F.array(*[F.lit(r) for r in REQUIREMENTS]), F.col("_r")).alias("requirement"))


#: Labels inside texts, headings that follow an item, and beginnings that miss something.
LABELLED = r"\b(Definition|Theorem|Lemma|Proposition|Corollary|Proof|Remark|Example|Question)\s+[A-Za-z]?\d+(\.\d+)*\b"
TYPED = r"\b(Definition|Theorem|Lemma|Proposition|Corollary|Proof|Remark|Example|Question|Assumption|Property|Algorithm|Formula)\b"
SECTION_AFTER = r"(?i:(^|\s)(chapter|section)\s+\d+(\.\d+)*\b)|(^|\s)\d+(\.\d+)*\s+[A-Z][A-Za-z][A-Za-z\s,&-]{5,90}(\n|$)"
BROKEN_START = r"(?i)^([,.;:)]|\]|\.\.\.|…|X_?n\))"
SUSPICIOUS = r"multiple merged|Over-merged|unusually long|is missing\.|Type conflicts|Question prompt|missing its beginning|unrelated section|entire section"


def warnings(items: DataFrame) -> DataFrame:
    """items(type, title, prompt, statement, answer, importance, location, excerpt, extraction_warning) with warnings, hard_warnings (arrays), valid (no hard ones) and suspicious (those warnings that ask for a look)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    s, answer, prompt, title = text("statement"), text("answer"), text("prompt"), text("title")
    blank = lambda c: F.trim(c) == ""
    kind, many = F.col("type"), X.count_of(s, LABELLED) > 1
    own, n, definition = text("extraction_warning"), F.length(F.trim(s)), F.coalesce(F.col("type") == "definition", F.lit(False))
    told = F.lower(F.coalesce(F.nullif(F.regexp_extract(title, TYPED, 1), F.lit("")), F.nullif(F.regexp_extract(s, TYPED, 1), F.lit(""))))
    told = F.when(told == "question", "example").otherwise(told)
    shared = {"Source location is missing.": blank(text("location")), "Source excerpt is missing.": blank(text("excerpt")), "Question prompt is unusually long.": F.length(prompt) > 180, "Title is unusually long.": F.length(title) > 120, "Definition is unusually long and may include unrelated text.": definition & (F.length(s) > 800), "Definition statement starts suspiciously and may be missing its beginning.": definition & F.trim(s).rlike(BROKEN_START), "Statement appears to include unrelated section text.": s.rlike(SECTION_AFTER)}
    soft = {
        "Missing title.": blank(title), "Missing type.": kind.isNull() | (kind == ""), "Missing question prompt.": blank(prompt), "Missing answer.": blank(answer), "Importance is unknown.": F.coalesce(F.col("importance") == "unknown", F.lit(False)), "Statement is very short and may be incomplete.": n.between(1, 29), **shared,
        "This card may contain multiple merged items.": many, "Answer may repeat an entire section instead of the item.": (F.length(answer) > 2500) | (X.count_of(answer, LABELLED) > 1),
    }
    hard = {"Over-merged card: statement contains multiple major labels.": many, "Over-merged card: definition statement contains another major label.": definition & s.rlike(r"\b(Theorem|Proof|Remark|Definition|Lemma|Proposition|Corollary)\b"), "Over-merged card: theorem statement contains a preceding definition.": kind.isin(*THEOREM_LIKE) & s.rlike(r"(?s)\bDefinition\b.*\bTheorem\b"), **shared}
    made = lambda rules: [F.when(c, n) for n, c in rules.items()]
    conflict = F.when(told != kind, F.concat(F.lit("Type conflicts with labelled source text ("), told, F.lit(").")))
    noted = F.nullif(own, F.lit(""))
    both = items.withColumns({"warnings": F.array_compact(F.array(*made(soft), noted, conflict)), "hard_warnings": F.array_compact(F.array(*made(hard), F.when(own.rlike("Over-merged|multiple major label"), own)))})
    return both.withColumns({"valid": F.size("hard_warnings") == 0, "suspicious": F.filter("warnings", lambda w: w.rlike(SUSPICIOUS))})


#: Fields that an imported item must have.
REQUIRED_FIELDS = ["id", "type", "title", "statement", "sourceFile", "tags", "importance", "questionPrompt", "answer", "createdAt", "updatedAt"]


def import_errors(raw: DataFrame, json: str = "json") -> DataFrame:
    """position, error of rows(position, json) that aren't objects or lack required fields; good rows have none."""
    kind = ", ".join(f"{c} {'array<string>' if c == 'tags' else 'string'}" for c in REQUIRED_FIELDS)
    x = raw.select("position", json, F.from_json(json, kind).alias("x"), F.trim(json).startswith("{").alias("o"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"x.{c}").isNull() | (F.lit(c != "tags") & (F.col(f"x.{c}").cast("string") == "")), c) for c in REQUIRED_FIELDS]))
    no = F.concat(F.lit("Item "), F.col("position").cast("string"), F.lit(": "))
    why = F.when(~F.col("o") | F.col("x").isNull(), F.concat(no, F.lit("must be an object."))).when(F.size(missing) > 0, F.concat(no, F.lit("missing required field(s): "), F.array_join(missing, ", ")))
    return x.select("position", why.alias("error")).where("error is not null")


def pack_scores(items: DataFrame, topics: list[str], assessed: int, expected: int = 5) -> DataFrame:
    """One row: completeness (categories with items, of expected), coverage (topics with a kept item), math_quality and evidence (assessed topics), each 0 to 100.

    items(type, purpose, title, statement, front, math) are the kept ones; topics is a bounded list.
    """
    kinds = {"definition": F.col("type") == "definition", "model": F.col("purpose") == "model_definition", "condition": F.col("purpose").isin("condition_recall", "application_condition"), "formula": F.col("type") == "formula", "method": F.col("purpose").isin("method_steps", "calculation_template"), "test": F.col("purpose") == "test_statistic", "worked": F.col("purpose") == "worked_example_pattern"}
    low = F.lower(F.concat_ws(" ", "front", "title", "statement"))
    held = [F.max(F.contains(low, F.lit(t.lower())).cast("int")) for t in topics]
    share = lambda n, of: X.half_up(100 * n / of).cast("long") if of else F.lit(0).cast("long")
    got = items.agg(sum((F.coalesce(F.max(c.cast("int")), F.lit(0)) for c in kinds.values()), F.lit(0)).alias("kinds"), sum((F.coalesce(h, F.lit(0)) for h in held), F.lit(0)).alias("held"), F.avg(F.when(F.col("math") == "low", 25).when(F.col("math") == "medium", 70).otherwise(100)).alias("math"))
    return got.select(F.least(F.lit(100), share(F.col("kinds"), expected)).alias("completeness"), share(F.col("held"), len(topics)).alias("coverage"), F.coalesce(X.half_up(F.col("math")), F.lit(0)).cast("long").alias("math_quality"), share(F.lit(assessed), len(topics)).alias("evidence"))


def coerced(raw: DataFrame, json: str = "json") -> DataFrame:
    """Items from untrusted JSON: known types only, scores within 0 to 100, defaults for what is missing; _corrupt where it isn't JSON."""
    kind = "item_id string, type string, title string, statement string, score double, tags array<string>, decision string, _corrupt string"
    x = raw.select(F.from_json(json, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x")).select("x.*")
    types = ["definition", "theorem", "lemma", "proposition", "corollary", "formula", "proof", "algorithm", "example", "remark", "assumption", "property"]
    return x.select("item_id", F.when(F.col("type").isin(types), F.col("type")).otherwise("other").alias("type"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("statement", F.lit("")).alias("statement"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("score", F.lit(0.0)))).alias("score"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.when(F.col("decision").isin("keep", "review", "reject"), F.col("decision")).otherwise("keep").alias("decision"), F.col("_corrupt").isNotNull().alias("corrupt"))


def chapter_of(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """items(doc_id, page, section) with number of their chapter: the first whose pages hold them, else whose title stands in the section's, else the document's first."""
    i = items.withColumn("_i", F.monotonically_increasing_id()) if "item_id" not in items.columns else items.withColumn("_i", F.col("item_id"))
    c = chapters.select(F.col("doc_id").alias("_d"), F.col("number").alias("_n"), "start", "end", F.lower("title").alias("_t"))
    by_title = F.coalesce(F.contains(F.lower("section"), F.col("_t")) & (F.col("_t") != ""), F.lit(False))
    rank = F.when(F.coalesce(F.col("page").between(F.col("start"), F.col("end")), F.lit(False)), 0).when(by_title, 1).otherwise(2)
    best = i.join(c, F.col("doc_id") == F.col("_d"), "left").groupBy("_i").agg(F.min(F.struct(rank.alias("r"), F.col("_n").alias("n"))).alias("b"))
    return i.join(best, "_i").withColumn("number", F.col("b.n")).drop("b", "_i")


def chapter_counts(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc_id, number, title, items, risk of items(doc_id, page): by the chapter whose pages hold them."""
    hit = chapters.join(items.select("doc_id", F.col("page").alias("_p")), "doc_id", "left").groupBy("doc_id", "number", "title").agg(F.count_if(F.col("_p").between(F.col("start"), F.col("end"))).alias("items"))
    return hit.withColumn("risk", F.when(F.col("items") > 14, "high").when(F.col("items") > 6, "medium").otherwise("low"))


def completeness(items: DataFrame, categories: Column, wanted: int = 7) -> DataFrame:
    """level of what share of wanted categories has items: the least of all parts decides."""
    return items.agg(F.count_distinct(categories).alias("n")).select(F.when(F.col("n") >= wanted, "high").when(F.col("n") >= wanted - 2, "medium").otherwise("low").alias("level"))
