"""Registered queries of courses, cards and layout, each with DuckDB SQL. Imported by queries, which has the shared parts.

The given prose has none of the words that the rules look for, so words of the prose stand in for them here; the
rules themselves have tests on rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import cards, course, grounding, lines, priority
from marginalia.plans.queries import BIGRAMS, COLLAPSE, EVIDENCE, FOLD, KIND, NORMAL, PAGES, ROLE, SENTENCES, _docs, _evidence, _items, _pages, _roled, _t, bigram_topics, query

TOP = 20
TOPICS = f"{BIGRAMS}, topics AS (SELECT phrase, row_number() OVER (ORDER BY hits DESC, phrase) AS pos FROM (SELECT * FROM bigrams ORDER BY hits DESC, phrase LIMIT {TOP}))"
HELD = "list_transform(list_sort(list_filter((SELECT list({{'pos': pos, 'phrase': phrase}}) FROM topics), lambda x: contains(lower({0}), x.phrase))), lambda x: x.phrase)"
ASSESSING = ", ".join(f"'{r}'" for r in course.ASSESSING)
BOOST = "CASE role " + " ".join(f"WHEN '{r}' THEN {b}" for r, b in course.ROLE_BOOST.items()) + " ELSE 0 END"


def _names(spark, d) -> list[str]:
    return priority.bounded(bigram_topics(spark, d).orderBy(F.desc("hits"), "phrase").select("phrase").limit(TOP))


def _sentences(spark, d) -> DataFrame:
    return lines.sentences(_roled(spark, d), keep=("role",))


TERMS = {"first": ["the ", "zzzz"], "second": [" de ", " la ", "qqqq"], "third": [" und ", " die ", " der "], "fourth": ["wwww"]}
TERM_SCORES = ", ".join("{'score': " + " + ".join(f"max(contains(s, '{t}')::INT)" for t in ts) + f", 'order': {-k}, 'kind': '{name}'" + "}" for k, (name, ts) in enumerate(TERMS.items()))


@query(f"WITH s AS (SELECT lang, lower(concat_ws(chr(10), source, substring(text, 1, 20000))) AS s FROM documents), b AS (SELECT lang, list_sort([{TERM_SCORES}], 'DESC')[1] AS b FROM s GROUP BY lang) SELECT lang, CASE WHEN b.score >= 2 THEN b.kind ELSE 'unknown' END AS course_type, b.score::BIGINT AS score FROM b")
def course_types(spark, d):
    return course.course_type(_docs(spark, d), "lang", terms=TERMS)


@query(rf"""WITH h AS (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title FROM pages), n AS (SELECT page_id, trim(regexp_replace(title, '^(chapter|section)?\s*[0-9]+(\.[0-9]+)*\s*', '', 'i'), ' ') AS name FROM h),
 f AS (SELECT name, min(page_id) AS pos FROM n WHERE length(name) BETWEEN 4 AND 60 AND NOT regexp_matches(name, '(?i)definition|theorem|proof') GROUP BY name) SELECT name, row_number() OVER (ORDER BY pos, name) AS position FROM (SELECT * FROM f ORDER BY pos, name LIMIT 30)""")
def title_seeds(spark, d):
    titles = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"))
    return course.title_seeds(titles, ["page_id"]).select("name", F.col("position").cast("long").alias("position"))


@query(f"""WITH {PAGES}, {TOPICS}, hit AS (SELECT phrase AS name, doc_id, page, text, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, page) AS k FROM pages JOIN topics ON contains(lower(text), phrase))
 SELECT name, k, doc_id, page, md5({COLLAPSE("substring(text, greatest(1, instr(lower(text), name) - 160), 700)")}) AS excerpt_md5 FROM hit WHERE k <= 8""")
def topic_locations(spark, d):
    got = course.topic_locations(_pages(spark, d), _names(spark, d))
    return got.select("name", F.col("k").cast("long").alias("k"), "doc_id", F.col("page").cast("long").alias("page"), F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"))


@query(f"WITH {PAGES}, {TOPICS}, hit AS (SELECT doc_id, page, phrase AS name FROM pages JOIN topics ON contains(lower(text), phrase)), known AS (SELECT doc_id, page, phrase AS name FROM pages, topics WHERE page = 1 AND pos <= 10) SELECT * FROM hit WHERE (doc_id, page, name) NOT IN (SELECT (doc_id, page, name) FROM known)")
def topics_missing(spark, d):
    """Topics of pages for which no candidate exists; here the first pages have candidates of the first ten."""
    pages, names = _pages(spark, d), _names(spark, d)
    known = pages.where("page = 1").select("doc_id", "page", F.explode(F.array(*[F.lit(n) for n in names[:10]])).alias("concept"))
    return course.topics_missing(pages, names, known).select("doc_id", F.col("page").cast("long").alias("page"), "name")


EXPLAIN = "CASE role " + " ".join(f"WHEN '{r}' THEN replace('{t}', '%s', phrase)" for r, t in course.EXPLAINED.items()) + f" ELSE replace('{course.NOTES}', '%s', phrase) END"


@query(f"WITH {EVIDENCE}, {PAGES}, e AS (SELECT evidence.*, s.sentence FROM evidence JOIN sentences s USING (doc_id, sentence_index)) SELECT doc_id, role, phrase, sentence_index::BIGINT AS sentence_index, (SELECT min(page) FROM pages WHERE pages.doc_id = e.doc_id AND contains(pages.text, substring(e.sentence, 1, 80))) AS page, md5(substring(sentence, 1, 360)) AS excerpt_md5, {EXPLAIN} AS explanation FROM e")
def evidence_rows(spark, d):
    got = course.evidence_rows(_evidence(spark, d), _pages(spark, d))
    return got.select("doc_id", "role", "phrase", F.col("sentence_index").cast("long").alias("sentence_index"), F.col("page").cast("long").alias("page"), F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"), "explanation")


ASKS = {"proof": "er the ", "formula": " of ", "definition": " was "}


@query(f"""WITH {SENTENCES}, {TOPICS}, n AS (SELECT doc_id, sentence_index, coalesce(({HELD.format('sentence')})[1], (SELECT phrase FROM topics WHERE pos = 1)) AS name, unnest(list_filter([{', '.join(f"CASE WHEN contains(lower(sentence), '{v}') THEN '{k}' END" for k, v in ASKS.items())}], lambda x: x IS NOT NULL)) AS kind FROM sentences WHERE role <> 'lecture_notes'),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY doc_id, sentence_index) AS k FROM n) SELECT kind, name, CASE WHEN pos <= 5 THEN 'high' ELSE 'low' END AS label, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 5) AS first_docs FROM r JOIN topics ON phrase = name GROUP BY kind, name, pos""")
def required_signals(spark, d):
    topics = [(n, "high" if k < 5 else "low") for k, n in enumerate(_names(spark, d))]
    return course.required_signals(_sentences(spark, d), topics, ASKS).withColumn("first_docs", F.array_join(F.transform("first_docs", lambda i: i.cast("string")), ","))


@query(f"""WITH {SENTENCES}, {TOPICS}, hit AS (SELECT phrase AS name, sentence, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, sentence_index) AS k FROM sentences JOIN topics ON contains(lower(sentence), phrase) WHERE role IN ('past_paper', 'problem_sheet', 'solution_sheet') AND contains(lower(sentence), ' the '))
 SELECT name, 'Identify inputs' AS first_step, count(*) AS n FROM hit WHERE k <= 4 GROUP BY name""")
def calculation_templates(spark, d):
    return course.calculation_templates(_sentences(spark, d), _names(spark, d), " the ").select("name", F.get("steps", F.lit(0)).alias("first_step"), "n")


@query(f"""WITH {SENTENCES}, {TOPICS}, f AS (SELECT row_number() OVER (ORDER BY doc_id, sentence_index) AS k, sentence, {HELD.format('sentence')} AS h FROM (SELECT * FROM sentences WHERE role <> 'lecture_notes' AND contains(lower(sentence), ' with ') ORDER BY doc_id, sentence_index LIMIT 8))
 SELECT k, CASE WHEN len(h) >= 2 THEN h[1] || ' vs ' || h[2] ELSE substring(sentence, 1, 70) END AS name, array_to_string(CASE WHEN len(h) > 0 THEN h ELSE (SELECT list(phrase ORDER BY pos) FROM topics WHERE pos <= 2) END, ',') AS concepts FROM f""")
def distinctions(spark, d):
    return course.distinctions(_sentences(spark, d), _names(spark, d), " with ").select(F.col("k").cast("long").alias("k"), "name", F.array_join("concepts", ",").alias("concepts"))


SIGNALS = {"proof": (" was ", 10), "calculation": (" with ", 5), "conceptual": (" that ", 0)}


@query(f"""WITH {SENTENCES}, {TOPICS} SELECT s.signal, coalesce(({HELD.format('sentence')})[1], substring(sentence, 1, 80)) AS name, doc_id, sentence_index::BIGINT AS sentence_index, ({BOOST} + s.extra)::BIGINT AS boost FROM sentences JOIN (VALUES {', '.join(f"('{k}', '{p}', {b})" for k, (p, b) in SIGNALS.items())}) s(signal, pattern, extra) ON contains(lower(sentence), pattern) WHERE role IN ({ASSESSING})""")
def assessment_signals(spark, d):
    return course.assessment_signals(_sentences(spark, d), _names(spark, d), SIGNALS).withColumn("sentence_index", F.col("sentence_index").cast("long"))


@query(f"WITH {SENTENCES}, {TOPICS}, l AS (SELECT phrase AS name, role FROM sentences JOIN topics ON contains(lower(sentence), phrase)), b AS (SELECT name, least(45, sum({BOOST})) AS b FROM l GROUP BY name) SELECT name, greatest(0, least(100, 35 + b))::BIGINT AS score, CASE WHEN 35 + b >= 85 THEN 'very_high' WHEN 35 + b >= 65 THEN 'high' WHEN 35 + b >= 40 THEN 'medium' ELSE 'low' END AS label FROM b")
def entity_scores(spark, d):
    """Places of topics stand for those of a course's formulas."""
    hit = course.with_names(_sentences(spark, d), _names(spark, d), "sentence")
    return course.entity_scores(hit.select("role", F.explode("held").alias("name")), -10)


START = "^(The|And|Re|In) "
STYLES = [("first", " the "), ("second", " and ")]


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, i, {COLLAPSE("a[i]")} AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)), p AS (SELECT doc_id, t, row_number() OVER w AS position, {COLLAPSE("concat_ws(' ', t, lead(t, 1) OVER w, lead(t, 2) OVER w)")} AS body FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 s AS (SELECT * FROM p WHERE regexp_matches(t, '{START}') AND length(body) >= 24), walk AS (SELECT doc_id, min(position) AS position FROM s GROUP BY 1 UNION ALL SELECT w.doc_id, (SELECT min(position) FROM s WHERE s.doc_id = w.doc_id AND s.position >= w.position + 3) AS position FROM walk w WHERE w.position IS NOT NULL)
 SELECT doc_id, position, CASE WHEN contains(lower(body), ' the ') THEN 'first' WHEN contains(lower(body), ' and ') THEN 'second' ELSE 'Assessment question pattern' END AS style, md5(substring(body, 1, 360)) AS evidence_md5, md5(CASE WHEN length(body) > 220 THEN trim(substring(body, 1, 217), ' ') || '...' ELSE body END) AS practice_md5 FROM walk JOIN s USING (doc_id, position)""")
def question_patterns(spark, d):
    table = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    got = course.question_patterns(table, START, STYLES)
    return got.select("doc_id", "position", "style", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"), F.md5(F.col("practice").cast("binary")).alias("practice_md5"))


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, i, {COLLAPSE("a[i]")} AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)), p AS (SELECT doc_id, t, row_number() OVER w AS position, {COLLAPSE("concat_ws(' ', t, lead(t, 1) OVER w, lead(t, 2) OVER w)")} AS body FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 s AS (SELECT * FROM p WHERE regexp_matches(t, '{START}') AND length(body) >= 24), walk AS (SELECT doc_id, min(position) AS position FROM s GROUP BY 1 UNION ALL SELECT w.doc_id, (SELECT min(position) FROM s WHERE s.doc_id = w.doc_id AND s.position >= w.position + 3) AS position FROM walk w WHERE w.position IS NOT NULL),
 found AS (SELECT doc_id, position, list_distinct(list_filter(string_split({NORMAL("substring(body, 1, 360)")}, ' '), lambda w: length(w) > 2)) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS k FROM walk JOIN s USING (doc_id, position)),
 fold AS (SELECT doc_id, k, [w] AS kept, true AS stays, position FROM found WHERE k = 1 UNION ALL SELECT f.doc_id, f.k, CASE WHEN z.near THEN z.kept ELSE list_append(z.kept, f.w) END, NOT z.near, f.position FROM (SELECT o.*, n.w, coalesce(list_bool_or(list_transform(o.kept, lambda x: len(list_intersect(x, n.w))::DOUBLE / nullif(len(list_distinct(list_concat(x, n.w))), 0) > 0.82)), false) AS near FROM fold o JOIN found n ON n.doc_id = o.doc_id AND n.k = o.k + 1) z JOIN found f ON f.doc_id = z.doc_id AND f.k = z.k + 1 )
 SELECT doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM fold WHERE stays) WHERE n <= 8""")
def distinct_patterns(spark, d):
    """The first eight patterns of each document without near copies."""
    table = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    return course.distinct_patterns(course.question_patterns(table, START, STYLES)).select("doc_id", "position")


@query(f"WITH c AS (SELECT conv_id AS doc_id, turn, CASE WHEN role = 'user' THEN (turn // 4)::VARCHAR || '.' || turn END AS number, 'turn ' || turn % 3 AS title FROM conversations), k AS (SELECT *, CASE WHEN number IS NOT NULL THEN (turn // 4)::VARCHAR END AS c FROM c) SELECT doc_id, coalesce(c, title) AS chapter, coalesce('Chapter ' || c, title) AS title, min(turn) AS start, max(turn) AS \"end\", count(*) AS sections FROM k GROUP BY ALL")
def chapter_groups(spark, d):
    """Turns of conversations stand for sections: those of the user are numbered, the others have a title only."""
    c = _t(spark, d, "conversations")
    number = F.when(F.col("role") == "user", F.concat_ws(".", F.floor(F.col("turn") / 4).cast("string"), F.col("turn").cast("string")))
    return course.chapters_of(c.select(F.col("conv_id").alias("doc_id"), number.alias("number"), F.concat(F.lit("turn "), (F.col("turn") % 3).cast("string")).alias("title"), F.col("turn").alias("start"), F.col("turn").alias("end")))


@query(f"SELECT item_id FROM (SELECT item_id, {NORMAL('substring(text, 1, 40)')} AS f FROM benchmark) WHERE f NOT IN (SELECT {NORMAL('substring(text, 1, 40)')} FROM documents WHERE text IS NOT NULL)")
def missing_seeds(spark, d):
    front = F.substring("text", 1, 40).alias("front")
    return course.missing_seeds(_t(spark, d, "benchmark").select("item_id", front), _docs(spark, d).where("text is not null").select(front)).select("item_id")


@query(f"WITH f AS (SELECT DISTINCT source || '_' || lang || '.txt' AS name, {ROLE} AS role FROM documents), s AS (SELECT name, role, substring(trim(regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '[_-]+', ' ', 'g'), ' '), 1, 60) AS s FROM f) SELECT s AS title, string_agg(DISTINCT name, ',' ORDER BY name) AS files, CASE WHEN bool_or(role = 'lecture_notes') THEN 'high' ELSE 'medium' END AS importance FROM s GROUP BY s")
def file_topics(spark, d):
    files = _roled(spark, d).select(F.concat(F.concat_ws("_", "source", "lang"), F.lit(".txt")).alias("name"), "role").distinct()
    return course.topics_of_files(files).withColumn("files", F.array_join("files", ","))


@query(rf"""WITH {PAGES}, l AS (SELECT doc_id, page, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 120 AND regexp_matches({FOLD('x')}, '(?i)^(chapter|section|lecture|topic|\d+(\.\d+)*|[A-Z][A-Z\s]{{5,}})\b[:.)\-\s]*(.+)?$|^#+\s+')) AS h FROM pages) SELECT doc_id, page, len(h[1:8])::BIGINT AS n, md5(array_to_string(h[1:8], chr(10))) AS headings_md5 FROM l""")
def page_headings(spark, d):
    got = lines.light_headings(_pages(spark, d), "doc_id", "page")
    return got.select("doc_id", F.col("page").cast("long").alias("page"), F.size("headings").cast("long").alias("n"), F.md5(F.array_join("headings", "\n").cast("binary")).alias("headings_md5"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '([a-z0-9)\]}}])\s+(The\b)', '\1' || chr(10) || '\2', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5 FROM documents")
def layout_breaks(spark, d):
    """The layout rules with a word of the prose as the label."""
    rules = [(r"([a-z0-9)\]}])\s+(The\b)", "$1\n$2"), lines.BREAKS[-1]]
    return _docs(spark, d).select("doc_id", F.md5(lines.broken_lines(F.col("text"), rules).cast("binary")).alias("text_md5"))


@query(f"WITH {EVIDENCE} SELECT phrase, " + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}" for r, _ in X.ROLES) + " FROM evidence GROUP BY 1")
def topic_role_map(spark, d):
    """The roles of each topic's evidence as a map, read back by key."""
    by = _evidence(spark, d).groupBy("phrase").agg(X.role_counts(F.col("role")).alias("m"))
    return by.select("phrase", *[F.col("m")[r].alias(r) for r, _ in X.ROLES])


# Items: every document is one, of a kind by its id; guidance of a language is the text of its first guidance document.
WORDS = ["thatin", "inoran", "ononst"]
GUIDED = f"""g AS (SELECT lang AS course, lower(arg_min(text, doc_id)) AS g FROM documents WHERE text IS NOT NULL AND {ROLE} = 'exam_guidance' GROUP BY lang),
 i AS (SELECT d.doc_id AS item_id, d.lang AS course, {KIND.replace('doc_id', 'd.doc_id')} AS type, regexp_extract({FOLD('lower(d.text)')}, '\\b([a-z]{{4,}})\\b', 1) AS concept, d.source AS title, coalesce(d.text, '') AS statement, coalesce(g, '') AS g FROM documents d LEFT JOIN g ON g.course = d.lang),
 w AS (SELECT *, CASE WHEN trim(g, ' ') = '' THEN 0 WHEN (concept <> '' AND contains(g, concept)) OR {' OR '.join(f"(contains(lower(statement), '{t}') AND contains(g, '{t}'))" for t in WORDS)} THEN 3 ELSE 0 END AS support FROM i)"""


def _guided(spark, d) -> DataFrame:
    docs = _roled(spark, d)
    guidance = docs.where("text is not null and role = 'exam_guidance'").groupBy(F.col("lang").alias("course")).agg(F.min_by("text", "doc_id").alias("guidance"))
    rows = _items(spark, d).select("item_id", F.col("lang").alias("course"), F.col("kind").alias("type"), F.regexp_extract(X.ascii_fold(F.lower(F.coalesce("text", F.lit("")))), r"\b([a-z]{4,})\b", 1).alias("concept"), F.col("source").alias("title"), F.lit(None).cast("string").alias("number"), F.coalesce("text", F.lit("")).alias("statement"))
    return cards.with_guidance(rows, guidance, WORDS)


@query(f"WITH {GUIDED} SELECT item_id, support::BIGINT AS support, concept <> '' AND contains(g, concept) AS mentioned FROM w")
def guidance_support(spark, d):
    return _guided(spark, d).select("item_id", F.col("support").cast("long").alias("support"), "mentioned")


@query(rf"""WITH {GUIDED}, s AS (SELECT *, statement AS text, length(statement) AS n, len(list_filter(string_split_regex(trim(statement, ' '), '\s+'), lambda x: x <> '')) AS words, title || chr(10) || statement || chr(10) || chr(10) AS t FROM w),
 f AS (SELECT *, (CASE WHEN regexp_matches(t, '\b(19|20)\d{{2}}\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)\b(bibliography|references|reading list|textbook|publisher|press|edition|isbn|pages?\s+\d+)') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '([A-Z][A-Za-z-]+,\s+[A-Z][A-Za-z-]+(,| and)\s*)+') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '\[[A-Z]{{1,4}}\]\s+[A-Z][A-Za-z-]+,') THEN 3 ELSE 0 END) >= 3 AS bib,
  length(regexp_replace(t, '\s+', '', 'g')) < 20 OR len(regexp_extract_all(t, '[^A-Za-z0-9\s.,;:()\[\]{{}}_^=+\-*/\\]'))::DOUBLE / greatest(length(t), 1) > 0.3 AS noise FROM s)
 SELECT item_id, CASE WHEN bib THEN 'bibliography_or_reference' WHEN noise THEN 'parse_noise' WHEN n > 1800 OR words > 220 THEN 'too_broad' WHEN type = 'formula' THEN 'formula_not_standalone' WHEN type = 'example' THEN 'ordinary_explanatory_text' ELSE 'kept' END AS reason FROM f""")
def relevance_filter(spark, d):
    """No item has the support that guidance with strong words gives: such words aren't in the prose."""
    plain = _guided(spark, d).withColumns({"answer": F.lit(None).cast("string"), "raw": F.lit(None).cast("string"), "importance": F.lit("unknown"), "standalone_value": F.lit("medium")})
    return cards.relevance_filter(plain).select("item_id", "reason")


AUDIT = rf"""e AS (SELECT item_id, substring({COLLAPSE('lower(text)')}, 1, 120) AS p, text, CASE WHEN item_id % 10 = 3 THEN NULL ELSE text END AS excerpt FROM benchmark), grounded AS (SELECT DISTINCT item_id FROM e JOIN (SELECT {COLLAPSE('lower(text)')} AS s FROM documents) ON contains(s, p) WHERE length(p) >= 10),
 t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({FOLD('lower(text)')}, '\b[a-z]{{10,}}\b')) AS term FROM benchmark), absent AS (SELECT item_id, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), term)) GROUP BY 1)"""


@query(f"WITH {AUDIT} SELECT item_id, CASE WHEN length(trim(coalesce(excerpt, ''), ' ')) < 8 THEN 'missing_source_excerpt' WHEN item_id NOT IN (SELECT item_id FROM grounded) THEN 'weak_grounding' WHEN coalesce((SELECT n FROM absent a WHERE a.item_id = e.item_id), 0) >= 3 THEN 'stale_template_technical_term' ELSE 'passed' END AS reason FROM e")
def grounding_audit(spark, d):
    b, docs = _t(spark, d, "benchmark"), _docs(spark, d)
    rows = b.select("item_id", F.lit("definition").alias("kind"), F.when(F.col("item_id") % 10 != 3, F.col("text")).alias("excerpt"), "text")
    return cards.grounding_audit(rows, grounding.grounded(b, docs), grounding.absent_terms(b, docs, 10), stale=3).select("item_id", "reason")


PACK = f"""k AS (SELECT lang AS pack_id, CASE {KIND} WHEN 'theorem' THEN 'derivation' ELSE {KIND} END AS kind, doc_id AS position, source || ' ' || doc_id % 50 AS name, coalesce(text, '') AS body FROM documents)"""


def _pack(spark, d) -> DataFrame:
    i = _items(spark, d)
    return i.select(F.col("lang").alias("pack_id"), F.when(F.col("kind") == "theorem", "derivation").otherwise(F.col("kind")).alias("kind"), F.col("doc_id").alias("position"), F.concat_ws(" ", "source", (F.col("doc_id") % 50).cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("body"))


@query(f"WITH {PACK}, r AS (SELECT *, row_number() OVER (PARTITION BY pack_id, kind ORDER BY position) AS n, name || ': ' || CASE kind WHEN 'definition' THEN substring(body, 1, 100) || CASE WHEN length(body) > 100 THEN '…' ELSE '' END WHEN 'proof' THEN substring(string_split(body, chr(10))[1], 1, 200) ELSE body END AS line FROM k WHERE kind IN ('definition', 'formula', 'proof')) SELECT pack_id, " + ", ".join(f"md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (kind = '{k}' AND n <= {m}), '')) AS {k}s" for k, m in (("definition", 12), ("formula", 12), ("proof", 10))) + " FROM r GROUP BY pack_id")
def cram_sheets(spark, d):
    got = cards.cram_sheet(_pack(spark, d))
    return got.select("pack_id", *[F.md5(F.array_join(c, "\n").cast("binary")).alias(c) for c in ("definitions", "formulas", "proofs")])


QUESTIONS = "CASE kind WHEN 'definition' THEN 'State the definition of “' || name || '” in exam form (one short paragraph).' WHEN 'formula' THEN 'Write ' || name || ' and identify each symbol; when does it apply?' WHEN 'proof' THEN 'Give the proof outline for ' || name || ' — main identities only.' ELSE 'Walk through the worked derivation: ' || name || ' — main steps only.' END"


@query(f"WITH {PACK}, q AS (SELECT *, {QUESTIONS} AS question, CASE kind WHEN 'definition' THEN 0 WHEN 'formula' THEN 1 WHEN 'proof' THEN 2 ELSE 3 END AS rank FROM k WHERE kind <> 'example'), u AS (SELECT *, row_number() OVER (PARTITION BY pack_id, substring(trim(regexp_replace({COLLAPSE('lower(question)')}, '[^a-z0-9? ]', '', 'g'), ' '), 1, 120) ORDER BY rank, position, question) AS c FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY rank, position, question) AS n FROM u WHERE c = 1) SELECT pack_id, n, question, md5(substring(body, 1, 800)) AS answer_md5 FROM n WHERE n <= 18")
def quick_recall(spark, d):
    got = cards.quick_recall(_pack(spark, d))
    return got.select("pack_id", F.col("n").cast("long").alias("n"), "question", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query(f"WITH {PACK} SELECT type, category, count(*) AS cards, count(DISTINCT front) AS fronts FROM (SELECT CASE kind WHEN 'definition' THEN 'definition' WHEN 'formula' THEN 'formula' WHEN 'proof' THEN 'proof' ELSE 'algorithm' END AS type, CASE kind WHEN 'definition' THEN 'mustKnowDefinitions' WHEN 'formula' THEN 'formulasToKnow' WHEN 'proof' THEN 'proofsToKnow' ELSE 'methodsAndTemplates' END AS category, name AS front FROM k WHERE kind <> 'derivation') GROUP BY ALL")
def flashcard_counts(spark, d):
    p = _pack(spark, d)
    of = lambda k: p.where(F.col("kind") == k)
    made = cards.flashcards(
        of("definition").select("pack_id", F.col("name").alias("term"), F.col("body").alias("definition"), F.lit("definition").alias("item_kind")), of("formula").select("pack_id", "name", F.col("body").alias("latex")),
        of("proof").select("pack_id", "name", F.col("body").alias("skeleton"), F.lit(None).cast("string").alias("mistake")), of("example").select("pack_id", F.col("name").alias("problem"), F.split("body", "\n").alias("steps")),
    )
    return made.groupBy("type", "category").agg(F.count("*").alias("cards"), F.count_distinct("front").alias("fronts"))


@query(f"WITH i AS (SELECT {KIND.replace('doc_id', 'd.doc_id')} AS type, d.doc_id, CASE WHEN toxic = 1 THEN 'reject' END AS decision, d.doc_id % 17 = 0 AS deleted, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (d.doc_id % 60) END AS next_due, d.doc_id % 4 = 0 AS reviewed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), l AS (SELECT *, NOT deleted AND coalesce(decision, 'keep') = 'keep' AS live FROM i) SELECT count(*) FILTER (live AND type = 'definition') AS definitions, count(*) FILTER (live AND type = 'formula') AS formulas, count(*) FILTER (live AND type = 'proof') AS proofs, count(*) FILTER (live AND type = 'example') AS practice, count(*) FILTER (live AND (next_due IS NULL OR next_due <= TIMESTAMP '2024-02-01')) AS due, count(*) FILTER (live AND type = 'definition' AND reviewed) AS reviewed_definitions FROM l")
def dashboard_counts(spark, d):
    i = _items(spark, d)
    day = F.timestamp_add("DAY", (F.col("doc_id") % 60).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = i.select(F.col("kind").alias("type"), F.lit(None).cast("string").alias("category"), F.when(F.col("kind") == "example", "worked_example_pattern").alias("purpose"), F.when(F.col("toxic") == 1, "reject").alias("decision"), (F.col("doc_id") % 17 == 0).alias("deleted"), F.when(F.col("doc_id") % 3 != 0, day).alias("next_due"), (F.col("doc_id") % 4 == 0).alias("reviewed"), F.lit("2024-02-01").cast("timestamp_ntz").alias("as_of"))
    return cards.dashboard(rows)

