"""The registered queries over the given tables, each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import chunks, gates, grounding, items, lines, priority, review, similarity, spans
from marginalia.sources import files

AS_OF = "2024-02-01 00:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents")


def _roled(spark, d) -> DataFrame:
    return _docs(spark, d).withColumn("role", X.role_of_source(F.col("source")))


def _pages(spark, d, *keep) -> DataFrame:
    return lines.pages_of(_docs(spark, d), 8, keep=keep)


ROLE = "CASE try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) % 8 " + " ".join(f"WHEN {k} THEN '{r}'" for k, (r, _) in enumerate(X.ROLES)) + " ELSE 'other' END"
WEIGHT = "CASE role " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in X.ROLES) + " ELSE 1 END"
SANE = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{00AD}]', '', 'g')"
LINES = f"""lines AS (SELECT doc_id, i - 1 AS line_index, a[i] AS line FROM (SELECT doc_id, string_split({SANE}, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))"""
N = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
LAYERED = rf"""{LINES}, trimmed AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM lines), layered AS (SELECT *, CASE WHEN length(t) = 0 THEN 'blank'
 WHEN (length(t) <= 2 AND regexp_matches(t, '^[A-Za-z0-9]$')) OR regexp_matches(t, '^[A-Za-z]{{1,3}}\.{{2,}}') OR (length(t) < 50 AND {N('t', '[A-Za-z0-9]')}::DOUBLE / greatest(length(t), 1) < 0.35 AND regexp_matches(t, '[^\sA-Za-z0-9.,;=+\-()\[\]{{}}]')) THEN 'noise'
 WHEN length(t) BETWEEN 6 AND 140 AND (regexp_matches(t, '[!?.]{{3,}}') OR {N('t', '[a-z][A-Z]')} >= 3 OR ({N('t', '[0-9]')} >= 4 AND {N('t', '[A-Za-z]')} >= 4 AND regexp_matches(t, '[0-9][A-Za-z][0-9]') AND length(t) < 90) OR regexp_matches(t, '\S{{36,}}')) THEN 'handwritten' ELSE 'printed' END AS layer FROM trimmed)"""
PAGES = f"""pages_ AS (SELECT doc_id, page, array_to_string(a[(page - 1) * 8 + 1 : page * 8], chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, greatest(1, ceil(len(a) / 8.0)::BIGINT) + 1)) AS page)), pages AS (SELECT *, length(text) AS chars FROM pages_)"""
COLLAPSE = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'), ' ')"
FOLD = lambda c: rf"regexp_replace({c}, '[^\x00-\x7F]', '|', 'g')"
SENTENCES = rf"""sents AS (SELECT doc_id, source, i - 1 AS sentence_index, {COLLAPSE('a[i]')} AS sentence FROM (SELECT doc_id, source, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)), sentences AS (SELECT *, {ROLE} AS role FROM sents WHERE length(sentence) BETWEEN 20 AND 500)"""
BIGRAMS = rf"""bigrams AS (SELECT regexp_replace(m, '\s+', ' ', 'g') AS phrase, count(*) AS hits FROM (SELECT unnest(regexp_extract_all({FOLD('lower(text)')}, '\b([a-z][a-z-]{{3,}})\s+([a-z][a-z-]{{3,}})\b')) AS m FROM documents) GROUP BY 1 HAVING count(*) >= 5)"""
EVIDENCE = rf"""{SENTENCES}, {BIGRAMS}, topics AS (SELECT phrase FROM bigrams ORDER BY hits DESC, phrase LIMIT 80),
 words AS (SELECT *, string_split({FOLD('lower(sentence)')}, ' ') AS w FROM sentences),
 pairs AS (SELECT DISTINCT doc_id, role, sentence_index, regexp_replace(w[i], '^[^a-z0-9-]+', '') || ' ' || regexp_replace(w[i + 1], '[^a-z0-9-]+$', '') AS phrase FROM words, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
 ranked AS (SELECT pairs.*, row_number() OVER (PARTITION BY doc_id, phrase ORDER BY sentence_index) AS k FROM pairs JOIN topics USING (phrase)), evidence AS (SELECT * FROM ranked WHERE k <= 5)"""


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars FROM documents")
def line_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {LAYERED} SELECT doc_id, layer, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM layered GROUP BY ALL")
def line_layers(spark, d):
    return lines.lines(_docs(spark, d)).groupBy("doc_id", "layer").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"WITH {LAYERED} SELECT doc_id, count(*) FILTER (layer = 'printed') AS n_printed, count(*) FILTER (layer = 'handwritten') AS n_handwritten, count(*) FILTER (layer = 'noise') AS n_noise, md5(coalesce(string_agg(CASE WHEN layer = 'blank' THEN '' ELSE line END, chr(10) ORDER BY line_index) FILTER (layer IN ('printed', 'blank')), '')) AS printed_md5 FROM layered GROUP BY 1")
def layer_texts(spark, d):
    return lines.layers(_docs(spark, d)).select("doc_id", "n_printed", "n_handwritten", "n_noise", F.md5(F.col("printed_text").cast("binary")).alias("printed_md5"))


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars, max(sentence_index) AS last_index FROM sentences GROUP BY 1")
def sentence_counts(spark, d):
    return lines.sentences(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.max("sentence_index").cast("long").alias("last_index"))


@query(f"WITH {BIGRAMS} SELECT phrase, hits FROM bigrams")
def bigram_topics(spark, d):
    return lines.bigram_topics(_docs(spark, d))


def _evidence(spark, d) -> DataFrame:
    topics = bigram_topics(spark, d).orderBy(F.desc("hits"), "phrase").select("phrase").limit(80)
    return priority.topic_evidence(lines.sentences(_roled(spark, d), keep=("role",)), topics)


@query(f"WITH {EVIDENCE}, w AS (SELECT phrase, sum({WEIGHT})::BIGINT AS weight, count(*) AS sentences, count(DISTINCT doc_id) AS documents, bool_or(role IN ('past_paper', 'exam_guidance')) AS assessed FROM evidence GROUP BY 1) SELECT phrase, weight, sentences, documents, CASE WHEN weight >= 16 AND assessed THEN 'very_high' WHEN weight >= 10 OR (assessed AND weight >= 6) THEN 'high' WHEN weight >= 4 THEN 'medium' ELSE 'low' END AS label FROM w")
def topic_priority(spark, d):
    return priority.topic_priorities(_evidence(spark, d))


@query(f"WITH {EVIDENCE} SELECT phrase, " + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}" for r, _ in X.ROLES) + " FROM evidence WHERE k <= 4 GROUP BY 1")
def topic_role_pivot(spark, d):
    return priority.role_frequencies(_evidence(spark, d))


@query(rf"WITH {SENTENCES}, asked AS (SELECT doc_id, {FOLD('lower(sentence)')} AS s FROM sentences WHERE role IN ('past_paper', 'problem_sheet', 'exam_guidance')) SELECT kind, count(*) FILTER (regexp_matches(s, pattern)) AS sentences, count(DISTINCT doc_id) FILTER (regexp_matches(s, pattern)) AS documents FROM asked, (VALUES " + ", ".join(f"('{k}', '{p}')" for k, p in priority.QUESTION_KINDS) + ") kinds(kind, pattern) GROUP BY 1")
def question_kinds(spark, d):
    return priority.question_kinds(lines.sentences(_roled(spark, d), keep=("role",)))


@query(f"WITH {PAGES} SELECT doc_id, ((page - 1) // 12)::BIGINT AS block, min(page) AS first_page, max(page) AS last_page, sum(chars)::BIGINT AS chars FROM pages GROUP BY ALL")
def page_windows(spark, d):
    got = spans.page_windows(_pages(spark, d))
    return got.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("block", "first_page", "last_page", "chars")])


LIMITS = (4, 1500, 1000)
CHUNKED = f"""RECURSIVE {PAGES}, headed AS (SELECT *, regexp_matches(text, '^[^\\n]{{4,40}}\\n') AS h FROM pages), walk AS (SELECT doc_id, page, chars, 1 AS chunk, 1 AS n, chars AS total FROM headed WHERE page = 1
 UNION ALL SELECT doc_id, page, chars, chunk + opens::INT, CASE WHEN opens THEN 1 ELSE n + 1 END, CASE WHEN opens THEN chars ELSE total + chars END FROM (SELECT h.doc_id, h.page, h.chars, w.chunk, w.n, w.total, (w.n >= 4 OR w.total + h.chars > 1500 OR (h.h AND w.total > 550)) AS opens FROM walk w JOIN headed h ON h.doc_id = w.doc_id AND h.page = w.page + 1)), chunked AS (SELECT w.doc_id, w.page, w.chunk, h.text FROM walk w JOIN headed h ON h.doc_id = w.doc_id AND h.page = w.page)"""


def _chunked(spark, d) -> DataFrame:
    pages = _pages(spark, d).withColumn("headed", F.col("text").rlike("^[^\\n]{4,40}\\n"))
    return chunks.chunk_pages(pages, LIMITS)


@query(f"WITH {CHUNKED} SELECT doc_id, page, chunk::BIGINT AS chunk FROM chunked")
def chunk_pages(spark, d):
    return _chunked(spark, d).select("doc_id", F.col("page").cast("long").alias("page"), F.col("chunk").cast("long").alias("chunk"))


@query(f"WITH {CHUNKED}, r AS (SELECT doc_id, chunk, min(page) AS first_page, max(page) AS last_page, substring(string_agg('Page ' || page || chr(10) || text, chr(10) || chr(10) ORDER BY page), 1, 1000) AS text FROM chunked GROUP BY ALL) SELECT doc_id, 'chunk-' || CASE WHEN chunk < 1000 THEN lpad(chunk::VARCHAR, 3, '0') ELSE chunk::VARCHAR END || '-p' || first_page || '-' || last_page AS chunk_id, md5(text) AS text_md5, ceil(length(text) / 4.0)::BIGINT AS tokens FROM r")
def render_chunks(spark, d):
    paged = _chunked(spark, d).join(_pages(spark, d), ["doc_id", "page"])
    return chunks.render_chunks(paged, LIMITS[2]).select("doc_id", "chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "tokens")


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS k FROM lines WHERE regexp_matches(line, '[=+*/<>]|[0-9]{{4}}')) SELECT doc_id, count(*) AS n_lines, sum(line_index)::BIGINT AS indexes FROM r WHERE k <= 80 GROUP BY 1")
def chunk_lines(spark, d):
    return chunks.important_lines(lines.lines(_docs(spark, d)), "[=+*/<>]|[0-9]{4}").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("line_index").alias("indexes"))


LEVELS = "SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations"


def _levels(spark, d) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3).alias("level"))


@query(f"WITH t AS ({LEVELS}) SELECT conv_id, turn, level::BIGINT AS level, (SELECT max(p.turn) FROM t p WHERE p.conv_id = t.conv_id AND p.turn < t.turn AND p.level < t.level) AS parent FROM t")
def span_parent(spark, d):
    return spans.parents(_levels(spark, d), "conv_id", "turn", levels=3).select("conv_id", "turn", F.col("level").cast("long").alias("level"), F.col("parent_order").alias("parent"))


@query(f"WITH t AS ({LEVELS}) SELECT conv_id, turn, (SELECT min(p.turn) FROM t p WHERE p.conv_id = t.conv_id AND p.turn > t.turn AND p.level <= t.level) AS next_boundary FROM t")
def span_next_boundary(spark, d):
    return spans.span_ends(_levels(spark, d), "conv_id", "turn", levels=3).select("conv_id", "turn", F.col("next_order").alias("next_boundary"))


@query("WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, turn AS start, greatest(turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last)) AS \"end\" FROM conversations JOIN m USING (conv_id) WHERE role = 'user'")
def range_from_starts(spark, d):
    c = _t(spark, d, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    return spans.ranges(c.where("role = 'user'").select("conv_id", F.col("turn").alias("start"), "last"), "conv_id", "start", F.col("last")).select("conv_id", "start", "end")


@query("WITH c AS (SELECT conv_id, turn AS position, turn AS start, turn + length(text) % 7 - 2 AS \"end\", max(turn) OVER (PARTITION BY conv_id) AS n FROM conversations), f AS (SELECT *, lag(start) OVER (PARTITION BY conv_id ORDER BY position) AS prev FROM c) SELECT DISTINCT conv_id, error FROM (SELECT conv_id, unnest([CASE WHEN start < 1 OR \"end\" > n THEN 'out_of_bounds' END, CASE WHEN start > \"end\" THEN 'start_after_end' END, CASE WHEN prev >= start THEN 'not_increasing' END, CASE WHEN \"end\" - start + 1 >= n * 0.9 THEN 'near_whole_span' END]) AS error FROM f) WHERE error IS NOT NULL UNION ALL SELECT conv_id, 'many_start_at_one' FROM c GROUP BY 1 HAVING avg((start = 1)::INT) > 0.55")
def range_validation(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("turn").alias("start"), (F.col("turn") + F.length("text") % 7 - 2).alias("end"), F.max("turn").over(Window.partitionBy("conv_id")).alias("n"))
    return spans.range_errors(c, "conv_id", F.col("n"))


@query(f"WITH {LINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines), p AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS pos FROM documents WHERE text IS NOT NULL) SELECT doc_id, pos AS \"at\", (SELECT max(line_index) FROM o WHERE o.doc_id = p.doc_id AND o.start <= p.pos) AS line_index FROM p")
def offset_to_line(spark, d):
    """The line of every five hundredth character."""
    docs = _docs(spark, d).where("text is not null")
    anchors = spans.line_offsets(lines.lines(docs)).select("doc_id", F.col("offset").cast("long").alias("at"), F.col("line_index").cast("long").alias("line_index"))
    asked = docs.select("doc_id", F.explode_outer(F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(500)))).alias("at")).where("at is not null").withColumn("at", F.col("at").cast("long"))
    return spans.as_of(asked, anchors, "doc_id", "at", "line_index").select("doc_id", "at", "line_index")


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'failed' WHEN length(text) < 250 THEN 'low' WHEN length(text) < 1500 THEN 'medium' ELSE 'high' END AS grade FROM documents")
def doc_quality_grade(spark, d):
    return _docs(spark, d).select("doc_id", X.quality_grade(F.length("text")).alias("grade"))


@query(f"WITH {PAGES} SELECT doc_id, count(*) FILTER (chars < 80) AS low, count(*) FILTER (chars BETWEEN 80 AND 299) AS medium, count(*) FILTER (chars >= 300) AS high, avg(chars) < 80 AS scanned FROM pages GROUP BY 1")
def page_quality(spark, d):
    q = X.page_quality(F.col("chars"))
    return _pages(spark, d).groupBy("doc_id").agg(*[F.count_if(q == k).alias(k) for k in ("low", "medium", "high")], (F.avg("chars") < 80).alias("scanned"))


@query(f"WITH {PAGES} SELECT doc_id, md5(string_agg('[Page ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS rendered_md5 FROM pages GROUP BY 1")
def render_documents(spark, d):
    return lines.render(_pages(spark, d)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("rendered_md5"))


@query(f"WITH {PAGES} SELECT doc_id, page, row_number() OVER (PARTITION BY source ORDER BY doc_id, page) AS flat_page FROM pages JOIN (SELECT doc_id, source FROM documents) USING (doc_id)")
def flat_page_numbers(spark, d):
    got = spans.numbered(_pages(spark, d, "source"), ["source"], "doc_id", ["page"], "flat_page")
    return got.select("doc_id", F.col("page").cast("long").alias("page"), "flat_page")


@query("SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END) AS capped_md5 FROM documents")
def cap_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.cap(F.col("text"), 500).cast("binary")).alias("capped_md5"))


@query("SELECT source, count(*) AS left_to_do FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def resume_anti(spark, d):
    return items.unfinished(_docs(spark, d), _t(spark, d, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("left_to_do"))


@query(rf"WITH u AS (SELECT 0 AS part, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents), k AS (SELECT part, id, substring({COLLAPSE('lower(text)')}, 1, 220) AS key FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, id) AS n FROM k) SELECT part::BIGINT AS part, id FROM r WHERE n = 1")
def merge_dedupe(spark, d):
    a = _t(spark, d, "benchmark").select(F.lit(0).cast("long").alias("part"), F.col("item_id").alias("id"), "text")
    b = _docs(spark, d).select(F.lit(1).cast("long").alias("part"), F.col("doc_id").alias("id"), "text")
    return items.merged_unique([a, b], F.substring(X.collapse(F.lower("text")), 1, 220), ["part", "id"]).select("part", "id")


NORMAL = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY k) AS copies FROM (SELECT doc_id, substring({NORMAL('text')}, 1, 180) AS k FROM documents)")
def dup_exact(spark, d):
    got = similarity.first_by_key(_docs(spark, d), F.substring(X.key_text(F.col("text")), 1, 180), "doc_id")
    return got.select("doc_id", F.col("rank").cast("long").alias("rank"), "copies")


@query(f"""WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({NORMAL('text')}, ' '), lambda w: length(w) > 2))) AS t FROM documents), c AS (SELECT t, min(doc_id) AS node FROM s WHERE len(t) > 0 GROUP BY t), e AS (SELECT node, len(t) AS n, unnest(t) AS w FROM c),
 p AS (SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.w = b.w AND a.node < b.node AND least(a.n, b.n) >= 0.88 * greatest(a.n, b.n) GROUP BY 1, 2), near AS (SELECT b AS node, min(a) AS near FROM p WHERE common::DOUBLE / (na + nb - common) > 0.88 GROUP BY 1),
 f AS (SELECT t, least(node, coalesce(near, node)) AS first FROM c LEFT JOIN near USING (node)) SELECT doc_id, CASE WHEN first < doc_id THEN first END AS earlier FROM s LEFT JOIN f USING (t)""")
def dup_jaccard(spark, d):
    return similarity.earlier_duplicates(_docs(spark, d), X.token_set(F.col("text")), 0.88)


@query("SELECT k AS block_key, doc_id FROM (SELECT doc_id, substring(text, 1, 20) AS k, row_number() OVER (PARTITION BY substring(text, 1, 20) ORDER BY length(text) DESC, doc_id) AS n FROM documents) WHERE n = 1")
def block_dedupe(spark, d):
    return similarity.best_by_key(_docs(spark, d), F.substring("text", 1, 20), F.length("text"), "doc_id").select(F.substring("text", 1, 20).alias("block_key"), "doc_id")


@query(rf"WITH e AS (SELECT item_id, substring({COLLAPSE('lower(text)')}, 1, 120) AS p FROM benchmark), s AS (SELECT doc_id, {COLLAPSE('lower(text)')} AS s FROM documents) SELECT item_id, doc_id FROM e JOIN s ON contains(s, p) WHERE length(p) >= 10")
def grounded_items(spark, d):
    return grounding.grounded(_t(spark, d, "benchmark"), _docs(spark, d))


@query(rf"WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({FOLD('lower(text)')}, '\b[a-z]{{10,}}\b')) AS term FROM benchmark), s AS (SELECT lower(text) AS s FROM documents) SELECT item_id, term FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(s, term))")
def absent_terms(spark, d):
    return grounding.absent_terms(_t(spark, d, "benchmark"), _docs(spark, d), 10)


@query(rf"""WITH b AS (SELECT item_id, {COLLAPSE(FOLD('lower(text)'))} AS s FROM benchmark), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(s, '\b[a-z]{{5,}} [a-z]{{5,}} [a-z]{{5,}} [a-z]{{5,}}\b')) AS phrase FROM b), docs AS (SELECT {COLLAPSE(FOLD('lower(text)'))} AS s FROM documents),
 v AS (SELECT DISTINCT unnest(regexp_extract_all(s, '\b[a-z]{{5,}}\b')) AS w FROM docs), left_ AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM docs WHERE regexp_matches(s, '\b' || phrase || '\b'))), w AS (SELECT item_id, phrase, unnest(string_split(phrase, ' ')) AS w FROM left_) SELECT item_id, phrase, avg((w IN (SELECT w FROM v))::INT) AS grounded FROM w GROUP BY ALL HAVING avg((w IN (SELECT w FROM v))::INT) < 0.75""")
def phrase_contamination(spark, d):
    return grounding.ungrounded_phrases(_t(spark, d, "benchmark"), _docs(spark, d), 5)


GATED = """gated AS (SELECT d.doc_id, d.lang, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'reject' WHEN length(text) < 250 THEN 'review' WHEN regexp_matches(text, '[!?.]{3,}') THEN 'review' WHEN quality IS NULL AND length(text) > 12000 THEN 'review' ELSE 'keep' END AS decision,
 CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low quality' WHEN length(text) < 250 THEN 'short' WHEN regexp_matches(text, '[!?.]{3,}') THEN 'marks in a row' WHEN quality IS NULL AND length(text) > 12000 THEN 'long and not labelled' ELSE 'passed' END AS reason,
 (coalesce(toxic = 1, false)::INT + coalesce(quality = 0, false)::INT + (length(text) < 250)::INT + regexp_matches(text, '[!?.]{3,}')::INT + (quality IS NULL AND length(text) > 12000)::INT)::BIGINT AS n_reasons FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _gated(spark, d) -> DataFrame:
    n = F.length("text")
    rules = [(F.col("toxic") == 1, "reject", "toxic"), (F.col("quality") == 0, "reject", "low quality"), (n < 250, "review", "short"), (F.col("text").rlike("[!?.]{3,}"), "review", "marks in a row"), (F.col("quality").isNull() & (n > 12000), "review", "long and not labelled")]
    return gates.gate(_docs(spark, d).join(_t(spark, d, "labels"), "doc_id", "left"), rules)


@query(f"WITH {GATED} SELECT doc_id, decision, reason, n_reasons FROM gated")
def gate_documents(spark, d):
    return _gated(spark, d).select("doc_id", "decision", "reason", F.size("reasons").cast("long").alias("n_reasons"))


@query(f"WITH {GATED} SELECT lang, decision, reason, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM gated GROUP BY ALL")
def gate_report(spark, d):
    return gates.report(_gated(spark, d), "lang")


@query(f"WITH {GATED} SELECT decision, count(*) AS kept_copies, count(DISTINCT lang) AS langs FROM gated GROUP BY 1")
def curation_counts(spark, d):
    return _gated(spark, d).groupBy("decision").agg(F.count("*").alias("kept_copies"), F.count_distinct("lang").alias("langs"))


KIND = "CASE doc_id % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'theorem' WHEN 2 THEN 'proof' WHEN 3 THEN 'formula' ELSE 'example' END"


def _items(spark, d) -> DataFrame:
    k = F.pmod("doc_id", F.lit(5))
    kind = F.when(k == 0, "definition").when(k == 1, "theorem").when(k == 2, "proof").when(k == 3, "formula").otherwise("example")
    return _docs(spark, d).join(_t(spark, d, "labels"), "doc_id", "left").withColumns({"item_id": F.col("doc_id"), "kind": kind, "tags": F.array("lang", "source"), "grade": X.quality_grade(F.length("text"))})


@query(f"WITH i AS (SELECT d.doc_id AS item_id, {KIND.replace('doc_id', 'd.doc_id')} AS kind, length(text) AS n, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT item_id, unnest(list_filter([CASE WHEN kind = 'definition' THEN 'mustKnowDefinitions' END, CASE WHEN kind IN ('theorem', 'proof') THEN 'theory' END, CASE WHEN n > 2000 THEN 'long' END, CASE WHEN quality = 1 THEN 'checked' END], lambda x: x IS NOT NULL)) AS category FROM i")
def category_membership(spark, d):
    i = _items(spark, d)
    return items.memberships(i, {"mustKnowDefinitions": F.col("kind") == "definition", "theory": F.col("kind").isin("theorem", "proof"), "long": F.length("text") > 2000, "checked": F.col("quality") == 1})


@query(f"SELECT CASE kind WHEN 'definition' THEN 'mustKnowDefinitions' WHEN 'theorem' THEN 'coreTheorems' WHEN 'proof' THEN 'proofsToKnow' WHEN 'formula' THEN 'keyFormulas' ELSE 'other' END AS category, count(*) AS items FROM (SELECT {KIND} AS kind FROM documents) GROUP BY 1")
def first_category(spark, d):
    return _items(spark, d).groupBy(items.category(F.col("kind")).alias("category")).agg(F.count("*").alias("items"))


@query(f"SELECT prompt, count(*) AS items, min(doc_id) AS first_item FROM (SELECT doc_id, substring({NORMAL('text')}, 1, 140) AS prompt FROM documents) GROUP BY 1 HAVING count(*) > 1")
def repeated_prompts(spark, d):
    return items.repeated_prompts(_items(spark, d), F.substring(X.key_text(F.col("text")), 1, 140))


@query("WITH p AS (SELECT count(*) AS n, count(DISTINCT lang) AS langs, count(*) FILTER (length(text) >= 1500)::DOUBLE / count(*) AS high, count(DISTINCT text)::DOUBLE / count(*) AS uniq, max(length(text)) AS longest FROM documents), l AS (SELECT avg(quality) AS q, avg(toxic) AS t FROM labels) SELECT unnest(['enough_items', 'several_languages', 'half_high', 'mostly_unique', 'not_too_long', 'labels_good', 'few_toxic']) AS test, unnest([n >= 25, langs >= 2, high >= 0.5, uniq >= 0.8, longest <= 95000, q >= 0.75, t <= 0.2]) AS passed FROM p, l")
def acceptance_matrix(spark, d):
    n = F.length("text")
    pack = _docs(spark, d).agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.avg((n >= 1500).cast("int")).alias("high"), (F.count_distinct(F.sha2("text", 256)) / F.count("*")).alias("uniq"), F.max(n).alias("longest")).crossJoin(_t(spark, d, "labels").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t")))
    c = F.col
    return gates.acceptance(pack, {"enough_items": c("n") >= 25, "several_languages": c("langs") >= 2, "half_high": c("high") >= 0.5, "mostly_unique": c("uniq") >= 0.8, "not_too_long": c("longest") <= 95000, "labels_good": c("q") >= 0.75, "few_toxic": c("t") <= 0.2})


@query("WITH i AS (SELECT d.doc_id, length(text) AS n, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'review' END AS decision, d.doc_id % 17 = 0 AS deleted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT count(*) FILTER (NOT deleted AND coalesce(decision, 'keep') = 'keep') AS kept, count(*) FILTER (NOT deleted AND (decision = 'review' OR n < 250)) AS checking, count(*) FILTER (NOT deleted AND decision = 'review') AS needs_review, count(*) FILTER (NOT deleted AND decision = 'reject') AS rejected, count(*) FILTER (NOT deleted AND n > 0 AND n < 250) AS low_quality, count(*) FILTER (deleted) AS deleted FROM i")
def status_tabs(spark, d):
    i = _items(spark, d).withColumns({"decision": F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "review"), "deleted": F.pmod("doc_id", F.lit(17)) == 0})
    return items.tab_counts(i)


@query(f"SELECT doc_id AS item_id, {KIND} AS kind FROM documents WHERE contains(lower(text), 'licensed') AND lang = 'en' AND contains(lower(source), 'src1')")
def item_filters(spark, d):
    return items.matching(_items(spark, d), search="licensed", equals={"lang": "en"}, any_tag="src1").select("item_id", "kind")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(spark, d):
    return review.latest(_t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("WITH c AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM benchmark), n AS (SELECT count(*) AS n FROM c) SELECT doc_id AS slot, item_id FROM documents, n JOIN c ON true WHERE position = doc_id % n")
def practice_round_robin(spark, d):
    c = spans.numbered(_t(spark, d, "benchmark"), [], "item_id", [], "n").select("item_id", (F.col("n") - 1).alias("position"))
    return items.round_robin(_docs(spark, d).select(F.col("doc_id").alias("slot")), c).select("slot", "item_id")


@query("SELECT source, doc_id, signal, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY signal DESC, doc_id) AS k FROM (SELECT source, doc_id, (CASE WHEN regexp_matches(text, '[=<>]') THEN 8 ELSE 0 END + CASE WHEN length(text) BETWEEN 200 AND 2000 THEN 4 ELSE 0 END)::BIGINT AS signal FROM documents)) WHERE k <= 10")
def top_candidates(spark, d):
    s = (F.when(F.col("text").rlike("[=<>]"), 8).otherwise(0) + F.when(F.length("text").between(200, 2000), 4).otherwise(0)).cast("long")
    return items.top_by_signal(_docs(spark, d), "source", s, "doc_id", 10).select("source", "doc_id", "signal", F.col("rank").cast("long").alias("rank"))


RATING = "CASE event_type WHEN 'error' THEN 'again' WHEN 'click' THEN 'hard' WHEN 'view' THEN 'good' WHEN 'purchase' THEN 'easy' END"
REVIEWS = f"reviews AS (SELECT * FROM (SELECT event_id, user_id AS item_id, ts, {RATING} AS rating FROM events) WHERE rating IS NOT NULL)"
STATE = f"{REVIEWS}, state AS (SELECT item_id, rating, reviews, ts AS last_ts, ts + to_days(CASE rating WHEN 'hard' THEN 1 WHEN 'good' THEN 3 WHEN 'easy' THEN 7 ELSE 0 END) AS due_ts FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS reviews, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) AS k FROM reviews) WHERE k = 1)"


def _reviews(spark, d) -> DataFrame:
    return review.review_events(_t(spark, d, "events"))


def _plain(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query(f"WITH {STATE} SELECT item_id, rating, reviews, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, strftime(due_ts, '%Y-%m-%d %H:%M:%S') AS due_ts FROM state")
def srs_state(spark, d):
    return _plain(review.review_state(_reviews(spark, d)), "last_ts", "due_ts")


@query(f"WITH {STATE} SELECT custkey AS item_id, rating FROM (SELECT c_custkey AS custkey FROM customer) c LEFT JOIN state ON item_id = custkey WHERE due_ts IS NULL OR due_ts <= TIMESTAMP '{AS_OF}'")
def due_queue(spark, d):
    return review.due_queue(_t(spark, d, "customer").select(F.col("c_custkey").alias("item_id")), review.review_state(_reviews(spark, d)), AS_OF).select("item_id", "rating")


@query(f"WITH {REVIEWS} SELECT c_mktsegment AS segment, count(*) AS items, count(r.item_id) AS reviewed, round(count(r.item_id)::DOUBLE / count(*), 6) AS share FROM customer LEFT JOIN (SELECT DISTINCT item_id FROM reviews) r ON c_custkey = r.item_id GROUP BY 1")
def review_coverage(spark, d):
    i = _t(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("segment"))
    return review.coverage(i, _reviews(spark, d), "segment")


@query(f"WITH {REVIEWS} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS reviews, count(*) FILTER (rating = 'again') AS again FROM reviews GROUP BY 1")
def review_windows(spark, d):
    return _plain(review.windows(_reviews(spark, d), "1 day"), "start")


@query(f"WITH {REVIEWS}, o AS (SELECT *, (ts - lag(ts) OVER w < INTERVAL 30 MINUTE) AS near FROM reviews WINDOW w AS (PARTITION BY item_id ORDER BY ts, event_id)), s AS (SELECT *, sum((NOT coalesce(near, false))::INT) OVER (PARTITION BY item_id ORDER BY ts, event_id) AS n FROM o) SELECT item_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS reviews FROM s GROUP BY item_id, n")
def review_sessions(spark, d):
    return _plain(review.sessions(_reviews(spark, d)), "start")


@query(f"WITH {REVIEWS} SELECT rating, count(*) AS attempts, count(DISTINCT item_id) AS items, round(count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM customer), 6) AS ratio FROM reviews GROUP BY 1")
def attempt_ratio(spark, d):
    bank = _t(spark, d, "customer").agg(F.count("*").alias("bank"))
    got = _reviews(spark, d).groupBy("rating").agg(F.count("*").alias("attempts"), F.count_distinct("item_id").alias("items"))
    return got.crossJoin(F.broadcast(bank)).select("rating", "attempts", "items", F.round(F.col("items") / F.col("bank"), 6).alias("ratio"))


@query(f"WITH {REVIEWS} SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'reviews', count(*) FROM reviews")
def table_row_counts(spark, d):
    return files.row_counts({"customer": _t(spark, d, "customer"), "documents": _docs(spark, d), "reviews": _reviews(spark, d)})


@query(f"SELECT role, count(*) AS documents, sum({WEIGHT})::BIGINT AS weight FROM (SELECT {ROLE} AS role FROM documents) GROUP BY 1")
def role_union(spark, d):
    return _roled(spark, d).groupBy("role").agg(F.count("*").alias("documents"), F.sum(X.role_weight(F.col("role"))).alias("weight"))


@query(f"SELECT doc_id AS item_id, json_merge_patch('{{}}', to_json({{'item_id': doc_id, 'kind': {KIND}, 'grade': CASE WHEN length(text) = 0 OR text IS NULL THEN 'failed' WHEN length(text) < 250 THEN 'low' WHEN length(text) < 1500 THEN 'medium' ELSE 'high' END, 'lang': lang, 'quality': quality}}))::VARCHAR AS json FROM documents LEFT JOIN labels USING (doc_id)")
def export_json(spark, d):
    return files.as_json(_items(spark, d).select("item_id", "kind", "grade", "lang", "quality"), "item_id")


@query()
def review_state_stream(spark, d):
    """The streaming state over the event table as a stream; equal to srs_state, see the tests."""
    from marginalia.streaming import review_state

    own = files.shared_dir(spark)
    name = f"review_state_{uuid.uuid4().hex}"
    source = _t(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return review_state.run_to_files(review_state.live_state(stream), f"{own}/{name}-state", f"{own}/{name}")


@query(f"WITH {STATE} SELECT item_id, rating, reviews, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, strftime(due_ts, '%Y-%m-%d %H:%M:%S') AS due_ts FROM state")
def review_stream_report(spark, d):
    """The same with its times as text, for SQL to compare."""
    return _plain(review_state_stream(spark, d), "last_ts", "due_ts")


FLAGS = ["paper", "sheet", "guidance", "solutions"]
SCORED = f"""{EVIDENCE}, flags AS (SELECT phrase, bool_or(role = 'past_paper') AS paper, bool_or(role = 'problem_sheet') AS sheet, bool_or(role = 'exam_guidance') AS guidance, bool_or(role = 'solution_sheet') AS solutions FROM evidence GROUP BY 1),
 scored AS (SELECT phrase, greatest(0, least(100, paper::INT * 30 + sheet::INT * 20 + guidance::INT * 20 + solutions::INT * 15))::BIGINT AS score FROM flags)"""


def _scores(spark, d) -> DataFrame:
    has = lambda r: F.bool_or(F.col("role") == r)
    flags = _evidence(spark, d).groupBy("phrase").agg(has("past_paper").alias("paper"), has("problem_sheet").alias("sheet"), has("exam_guidance").alias("guidance"), has("solution_sheet").alias("solutions"))
    return flags.select("phrase", priority.topic_score({n: F.col(n) for n in FLAGS}).cast("long").alias("score"))


@query(f"WITH {SCORED} SELECT phrase, score, CASE WHEN score >= 85 THEN 'very_high' WHEN score >= 65 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'unknown' END AS label FROM scored")
def topic_scores(spark, d):
    return _scores(spark, d).withColumn("label", priority.score_label(F.col("score")))


@query(f"WITH {SCORED}, u AS (SELECT phrase AS name, score, 0 AS part FROM scored UNION ALL SELECT upper(phrase), CASE WHEN hits >= 100 THEN 70 WHEN hits >= 20 THEN 50 ELSE 25 END, 1 FROM bigrams) SELECT name, score FROM u QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, part, name) = 1")
def merged_priorities(spark, d):
    first = _scores(spark, d).select(F.col("phrase").alias("name"), "score", F.lit("low").alias("label"))
    second = bigram_topics(spark, d).select(F.upper("phrase").alias("name"), F.lit(None).cast("long").alias("score"), F.when(F.col("hits") >= 100, "high").when(F.col("hits") >= 20, "medium").otherwise("low").alias("label"))
    return priority.merged(first, second).select("name", "score")


@query(f"WITH {EVIDENCE} SELECT count(DISTINCT t.phrase) AS topics, count(DISTINCT e.phrase) AS assessed, count(DISTINCT e.role) AS roles FROM topics t LEFT JOIN (SELECT * FROM evidence WHERE role IN ('past_paper', 'problem_sheet', 'exam_guidance')) e USING (phrase)")
def assessed_coverage(spark, d):
    e = _evidence(spark, d).where(F.col("role").isin("past_paper", "problem_sheet", "exam_guidance"))
    topics = bigram_topics(spark, d).orderBy(F.desc("hits"), "phrase").limit(80).select(F.col("phrase").alias("topic"))
    return topics.join(e.select("phrase", "role").distinct(), F.col("topic") == F.col("phrase"), "left").agg(F.count_distinct("topic").alias("topics"), F.count_distinct("phrase").alias("assessed"), F.count_distinct("role").alias("roles"))


@query(f"WITH {REVIEWS} SELECT item_id, event_id, rating, k AS newest FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) AS k FROM reviews)")
def review_history(spark, d):
    w = Window.partitionBy("item_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _reviews(spark, d).withColumn("newest", F.row_number().over(w).cast("long")).select("item_id", "event_id", "rating", "newest")


@query(f"WITH {REVIEWS}, w AS (SELECT rating, date_trunc('day', ts) - to_days(unnest(range(0, 7))::INT) AS start FROM reviews) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS reviews, count(*) FILTER (rating = 'again') AS again FROM w GROUP BY 1")
def review_weeks(spark, d):
    """Sliding weeks that begin each day."""
    return _plain(review.windows(_reviews(spark, d), "7 days", "1 day"), "start")


@query(f"WITH {PAGES}, t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS t, count(*) AS pages FROM pages GROUP BY 1) SELECT d.doc_id, coalesce(pages, 0) AS pages, md5(coalesce(t, d.text, '')) AS text_md5, length(substring(d.text, 1, 1000)) AS preview FROM documents d LEFT JOIN t USING (doc_id)")
def hydrate_documents(spark, d):
    """Stored documents (a preview) and pages put together again."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n")
    pages = _pages(spark, d).groupBy("doc_id").agg(text.alias("t"), F.count("*").alias("n"))
    stored = _docs(spark, d).select("doc_id", F.substring("text", 1, 1000).alias("preview"))
    return stored.join(pages, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("pages"), F.md5(F.coalesce("t", "preview", F.lit("")).cast("binary")).alias("text_md5"), F.length("preview").cast("long").alias("preview"))


@query(f"WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches(line, '[=+*/<>]')) AS formula_like, count(*) FILTER (regexp_matches(line, '\\b(MIT|Apache|GNU|BY-NC)\\b')) AS notices FROM lines GROUP BY 1")
def cue_counts(spark, d):
    got = lines.lines(_docs(spark, d)).withColumn("a", X.ascii_fold(F.col("line")))
    return got.groupBy("doc_id").agg(F.count_if(F.col("line").rlike("[=+*/<>]")).alias("formula_like"), F.count_if(F.col("a").rlike(r"\b(MIT|Apache|GNU|BY-NC)\b")).alias("notices"))


@query("SELECT doc_id, n_words, n FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n_words, length(text) AS n FROM documents) WHERE n_words > 1200 OR n > 95000")
def over_long(spark, d):
    w = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    return _docs(spark, d).select("doc_id", w.alias("n_words"), F.length("text").cast("long").alias("n")).where("n_words > 1200 or n > 95000")


from marginalia.plans import course_queries, structure_queries  # noqa: E402, F401  register more of them
