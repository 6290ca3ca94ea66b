"""Registered queries of headings, section blocks and rewriting, each with DuckDB SQL. Imported by queries.

The given prose has no headings, so its short lines stand in for them: their length gives level and kind, and the
lines of the first level are chapters. Pages have three lines. The rules of real headings have tests on own rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import blocks, collectors, contents, formulas, lines, priority, profile, profiles, rewriting, similarity, topics
from marginalia.plans.queries import BIGRAMS, COLLAPSE, FOLD, KIND, LINES, NORMAL, PAGES, SENTENCES, WEIGHT, _docs, _items, _pages, _roled, _t, bigram_topics, query
from marginalia.sources import files

HEADED = f"""{LINES}, paged AS (SELECT doc_id, line_index, line_index // 3 + 1 AS page, line FROM lines WHERE line IS NOT NULL),
heads AS (SELECT *, 1 + length(line) % 5 AS level, CASE length(line) % 5 WHEN 0 THEN 'chapter' WHEN 3 THEN CASE WHEN length(line) % 2 = 0 THEN 'theorem' ELSE 'definition' END WHEN 4 THEN 'proof' ELSE 'section' END AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS position FROM paged WHERE length(line) BETWEEN 4 AND 58),
lasts AS (SELECT doc_id, max(page) AS last FROM paged GROUP BY 1),
chapters AS (SELECT doc_id, row_number() OVER w AS number, line AS title, page AS first, greatest(page, coalesce(lead(page) OVER w - 1, last)) AS until FROM heads JOIN lasts USING (doc_id) WHERE level = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_index))"""
TRIMMED = lambda c: f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _body(name: str, source: str, *keys: str, least: int) -> str:
    """CTE name: keys, text of the lines of source(keys, page, line_index, line)."""
    k = ", ".join(keys)
    return f"""{name}_parts AS (SELECT {k}, page, string_agg(line, chr(10) ORDER BY line_index) AS body FROM {source} GROUP BY {k}, page HAVING {TRIMMED("string_agg(line, chr(10) ORDER BY line_index)")} <> ''),
{name}_all AS (SELECT {k}, {TRIMMED("string_agg('[Page ' || page || ']' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page)")} AS text FROM {name}_parts GROUP BY {k}), {name} AS (SELECT * FROM {name}_all WHERE length(text) >= {least})"""


def _paged(spark, d) -> DataFrame:
    return _paged_lines(_docs(spark, d))


def _paged_lines(docs: DataFrame) -> DataFrame:
    return lines.lines(docs).select("doc_id", (F.floor(F.col("line_index") / 3) + 1).cast("int").alias("page"), "line_index", "line")


def _heads(paged: DataFrame) -> DataFrame:
    n = F.length("line")
    kind = F.when(n % 5 == 0, "chapter").when(n % 5 == 4, "proof").when(n % 5 < 3, "section").when(n % 2 == 0, "theorem").otherwise("definition")
    return paged.where(n.between(4, 58)).select("doc_id", "page", "line_index", kind.alias("kind"), (n % 5 + 1).alias("level"), "line")


def _last_pages(paged: DataFrame) -> DataFrame:
    return paged.groupBy("doc_id").agg(F.max("page").alias("last"))


def _chapters(paged: DataFrame) -> DataFrame:
    marks = _heads(paged).where("level = 1").join(_last_pages(paged), "doc_id")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_index"))
    placed = marks.select("doc_id", number.alias("number"), F.col("line").alias("title"), F.col("page").alias("start"), "last")
    nxt = F.lead("start").over(Window.partitionBy("doc_id").orderBy("number"))
    return placed.withColumn("end", F.greatest("start", F.coalesce(nxt - 1, "last"))).drop("last")


@query(f"""WITH RECURSIVE {HEADED}, up AS (SELECT h.*, (SELECT max(p.position) FROM heads p WHERE p.doc_id = h.doc_id AND p.position < h.position AND p.level < h.level) AS parent,
 CASE WHEN kind = 'proof' THEN (SELECT max(p.position) FROM heads p WHERE p.doc_id = h.doc_id AND p.position < h.position AND p.kind = 'theorem') END AS anchor FROM heads h),
walk AS (SELECT doc_id, position, 1 AS depth, '' AS path FROM up WHERE parent IS NULL UNION ALL SELECT u.doc_id, u.position, w.depth + 1, CASE WHEN w.path = '' THEN '' ELSE w.path || '/' END || w.position FROM up u JOIN walk w ON u.doc_id = w.doc_id AND u.parent = w.position)
SELECT doc_id, position::BIGINT AS position, level::BIGINT AS level, parent::BIGINT AS parent, anchor::BIGINT AS anchor, depth::BIGINT AS depth, path FROM up JOIN walk USING (doc_id, position)""")
def heading_tree(spark, d):
    """Each heading's parent, path from the root, and for proofs the last result before."""
    got = blocks.heading_tree(_heads(_paged(spark, d)))
    return got.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("position", "level", "parent", "anchor", "depth")], F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(f"""WITH RECURSIVE {HEADED}, up AS (SELECT h.*, (SELECT max(p.position) FROM heads p WHERE p.doc_id = h.doc_id AND p.position < h.position AND p.level < h.level) AS parent,
 kind = 'proof' AND EXISTS (SELECT 1 FROM heads p WHERE p.doc_id = h.doc_id AND p.position < h.position AND p.kind = 'theorem') AS anchored FROM heads h),
walk AS (SELECT doc_id, position, 1 AS depth FROM up WHERE parent IS NULL UNION ALL SELECT u.doc_id, u.position, w.depth + 1 FROM up u JOIN walk w ON u.doc_id = w.doc_id AND u.parent = w.position),
child AS (SELECT doc_id, parent, min(position) AS position FROM up WHERE parent IS NOT NULL GROUP BY ALL),
sample AS (SELECT doc_id, min(position) AS position, 1 AS k FROM up WHERE parent IS NULL GROUP BY 1 UNION ALL SELECT s.doc_id, c.position, k + 1 FROM sample s JOIN child c ON c.doc_id = s.doc_id AND c.parent = s.position WHERE k < 6),
shown AS (SELECT doc_id, string_agg(substring({COLLAPSE('line')}, 1, 72), ' > ' ORDER BY k) AS sample_path FROM sample JOIN heads USING (doc_id, position) GROUP BY 1)
SELECT doc_id, count(*) FILTER (parent IS NULL) AS roots, count(*) AS nodes, max(depth)::BIGINT AS max_depth, count(*) FILTER (anchored) AS anchored, any_value(sample_path) AS sample_path FROM up JOIN walk USING (doc_id, position) JOIN shown USING (doc_id) GROUP BY 1""")
def heading_summary(spark, d):
    got = blocks.tree_summary(blocks.heading_tree(_heads(_paged(spark, d))))
    return got.select("doc_id", "roots", "nodes", F.col("max_depth").cast("long").alias("max_depth"), "anchored", F.array_join("sample_path", " > ").alias("sample_path"))


SPANNED = f"""spanned AS (SELECT h.*, (SELECT min(n.position) FROM heads n WHERE n.doc_id = h.doc_id AND n.position > h.position AND n.level <= h.level) AS nxt FROM heads h),
ended AS (SELECT s.doc_id, s.position, s.level, s.page AS start_page, s.line_index AS from_line, n.line_index AS to_line, {COLLAPSE('s.line')} AS name, CASE WHEN n.page IS NULL THEN last ELSE greatest(n.page - 1, s.page) END AS end_page, coalesce(s.nxt, 1000000) - s.position - 1 AS inner_, s.nxt FROM spanned s JOIN lasts USING (doc_id) LEFT JOIN heads n ON n.doc_id = s.doc_id AND n.position = s.nxt),
held AS (SELECT e.doc_id, e.position, p.page, p.line_index, p.line, (p.page - e.start_page) // 12 AS part FROM ended e JOIN paged p ON p.doc_id = e.doc_id AND p.line_index >= e.from_line AND (e.to_line IS NULL OR p.line_index < e.to_line))"""


def _spans_sql(name: str, least: int, keys: str = "doc_id, position") -> str:
    return _body(f"{name}_t", "held", *keys.split(", "), least=least) + f""", {name} AS (SELECT * FROM (SELECT e.*, t.text, row_number() OVER (PARTITION BY e.doc_id, name, start_page{' + 12 * part, least(end_page, start_page + 12 * part + 11)' if 'part' in keys else ', end_page'} ORDER BY position{', part' if 'part' in keys else ''}) AS k FROM ended e JOIN {name}_t t USING (doc_id, position)) WHERE k = 1)"""


@query(f"""WITH {HEADED}, {SPANNED}, {_spans_sql('b', 8)}, above AS (SELECT b.doc_id, b.position, (SELECT max_by({COLLAPSE('p.line')}, p.position) FROM heads p WHERE p.doc_id = b.doc_id AND p.position < b.position AND p.level < b.level AND p.kind IN ('chapter', 'section')) AS parent_section FROM b),
kids AS (SELECT b.doc_id, b.position, count(*) AS n FROM b JOIN heads h ON h.doc_id = b.doc_id AND h.position > b.position AND (b.nxt IS NULL OR h.position < b.nxt) GROUP BY ALL)
SELECT doc_id, position::BIGINT AS position, name AS heading, level::BIGINT AS level, start_page::BIGINT AS first_page, end_page::BIGINT AS last_page, parent_section, least(coalesce(n, 0), 32)::BIGINT AS n_children, md5(text) AS text_md5 FROM b LEFT JOIN above USING (doc_id, position) LEFT JOIN kids USING (doc_id, position)""")
def heading_blocks(spark, d):
    """A block from each heading to the next of its level or above, with its text."""
    paged = _paged(spark, d)
    got = blocks.heading_blocks(paged, _heads(paged))
    whole = lambda c, n: F.col(c).cast("long").alias(n)
    return got.select("doc_id", whole("position", "position"), "heading", whole("level", "level"), whole("start", "first_page"), whole("end", "last_page"), "parent_section", F.size("children").cast("long").alias("n_children"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


MAPPED = f"""placed AS (SELECT c.doc_id, c.number, c.title, c.first, c.until, p.page, p.line_index, p.line FROM chapters c JOIN paged p ON p.doc_id = c.doc_id AND p.page BETWEEN c.first AND c.until),
{_body('m_t', 'placed', 'doc_id', 'number', 'title', 'first', 'until', least=8)}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number || ' ' || trim(title), first, until ORDER BY number) AS k FROM m_t) WHERE k = 1)"""
AWARE = f"""marked AS (SELECT l.*, h.level, h.kind, h.position FROM placed l LEFT JOIN heads h USING (doc_id, line_index)),
counted AS (SELECT *, count(position) OVER c AS na, count(*) FILTER (kind IN ('section', 'theorem', 'definition')) OVER c AS nb FROM marked WINDOW c AS (PARTITION BY doc_id, number)),
cut AS (SELECT *, CASE WHEN na >= 2 THEN position IS NOT NULL WHEN nb >= 2 THEN coalesce(kind IN ('section', 'theorem', 'definition'), false) ELSE false END AS opens, na < 2 AND nb < 2 AS whole FROM counted),
under AS (SELECT *, max(CASE WHEN opens THEN line_index END) OVER (PARTITION BY doc_id, number ORDER BY line_index) AS spot_, min(CASE WHEN opens THEN line_index END) OVER (PARTITION BY doc_id, number ORDER BY line_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM cut),
inner_ AS (SELECT *, coalesce(spot_, -1) AS spot FROM under WHERE whole OR spot_ IS NOT NULL),
{_body('a_t', 'inner_', 'doc_id', 'number', 'spot', least=12)}, starts AS (SELECT u.doc_id, u.number, u.line_index AS spot, substring(u.line, 1, 220) AS heading, u.level, u.page AS first, CASE WHEN n.page IS NULL THEN u.until ELSE greatest(n.page - 1, u.page) END AS until FROM under u LEFT JOIN paged n ON n.doc_id = u.doc_id AND n.line_index = u.nxt WHERE opens),
wholes AS (SELECT DISTINCT doc_id, number, -1 AS spot, trim(number || ' ' || title) AS heading, 2 AS level, first, until FROM under WHERE whole),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, heading, first, until ORDER BY number, spot) AS k FROM (SELECT * FROM starts UNION ALL SELECT * FROM wholes) JOIN a_t USING (doc_id, number, spot)) WHERE k = 1)"""


@query(f"WITH {HEADED}, {MAPPED} SELECT doc_id, number::BIGINT AS chapter, trim(number || ' ' || title) AS heading, first::BIGINT AS first_page, until::BIGINT AS last_page, md5(text) AS text_md5 FROM m")
def chapter_blocks(spark, d):
    paged = _paged(spark, d)
    got = blocks.chapter_blocks(paged, _chapters(paged))
    return got.select("doc_id", F.col("chapter").cast("long").alias("chapter"), "heading", F.col("start").cast("long").alias("first_page"), F.col("end").cast("long").alias("last_page"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {HEADED}, {MAPPED}, {AWARE} SELECT doc_id, number::BIGINT AS chapter, heading, level::BIGINT AS level, first::BIGINT AS first_page, until::BIGINT AS last_page, md5(text) AS text_md5 FROM a")
def page_aware_blocks(spark, d):
    """Chapters parted at their inner headings."""
    paged = _paged(spark, d)
    got = blocks.page_aware_blocks(paged, _heads(paged), _chapters(paged))
    return got.select("doc_id", F.col("chapter").cast("long").alias("chapter"), "heading", F.col("level").cast("long").alias("level"), F.col("start").cast("long").alias("first_page"), F.col("end").cast("long").alias("last_page"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {HEADED}, {SPANNED}, {_spans_sql('s', 8)}, {_spans_sql('g', 10)}, {_spans_sql('u', 12, 'doc_id, position, part')}, {MAPPED}, {AWARE.replace('substring(u.line, 1, 220)', 'u.line')}, windowed AS (SELECT *, (page - min(page) OVER (PARTITION BY doc_id)) // 12 AS w FROM paged), {_body('w', 'windowed', 'doc_id', 'w', least=0)},
every AS (SELECT doc_id, 'semantic' AS way, length(text) AS chars FROM s UNION ALL SELECT doc_id, 'graph', length(text) FROM g UNION ALL SELECT doc_id, 'structural', length(text) FROM u UNION ALL SELECT doc_id, 'mapped', length(text) FROM m UNION ALL SELECT doc_id, 'aware', length(text) FROM a UNION ALL SELECT doc_id, 'windows', length(text) FROM w),
n AS (SELECT l.doc_id, last AS pages, (SELECT count(*) FROM heads h WHERE h.doc_id = l.doc_id) AS headings, (SELECT count(*) FROM chapters c WHERE c.doc_id = l.doc_id) AS chapters, {", ".join(f"(SELECT count(*) FROM every e WHERE e.doc_id = l.doc_id AND way = '{x}') AS {x}" for x in blocks.WAYS)} FROM lasts l),
s0 AS (SELECT *, CASE WHEN semantic >= 2 THEN 'semantic' WHEN chapters >= 2 THEN 'aware' ELSE 'none' END AS w, CASE WHEN semantic >= 2 THEN semantic WHEN chapters >= 2 THEN aware ELSE 0 END AS c FROM n),
s1 AS (SELECT * REPLACE (CASE WHEN t THEN 'mapped' ELSE w END AS w, CASE WHEN t THEN mapped ELSE c END AS c) FROM (SELECT *, c < 3 AND chapters >= 2 AND mapped > c AS t FROM s0)),
s2 AS (SELECT * REPLACE (CASE WHEN t THEN 'structural' ELSE w END AS w, CASE WHEN t THEN structural ELSE c END AS c) FROM (SELECT * EXCLUDE (t), (c < 3 AND headings < 4 AND structural > c) OR c = 0 AS t FROM s1)),
s3 AS (SELECT * REPLACE (CASE WHEN t THEN 'graph' ELSE w END AS w, CASE WHEN t THEN graph ELSE c END AS c) FROM (SELECT * EXCLUDE (t), pages > 28 AND c < 10 AND headings >= 4 AND semantic < 2 AND graph > c AS t FROM s2)),
s4 AS (SELECT * REPLACE (CASE WHEN t THEN 'windows' ELSE w END AS w) FROM (SELECT * EXCLUDE (t), NOT (headings >= 4 AND c >= 3) AND pages > 30 AND c < 10 AND windows >= 5 AS t FROM s3))
SELECT doc_id, way AS strategy, count(*) AS n_blocks, sum(chars)::BIGINT AS chars FROM every JOIN s4 USING (doc_id) WHERE way = w GROUP BY ALL""")
def block_strategy(spark, d):
    """How many blocks the builder chosen for each document makes. Documents don't depend on each other, so they are taken in turns."""
    docs = _docs(spark, d)
    return reduce(DataFrame.unionByName, files.in_turns(lambda turn: _strategies(docs.where(turn)), "doc_id", "strategies", docs))


def _strategies(docs: DataFrame) -> DataFrame:
    paged = _paged_lines(docs)
    heads, chapters = _heads(paged), _chapters(paged)
    numbers = _last_pages(paged).withColumnRenamed("last", "pages")
    for name, df in (("headings", heads), ("chapters", chapters)):
        numbers = numbers.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").fillna({name: 0})
    built = [blocks.heading_blocks(paged, heads), blocks.page_aware_blocks(paged, heads, chapters), blocks.chapter_blocks(paged, chapters), blocks.heading_blocks(paged, heads, 12, blocks.BUDGET), blocks.heading_blocks(paged, heads, 10), blocks.window_blocks(paged)]
    # the choice and the result read the blocks' lengths, so the texts are made once
    every = files.staged(reduce(DataFrame.unionByName, [b.select("doc_id", F.lit(way).alias("way"), F.length("text").alias("chars")) for way, b in zip(blocks.WAYS, built, strict=True)]), "block-sizes")
    got = blocks.chosen_blocks(*[every.where(F.col("way") == way).drop("way") for way in blocks.WAYS], numbers)
    return got.groupBy("doc_id", "strategy").agg(F.count("*").alias("n_blocks"), F.sum("chars").cast("long").alias("chars"))


TRIGRAMS = rf"""grams AS (SELECT m AS alias, count(*) AS hits FROM (SELECT unnest(regexp_extract_all({FOLD("lower(text)")}, '\b[a-z]{{4,}} [a-z]{{4,}} [a-z]{{4,}}\b')) AS m FROM documents) GROUP BY 1 HAVING count(*) >= 3),
 aliases AS (SELECT regexp_extract(alias, '^([a-z]+)', 1) AS phrase, alias FROM (SELECT * FROM grams ORDER BY hits DESC, alias LIMIT 60))"""


def _aliases(spark, d) -> DataFrame:
    """Topics named by the first word of frequent runs of three words, which are their aliases."""
    found = _docs(spark, d).select(F.explode_outer(F.regexp_extract_all(X.ascii_fold(F.lower("text")), F.lit(r"\b[a-z]{4,} [a-z]{4,} [a-z]{4,}\b"), F.lit(0))).alias("alias")).where("alias is not null")
    top = found.groupBy("alias").agg(F.count("*").alias("hits")).where("hits >= 3").orderBy(F.desc("hits"), "alias").limit(60)
    return top.select(F.regexp_extract("alias", "^([a-z]+)", 1).alias("phrase"), "alias")


@query(rf"""WITH {SENTENCES}, {TRIGRAMS}, hit AS (SELECT DISTINCT doc_id, role, phrase, sentence_index FROM sentences, aliases WHERE regexp_matches({FOLD("lower(sentence)")}, '\b' || alias || '\b')),
 first AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, phrase ORDER BY sentence_index) <= 5),
 {LINES}, sections AS (SELECT DISTINCT phrase, doc_id, (line_index + 1)::VARCHAR AS number FROM lines, aliases WHERE regexp_matches({FOLD("lower(" + COLLAPSE("line") + ")")}, '\b' || alias || '\b')),
 numbers AS (SELECT phrase, string_agg(number, ',' ORDER BY number) AS numbers FROM (SELECT DISTINCT phrase, number FROM sections WHERE (doc_id, phrase) IN (SELECT (doc_id, phrase) FROM first)) GROUP BY 1)
SELECT phrase, sum({WEIGHT})::BIGINT AS weight, count(*) AS sentences, count(DISTINCT doc_id) AS documents, coalesce(any_value(numbers), '') AS sections FROM first LEFT JOIN numbers USING (phrase) GROUP BY 1""")
def topic_aliases(spark, d):
    """Evidence for topics by aliases of three words, with the numbers of the sections (here: lines) that hold one."""
    aliases = files.staged(_aliases(spark, d), "aliases")
    found = files.staged(priority.alias_evidence(lines.sentences(_roled(spark, d), keep=("role",)), aliases), "alias-evidence")  # read for weights and for sections
    sections = lines.lines(_docs(spark, d)).select("doc_id", (F.col("line_index") + 1).cast("string").alias("number"), F.col("line").alias("text"))
    got = priority.topic_priorities(found).join(priority.topic_sections(sections, aliases, found), "phrase", "left")
    return got.select("phrase", "weight", "sentences", "documents", F.coalesce(F.array_join("numbers", ","), F.lit("")).alias("sections"))


@query(f"""WITH raw AS (SELECT 'd' || doc_id AS id, {KIND} AS type, regexp_extract(text, '[0-9]{{4}}') AS number, substring({NORMAL("text")}, 1, 30) AS title, text AS statement, length(text) % 7 AS score FROM documents
 UNION ALL SELECT 'b' || item_id, 'benchmark', '', '', text, length(text) % 5 FROM benchmark),
i AS (SELECT id, score, nullif(number, '') AS number, type, nullif({NORMAL("title")}, '') AS title, nullif({NORMAL("statement")}, '') AS c, list_sort(list_distinct(string_split({NORMAL("statement")}, ' '))) AS w, -score AS r FROM raw),
classes AS (SELECT c, any_value(w) AS w, min((r, id)) AS best FROM i WHERE c IS NOT NULL GROUP BY c), ids AS (SELECT *, row_number() OVER () AS n FROM classes),
held AS (SELECT a.n AS a, b.n AS b FROM ids a JOIN ids b ON a.n <> b.n AND length(a.c) < length(b.c) AND contains(b.c, a.c)),
words AS (SELECT n, len(w) AS size, unnest(w) AS t FROM ids), common AS (SELECT a.n AS a, b.n AS b, count(*) AS k, any_value(a.size) AS x, any_value(b.size) AS y FROM words a JOIN words b ON a.t = b.t AND a.n < b.n AND least(a.size, b.size) > 0.88 * greatest(a.size, b.size) GROUP BY ALL),
near AS (SELECT a, b FROM common WHERE k::DOUBLE / (x + y - k) > 0.88),
linked AS (SELECT a AS n, b AS m, 2 AS k FROM held UNION ALL SELECT b, a, 2 FROM held UNION ALL SELECT n, n, 2 FROM ids UNION ALL SELECT a, b, 3 FROM near UNION ALL SELECT b, a, 3 FROM near),
found AS (SELECT i.id, i.r, ids.best AS o, 2 AS k FROM i JOIN ids x ON x.c = i.c JOIN linked l ON l.n = x.n AND l.k = 2 JOIN ids ON ids.n = l.m UNION ALL SELECT i.id, i.r, ids.best, 3 FROM i JOIN ids x ON x.c = i.c JOIN linked l ON l.n = x.n AND l.k = 3 JOIN ids ON ids.n = l.m
 UNION ALL SELECT i.id, i.r, (SELECT min((r, id)) FROM i j WHERE j.type = i.type AND j.number = i.number), 0 FROM i WHERE number IS NOT NULL UNION ALL SELECT i.id, i.r, (SELECT min((r, id)) FROM i j WHERE j.title = i.title), 1 FROM i WHERE title IS NOT NULL),
best AS (SELECT id, min((o, k)) AS f FROM found WHERE o < (r, id) GROUP BY 1)
SELECT i.id, f[1][2] AS duplicate_of, CASE f[2] WHEN 0 THEN 'number' WHEN 1 THEN 'title' WHEN 2 THEN 'containment' WHEN 3 THEN 'similarity' END AS duplicate_reason FROM i LEFT JOIN best USING (id)""")
def dup_items(spark, d):
    """Documents and benchmark items that yield to a better row of the same number, title or statement; here a document's number is its first of four digits, its title its beginning."""
    text = F.col("text")
    docs = _items(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("kind").alias("type"), F.regexp_extract(text, "[0-9]{4}", 0).alias("number"), F.substring(X.key_text(text), 1, 30).alias("title"), text.alias("statement"), (F.length(text) % 7).alias("score"))
    asked = _t(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("benchmark").alias("type"), F.lit("").alias("number"), F.lit("").alias("title"), text.alias("statement"), (F.length(text) % 5).alias("score"))
    return similarity.without_duplicates(docs.unionByName(asked)).select("id", "duplicate_of", "duplicate_reason")


@query(f"""WITH {PAGES}, c AS (SELECT doc_id, (page - 1) // 2 AS k, min(page)::INT AS a, max(page)::INT AS b, sum(chars)::BIGINT AS chars, list(regexp_extract(text, '^[^\\n]*') ORDER BY page) FILTER (regexp_matches(text, '^[A-Za-z ]{{4,58}}[.](\\n|$)')) AS headings FROM pages GROUP BY ALL),
stats AS (SELECT doc_id, list({{'chunkId': 'chunk-' || k, 'pages': [a, b], 'chars': chars, 'estimatedTokens': ceil(chars / 4)::BIGINT, 'headings': coalesce(headings, [])}} ORDER BY a) AS s FROM c GROUP BY 1),
i AS (SELECT doc_id, {KIND} AS kind, CASE WHEN length(text) >= 1500 THEN 'kept' WHEN length(text) >= 250 THEN 'needs_review' ELSE 'rejected' END AS status, length(text) < 250 AS short, text IS NULL AS missing FROM documents)
SELECT i.doc_id AS job_id, to_json({{'jobId': i.doc_id, 'mode': CASE WHEN short THEN 'fast' ELSE 'standard' END, 'file': {{'name': 'document ' || i.doc_id, 'role': kind}}, 'chunkStats': coalesce(s, []), 'resultCounts': {{'items': (status = 'kept')::BIGINT, 'needsReviewItems': (status = 'needs_review')::BIGINT, 'rejectedItems': (status = 'rejected')::BIGINT,
 'definitions': (status = 'kept' AND kind = 'definition')::BIGINT, 'formulas': (status = 'kept' AND kind = 'formula')::BIGINT, 'proofs': (status = 'kept' AND kind = 'proof')::BIGINT, 'methods': 0::BIGINT}}, 'warnings': CASE WHEN short THEN ['short text'] ELSE [] END}})::VARCHAR AS json FROM i LEFT JOIN stats USING (doc_id)""")
def debug_documents(spark, d):
    """One JSON a document: its windows of two pages with their headings, its item and its warnings."""
    docs, n = _items(spark, d), F.length("text")
    mode, file = F.when(n < 250, "fast").otherwise("standard"), F.struct(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"), F.col("kind").alias("role"))
    jobs = docs.select(F.col("doc_id").alias("job_id"), mode.alias("mode"), file.alias("file"))
    pages = _pages(spark, d).select(F.col("doc_id").alias("job_id"), "page", "text", F.length("text").alias("chars"), F.concat(F.lit("chunk-"), F.floor((F.col("page") - 1) / 2).cast("string")).alias("chunk_id"))
    size = F.sum("chars").cast("long")
    chunks = pages.groupBy("job_id", "chunk_id").agg(F.min("page").cast("int").alias("first_page"), F.max("page").cast("int").alias("last_page"), size.alias("chars"), F.ceil(size / 4).cast("long").alias("tokens"))
    headings = pages.where(F.col("text").rlike(r"^[A-Za-z ]{4,58}[.](\n|$)")).select("job_id", "chunk_id", F.col("page").alias("position"), F.regexp_extract("text", r"^[^\n]*", 0).alias("heading"))
    status = F.when(n >= 1500, "kept").when(n >= 250, "needs_review").otherwise("rejected")
    items = docs.select(F.col("doc_id").alias("job_id"), status.alias("status"), "kind")
    warnings = docs.where(n < 250).select(F.col("doc_id").alias("job_id"), F.lit("short text").alias("warning"))
    return files.debug_documents(jobs, chunks, items, warnings, headings)


# stand-ins: later rules meet what earlier ones left, two belong to a language as their profile
REWRITES = [("marks", None, "&&&|%%%", "#"), ("sharps", None, "#+", " "), ("spaces", None, " {2,}", " "), ("the", "en", "\\bthe ([a-z]+)", "$1 the"), ("que", "fr", "\\bque\\b", "qui"), ("ing", None, "([a-z]+)ing\\b", "$1ed"), ("thed", None, "ted the", "tthe")]


def _rewrite_sql() -> str:
    steps, t = [], "r0"
    for k, (name, of, pattern, new) in enumerate(REWRITES):
        fits = "true" if of is None else f"lang = '{of}'"
        new = new.replace("$1", "\\1")
        steps.append(f"r{k + 1} AS (SELECT doc_id, lang, CASE WHEN {fits} THEN regexp_replace(t, '{pattern}', '{new}', 'g') ELSE t END AS t, list_append(hits, {{'rule': '{name}', 'hits': CASE WHEN {fits} THEN len(regexp_extract_all(t, '{pattern}')) ELSE 0 END}}) AS hits FROM {t})")
        t = f"r{k + 1}"
    return "WITH r0 AS (SELECT doc_id, lang, regexp_replace(text, '[^\\x00-\\x7F]', '|', 'g') AS t, CAST([] AS STRUCT(rule VARCHAR, hits BIGINT)[]) AS hits FROM documents), " + ", ".join(steps) + f" SELECT doc_id, md5(t) AS text_md5, h.rule AS rule, h.hits::BIGINT AS hits FROM (SELECT doc_id, t, unnest(hits) AS h FROM {t}) WHERE h.hits > 0"


@query(_rewrite_sql())
def rewrite_hits(spark, d):
    """Hits of each rule in each document, and the text that the rules leave."""
    rules = rewriting.rules_table(spark, [(k, name, of, pattern, new, False) for k, (name, of, pattern, new) in enumerate(REWRITES)])
    docs = _docs(spark, d).select("doc_id", X.ascii_fold(F.col("text")).alias("text"), "lang")
    done = rewriting.rewritten(docs, rules, profile="lang")
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.explode_outer("hits").alias("h")).where("h is not null").select("doc_id", "text_md5", "h.rule", F.col("h.hits").cast("long").alias("hits"))


FITS = lambda c: f"length({c}) BETWEEN 5 AND 72 AND {c} NOT IN ({', '.join(repr(x) for x in topics.STOP_PHRASES)}) AND (len(regexp_extract_all({c}, '\\S+')) <= 5 OR regexp_matches({c}, '[=∫∑]')) AND NOT regexp_matches({c}, '" + "|".join(p.replace("(?i)", "") for p in topics.NO_TOPIC) + "')"
BARE = lambda c: f"trim(regexp_replace({COLLAPSE(c)}, '^[0-9.)\\s]+', ''), ' ')"


@query(f"""WITH {HEADED}, titles AS (SELECT DISTINCT doc_id, trim(line, ' ') AS line FROM heads WHERE length(trim(line, ' ')) > 2), bare AS (SELECT doc_id, {BARE("line")} AS b FROM titles),
named AS (SELECT doc_id, lower(CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') ELSE b END) AS topic, 2 AS w FROM (SELECT doc_id, b, list_filter(string_split_regex(b, '\\s+'), lambda x: length(x) > 1) AS w FROM bare) WHERE length(b) BETWEEN 4 AND 70),
pairs AS (SELECT doc_id, regexp_replace(m, '\\s+', ' ', 'g') AS topic, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({FOLD("lower(text)")}, '\\b([a-z][a-z-]{{3,}})\\s+([a-z][a-z-]{{3,}})\\b')) AS m FROM documents) GROUP BY ALL),
both_ AS (SELECT doc_id, topic, w FROM named UNION ALL SELECT doc_id, topic, 1 FROM pairs WHERE n >= 5 AND topic NOT IN ({", ".join(repr(x) for x in topics.STOP_PAIRS)})),
top AS (SELECT * FROM (SELECT doc_id, topic, sum(w)::BIGINT AS weight FROM both_ WHERE {FITS("topic")} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, length(topic) DESC, topic) <= 80),
h AS (SELECT doc_id, page, lower({BARE("line")}) AS n, lower({COLLAPSE("line")}) AS f FROM heads), j AS (SELECT t.*, h.page, h.n IS NOT NULL AND length(n) >= 4 AND (contains(n, topic) OR contains(topic, substring(n, 1, 24))) AS names, coalesce(contains(f, substring(topic, 1, 16)), false) AS held FROM top t LEFT JOIN h USING (doc_id)),
g AS (SELECT doc_id, topic, any_value(weight) AS weight, count(DISTINCT page) FILTER (names) AS n, coalesce(string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) FILTER (names), '') AS pages, count(*) FILTER (held) AS w FROM j GROUP BY ALL)
SELECT doc_id, topic, weight, pages, round(CASE WHEN n > 0 THEN c ELSE least(c, 0.36) END, 4) AS confidence FROM (SELECT *, least(0.95::DOUBLE, 0.42::DOUBLE + 0.07::DOUBLE * least(5, w) + CASE WHEN n > 1 THEN 0.06::DOUBLE ELSE 0 END) AS c FROM g)""")
def document_topics(spark, d):
    """Each document's topics with the pages of the headings that name them."""
    docs = _docs(spark, d).select("doc_id", X.ascii_fold(F.lower("text")).alias("text"))
    heads = _heads(_paged(spark, d))
    got = topics.topic_pages(topics.document_topics(docs, heads), heads)
    return got.select("doc_id", "topic", "weight", F.array_join(F.array_sort(F.col("pages").cast("array<string>")), ",").alias("pages"), "confidence")


TERMS = f"{BIGRAMS}, terms AS (SELECT phrase AS topic, row_number() OVER (ORDER BY hits DESC, phrase) AS position FROM (SELECT * FROM bigrams ORDER BY hits DESC, phrase LIMIT 40))"


def _terms(spark, d) -> DataFrame:
    top = bigram_topics(spark, d).orderBy(F.desc("hits"), "phrase").limit(40)
    return top.select(F.col("phrase").alias("topic"), F.row_number().over(Window.orderBy(F.desc("hits"), "phrase")).alias("position"))  # 40 rows


def _course_sentences(spark, d) -> DataFrame:
    found = lines.sentences(_roled(spark, d), keep=("role", "lang")).where("role in ('exam_guidance', 'lecture_notes', 'past_paper')")
    return found.select(F.coalesce("lang", F.lit("none")).alias("course"), "role", "doc_id", "sentence_index", "sentence")


@query(f"""WITH {SENTENCES}, {TERMS}, s AS (SELECT coalesce(d.lang, 'none') AS course, s.role, s.doc_id, s.sentence_index, s.sentence FROM sentences s JOIN documents d USING (doc_id) WHERE role IN ('exam_guidance', 'lecture_notes', 'past_paper')),
guided AS (SELECT DISTINCT course FROM s WHERE role = 'exam_guidance'), hit AS (SELECT s.*, topic FROM s JOIN terms ON contains(lower(sentence), topic)),
first AS (SELECT *, row_number() OVER (PARTITION BY course, topic ORDER BY doc_id, sentence_index) AS k FROM (SELECT * FROM hit WHERE role = 'exam_guidance' OR course NOT IN (SELECT course FROM guided))),
e AS (SELECT course, topic, md5(string_agg(sentence, '|' ORDER BY k)) AS evidence_md5 FROM first WHERE k <= 5 GROUP BY ALL), n AS (SELECT course, topic, bool_or(role = 'exam_guidance') AS core FROM hit GROUP BY ALL)
SELECT course, topic, CASE WHEN core THEN 'core' ELSE 'supporting' END AS importance, coalesce(evidence_md5, md5('')) AS evidence_md5, 'definition_recall' AS likely_use FROM n LEFT JOIN e USING (course, topic)""")
def knowledge_map(spark, d):
    """Core and supporting topics of each language's documents with their evidence."""
    got = topics.knowledge_map(_course_sentences(spark, d), _terms(spark, d))
    return got.select("course", "topic", "importance", F.md5(F.array_join("evidence", "|").cast("binary")).alias("evidence_md5"), "likely_use")


@query(f"""WITH {SENTENCES}, {TERMS}, {PAGES}, s AS (SELECT coalesce(d.lang, 'none') AS course, s.role, s.sentence FROM sentences s JOIN documents d USING (doc_id) WHERE role IN ('exam_guidance', 'lecture_notes', 'past_paper')),
n AS (SELECT course, topic, position, CASE WHEN bool_or(role = 'exam_guidance') THEN 'core' ELSE 'supporting' END AS importance FROM s JOIN terms ON contains(lower(sentence), topic) GROUP BY ALL),
sec AS (SELECT coalesce(d.lang, 'none') AS course, p.doc_id, p.page, p.text FROM pages p JOIN documents d USING (doc_id)), m AS (SELECT doc_id, page, min((position, importance)) AS m FROM sec JOIN n ON n.course = sec.course AND contains(lower(text), topic) GROUP BY ALL)
SELECT course, doc_id, page::BIGINT AS page, md5(trim(regexp_replace(substring(text, 1, 240), '\\s+', ' ', 'g'), ' ')) AS summary_md5, coalesce(m[2], 'unknown') AS importance FROM sec LEFT JOIN m USING (doc_id, page)""")
def structure_map(spark, d):
    """Sections (here: pages) with the importance of the first topic that they hold."""
    terms = _terms(spark, d)
    courses = _docs(spark, d).select("doc_id", F.coalesce("lang", F.lit("none")).alias("course"))
    sections = _pages(spark, d).join(courses, "doc_id").select("course", "doc_id", F.col("page").cast("string").alias("number"), F.lit("").alias("title"), "text", F.col("page").alias("start"), F.col("page").alias("end"))
    got = topics.structure_map(sections, topics.knowledge_map(_course_sentences(spark, d), terms), terms)
    return got.select("course", "doc_id", F.col("start").cast("long").alias("page"), F.md5(F.col("summary").cast("binary")).alias("summary_md5"), "importance")


@query(f"""WITH {SENTENCES}, {TERMS}, hit AS (SELECT DISTINCT doc_id, topic FROM sentences JOIN terms ON regexp_matches({FOLD("lower(sentence)")}, '\\b' || topic || '\\b')),
w AS (SELECT a.topic, b.topic AS related, count(*) AS weight FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.topic <> b.topic GROUP BY ALL)
SELECT topic, related, weight, k::BIGINT AS k FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, related) AS k FROM w) WHERE k <= 5""")
def related_topics(spark, d):
    """For each topic the five that most documents hold with it."""
    aliases = _terms(spark, d).select(F.col("topic").alias("phrase"), F.col("topic").alias("alias"))
    held = priority.phrases_held(lines.sentences(_docs(spark, d)), "sentence", aliases, "doc_id").select(F.col("doc_id").alias("id"), F.col("phrase").alias("topic"))
    return topics.related_topics(held).withColumn("k", F.col("k").cast("long"))


@query(rf"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id, line_index, line_index // 12 AS page, trim(line, ' ') AS t FROM lines WHERE line IS NOT NULL), f AS (SELECT *, length(t) BETWEEN 8 AND 500 AND regexp_matches(t, '[=_/0-9]') AND NOT regexp_matches(t, '^[=≤≥<>]') AS s, length(t) BETWEEN 1 AND 500 AND (regexp_matches(t, '[=_/0-9]') OR regexp_matches(t, '^[=+\-]')) AS c FROM l),
walk AS (SELECT doc_id, page, line_index, t, CASE WHEN s THEN line_index END AS first FROM f WHERE line_index % 12 = 0 UNION ALL SELECT n.doc_id, n.page, n.line_index, n.t, CASE WHEN n.c AND w.first IS NOT NULL AND n.line_index - w.first < 8 THEN w.first WHEN n.s THEN n.line_index END FROM walk w JOIN f n ON n.doc_id = w.doc_id AND n.page = w.page AND n.line_index = w.line_index + 1)
SELECT doc_id, (page + 1)::BIGINT AS page, first::BIGINT AS first_line, max(line_index)::BIGINT AS last_line, md5(string_agg(t, chr(10) ORDER BY line_index)) AS text_md5 FROM walk WHERE first IS NOT NULL GROUP BY doc_id, page, first""")
def formula_runs(spark, d):
    """Runs of lines with signs of a formula; here digits and a few marks stand in for these."""
    paged = lines.lines(_docs(spark, d)).select("doc_id", (F.floor(F.col("line_index") / 12) + 1).cast("int").alias("page"), "line_index", "line")
    got = collectors.formula_runs(paged, "[=_/0-9]")
    return got.select("doc_id", F.col("page").cast("long").alias("page"), F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {HEADED}, t AS (SELECT doc_id, position, {COLLAPSE("'Title ' || trim(regexp_replace(" + FOLD("line") + ", '[^A-Za-z]+', ' ', 'g'), ' ') || ' end'")} AS title, position + 1 AS page FROM heads WHERE position <= 40),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, CASE WHEN position % 3 = 2 THEN 'u' || (position // 3 + 1) ELSE position::VARCHAR END AS label, lead(page) OVER (PARTITION BY doc_id ORDER BY position) AS nxt FROM t)
SELECT doc_id, position::BIGINT AS position, label, title, page::BIGINT AS first_page, CASE WHEN nxt IS NULL THEN 60 ELSE nxt - 1 END::BIGINT AS last_page FROM n WHERE n >= 2""")
def contents_entries(spark, d):
    """Contents printed from each document's first 40 headings (leaders, page below, without number) and read again."""
    tree = blocks.heading_tree(_heads(_paged(spark, d))).where("position <= 40")
    title = F.concat(F.lit("Title "), F.trim(F.regexp_replace(X.ascii_fold(F.col("line")), "[^A-Za-z]+", " ")), F.lit(" end"))
    k, page = F.col("position").cast("string"), (F.col("position") + 1).cast("string")
    row = F.when(F.col("position") % 3 == 0, F.concat_ws(" ", k, title, F.lit("......"), page)).when(F.col("position") % 3 == 1, F.concat(k, F.lit(" "), title, F.lit("\n"), page)).otherwise(F.concat_ws(" ", title, F.lit("......"), page))
    text = F.concat(F.lit("Contents\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("t")))), lambda s: s["t"]), "\n"))
    first = tree.groupBy("doc_id").agg(text.alias("text")).select("doc_id", F.lit(1).alias("page"), "text")
    pages = first.unionByName(first.select("doc_id", F.lit(60).alias("page"), F.lit("").alias("text")))
    got = contents.contents_entries(pages)
    return got.select("doc_id", F.col("position").cast("long").alias("position"), "label", "title", F.col("start").cast("long").alias("first_page"), F.col("end").cast("long").alias("last_page"))


_SPOKEN = " OR ".join(f"(regexp_matches(t, '{p}')" + (f" AND length(t) < {most})" if most else ")") for p, most in profile.NO_TITLE)
_PART = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in profile.FRONT) + " ELSE '' END"


@query(f"""WITH {LINES}, l AS (SELECT doc_id, line_index, line_index // 3 + 1 AS page, {FOLD("line")} AS line FROM lines WHERE line IS NOT NULL), c AS (SELECT *, {COLLAPSE("line")} AS t FROM l),
f AS (SELECT doc_id, max(page)::BIGINT AS pages, count(*) AS lines, {", ".join(f"bool_or(regexp_matches(trim(line, ' '), '{p}')) AS {k}" for k, p in profile.FLAGS.items())}, sum(len(regexp_extract_all(line, '=')))::BIGINT AS formula_signs FROM l GROUP BY 1),
p AS (SELECT *, {_PART} AS part, trim(regexp_replace(t, '(?i)\\b(Department|Faculty)\\s+of.+$', ''), ' ') AS cut FROM c WHERE t <> '' AND page <= 8),
ok AS (SELECT doc_id, min((page, line_index, substring(CASE WHEN length(cut) >= 10 THEN cut ELSE t END, 1, 120))) AS v FROM p WHERE length(t) BETWEEN 10 AND 160 AND NOT ({_SPOKEN}) AND NOT regexp_matches(t, '{profile.NUMBERED}') AND part NOT IN ('department', 'institution', 'contact', 'instructor', 'admin') GROUP BY 1),
notes AS (SELECT doc_id, least(24, count(*))::BIGINT AS n FROM p WHERE part IN ('department', 'institution', 'contact', 'instructor', 'admin') GROUP BY 1)
SELECT d.doc_id, f.pages, f.lines, {", ".join(f"f.{k}" for k in profile.FLAGS)}, formula_signs, v[3] AS front_title, coalesce(notes.n, 0) AS admin_notes FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN ok USING (doc_id) LEFT JOIN notes USING (doc_id)""")
def document_profiles(spark, d):
    """The wide profile of each document; of its columns those that SQL can give too."""
    docs = _docs(spark, d).withColumn("text", X.ascii_fold(F.col("text")))
    paged = lines.lines(docs).withColumn("page", (F.floor(F.col("line_index") / 3) + 1).cast("int"))
    got = profiles.document_profiles(paged, docs.select("doc_id", F.lit("").alias("name")))
    title = F.when(F.col("reason") == "explicit_front_matter_title", F.col("title"))
    return got.select("doc_id", F.col("pages").cast("long").alias("pages"), "lines", *profile.FLAGS, "formula_signs", title.alias("front_title"), F.size("admin_notes").cast("long").alias("admin_notes"))


_NUMBER = lambda p: f"len(regexp_extract_all(t, '{p}'))"


@query(f"""WITH {LINES}, l AS (SELECT doc_id, trim({FOLD("line")}, ' ') AS t FROM lines), c AS (SELECT *, length(t) AS n, {_NUMBER("\\S+")} AS w, {_NUMBER(formulas.DENSE)}::DOUBLE / greatest(1, {_NUMBER("\\S+")}) AS density, CASE WHEN contains(t, '=') THEN substring(t, instr(t, '=') + 1) ELSE '' END AS after FROM l WHERE t <> ''),
r AS (SELECT doc_id, CASE WHEN n NOT BETWEEN 6 AND 500 THEN 'length' WHEN NOT regexp_matches(t, '{formulas.FIRST}') THEN 'no_sign' WHEN NOT regexp_matches(t, '{formulas.SECOND}') THEN 'no_second_sign' WHEN regexp_matches(t, '{formulas.CONTINUED}') THEN 'continuation' WHEN regexp_matches(t, '{formulas.DOTS}') THEN 'run_of_dots' WHEN {_NUMBER("[.]{2,}")} >= 3 THEN 'many_dots'
 WHEN after <> '' AND length(regexp_replace(after, '[\\s.0-9·,]', '', 'g')) = 0 THEN 'numbers_only' WHEN regexp_matches(t, '{formulas.DECIMALS}') THEN 'row_of_decimals' WHEN regexp_matches(t, '{formulas.MATRIX_ROW}') THEN 'matrix_row' WHEN regexp_matches(t, '{formulas.STEP}') THEN 'step' WHEN w > 18 AND density < 0.12 THEN 'sparse'
 WHEN w > 14 AND density < 0.18 AND NOT regexp_matches(t, '{formulas.KNOWN}') THEN 'rather_sparse' WHEN length(regexp_extract(t, '{formulas.PROSE}'))::DOUBLE / n > 0.55 THEN 'prose' WHEN regexp_matches(t, '{formulas.FIVE_WORDS}') AND w > 10 AND {_NUMBER(formulas.SPANS)} < 2 THEN 'reference' ELSE 'accepted' END AS reason FROM c)
SELECT doc_id, reason, count(*) AS n_lines FROM r GROUP BY ALL""")
def formula_rejections(spark, d):
    """How many lines of each document are formulas, and why the others aren't."""
    got = formulas.judged_lines(lines.lines(_docs(spark, d)).select("doc_id", X.ascii_fold(F.col("line")).alias("line")))
    return got.groupBy("doc_id", F.coalesce("rejection", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_lines"))
