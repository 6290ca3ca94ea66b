"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from . import bloom_langid, decontam, jump_shards, license_scan, parity_join, piece_codec, pq_neardup, prefix_trie, secret_forest, string_kernel, suffix_dedup, text_density, token_alignment
from .common import table
from .license_texts import TEMPLATES

QUERIES = {
    "op1_toxicity": lambda s, d: string_kernel.document_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op2_embedding_neardup": lambda s, d: pq_neardup.near_duplicates(table(s, d, "embeddings")),
    "op3_language_id": lambda s, d: bloom_langid.document_languages(table(s, d, "documents")),
    "op4_jump_shards": lambda s, d: jump_shards.document_shards(table(s, d, "documents")),
    "op5_license_scan": lambda s, d: license_scan.document_licenses(table(s, d, "documents")),
    "op6_benchmark_leaks": lambda s, d: decontam.contamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op7_suffix_dedup": lambda s, d: suffix_dedup.deduplicated(table(s, d, "documents")),
    "op8_jaccard_join": lambda s, d: parity_join.similar_groups(table(s, d, "documents"), 3, Fraction(9, 10)),
    "op9_secret_scan": lambda s, d: secret_forest.document_secrets(table(s, d, "documents")),
    "op10_piece_codec": lambda s, d: piece_codec.document_tokens(table(s, d, "documents")),
    "op11_text_density": lambda s, d: text_density.page_texts(table(s, d, "pages")),
    "op12_token_alignment": lambda s, d: token_alignment.document_alignment(table(s, d, "documents")),
    "op13_prefix_trie": lambda s, d: prefix_trie.conversation_trie(table(s, d, "conversations")),
}

ORACLES: dict[str, str] = {}

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

ORACLES["op6_benchmark_leaks"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS len, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len FROM wins),
places AS (SELECT doc_id, lens.len, i, array_to_string(w[i : i + lens.len - 1], ' ') AS win FROM docs, lens, LATERAL (SELECT unnest(range(1, len(w) - lens.len + 2)) AS i) WHERE len(w) >= lens.len),
found AS (SELECT doc_id, item_id, i, places.len FROM places JOIN wins ON places.win = wins.win AND places.len = wins.len),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM found) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY 1)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM docs, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a)
SELECT docs.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = docs.doc_id) AS component_id FROM docs LEFT JOIN n USING (doc_id)"""

ORACLES["op2_embedding_neardup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id, (SELECT min(b) FROM reach WHERE a = vec_id) = vec_id AS kept FROM embeddings"""

_TEMPLATES = ", ".join(f"({k}, '{name}', '" + text.replace("'", "''") + "')" for k, (name, text) in enumerate(TEMPLATES))

ORACLES["op5_license_scan"] = f"""
WITH t AS (SELECT k, name, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(k, name, text)), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ts AS (SELECT k, name, greatest(1, len(w) - 4) AS n, array_to_string(w[i : i + 4], ' ') AS s FROM t, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i)), tn AS (SELECT k, name, n, count(DISTINCT s) AS size FROM ts GROUP BY ALL),
ds AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i) WHERE len(w) > 0),
hits AS (SELECT DISTINCT doc_id, k, i, s FROM ds JOIN (SELECT DISTINCT k, s FROM ts) USING (s)),
wins AS (SELECT a.doc_id, a.k, a.i, count(DISTINCT b.s) AS c FROM hits a JOIN tn USING (k) JOIN hits b ON b.doc_id = a.doc_id AND b.k = a.k AND b.i >= a.i AND b.i < a.i + tn.n GROUP BY ALL),
found AS (SELECT doc_id, name, max(c)::DOUBLE / any_value(size) AS share FROM wins JOIN tn USING (k) GROUP BY doc_id, k, name HAVING max(c)::DOUBLE / any_value(size) >= 0.8)
SELECT d.doc_id, count(f.name) AS n_matches, coalesce(string_agg(DISTINCT f.name, ',' ORDER BY f.name), '') AS licenses, coalesce(max(share), 0) AS best FROM d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id"""

# the given pages mark their article as such, without markup inside its blocks but b and br
ORACLES["op11_text_density"] = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10)))::BIGINT AS n_chars FROM b"""

# crc32 bit by bit; a node is the list of its turns
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, ({_CRC} % 9)::BIGINT AS h FROM t),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own[1 : h.h], []), h.own[h.h + 1 :]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, turns[1 : d] AS k, d = len(turns) AS ended FROM c, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM p GROUP BY k, d),
kids AS (SELECT k[1 : depth - 1] AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(kids.n, 0) AS n_children, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(n.k[depth].t) ELSE 0 END AS saved FROM n LEFT JOIN kids USING (k)),
s AS (SELECT k[1 : d] AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM w, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) GROUP BY 1)
SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s USING (k) LEFT JOIN n up ON w.depth > 0 AND up.k = w.k[1 : w.depth - 1]"""
