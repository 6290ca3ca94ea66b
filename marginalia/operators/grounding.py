"""Grounding of generated items in the source documents, and terms and phrases that the source doesn't have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Synonyms folded before a second look, in order.
SYNONYMS = [
    (r"\bimportance\s+sampler\s+importance\s+sampling\b", "is"), (r"\bself[-\s]?normali[sz]ed\s+importance\s+sampling(\s+estimator)?\b", "snis"), (r"\bnormali[sz]ed\s+importance\s+sampling(\s+estimator)?\b", "snis"), (r"\bimportance\s+sampling\s+estimator\b", "isest"), (r"\bimportance\s+sampler\b", "isampler"),
    (r"\bimportance\s+sampling\b", "is"), (r"\bself[-\s]?normali[sz]ed\b", "snis"), (r"\bmonte\s+carlo\b", "mc"), (r"\bnormali[sz]ed\b", "normalised"), (r"\bvariance\b", "var"), (r"\bexpectation\b", "e"), (r"\bprobability\b", "p"), (r"\bparametri[sz]ations?\b", "parametrization"), (r"\bparameteri[sz]ations?\b", "parametrization"),
    (r"\bnormali[sz]ations?\b", "normalization"), (r"\bstate\s*-?\s*space\s+models?\b", "statespacemodel"), (r"\bstatespacemodels?\b", "statespacemodel"), (r"\bhidden\s+markov\s+models?\b", "hmm"), (r"\bpseudo[-\s]?code\b", "pseudocode"),
]


def folded(c: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), SYNONYMS, X.collapse(F.lower(c)))


def _runs(n: int) -> Column:
    """Hashes of the runs of n words of column words; a column, since in a lambda an expression is computed for each element."""
    one = lambda i: F.xxhash64(F.slice("words", i, n))
    return F.when(F.size("words") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), one)))


def grounded(items: DataFrame, documents: DataFrame, prefix: int = 120, least: int = 10, run: int = 6, fold: bool = False, block: int = 1000) -> DataFrame:
    """item_id, doc_id where the first prefix characters of the item, collapsed and in lower case, are in the document.

    The inner words of the prefix (its first and last may be cut) name one run of words whose hash is joined with the
    documents' runs; shorter prefixes are joined by one inner word; then the text decides. Prefixes of two words or
    less have no whole word: they meet all documents in blocks of so many. With fold, synonyms are folded on both sides.
    """
    shape = folded if fold else lambda c: X.collapse(F.lower(c))
    e = shape(X.sanitise(F.col("text")))
    asked = items.select("item_id", F.substring(e, 1, prefix).alias("p")).where(F.length("p") >= least).withColumn("_w", F.split("p", " "))
    docs = documents.select("doc_id", shape(F.col("text")).alias("s"))
    worded = docs.select("doc_id", F.split("s", " ").alias("words"))
    long_ = asked.where(F.size("_w") >= run + 2).select("item_id", "p", F.xxhash64(F.slice("_w", 2, run)).alias("h"))
    by_run = worded.select("doc_id", F.explode_outer(_runs(run)).alias("h")).join(long_, "h").select("item_id", "p", "doc_id")
    inner = asked.where(F.size("_w").between(3, run + 1)).select("item_id", "p", F.array_max(F.transform(F.slice("_w", F.lit(2), F.size("_w") - 2), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("w"))
    by_word = worded.select("doc_id", F.explode_outer(F.array_distinct("words")).alias("w")).join(inner, "w").select("item_id", "p", "doc_id")
    found = by_run.unionByName(by_word).join(docs, "doc_id").where(F.contains("s", "p")).select("item_id", "doc_id")
    few = asked.where(F.size("_w") <= 2).select("item_id", "p")
    blocks = -(-few.count() // block)
    for k in range(blocks):
        own = few.where(F.pmod(F.xxhash64("item_id", "p"), F.lit(blocks)) == k)  # about block strings of at most prefix characters
        found = found.unionByName(docs.join(F.broadcast(own), F.contains(F.col("s"), F.col("p"))).select("item_id", "doc_id"))
    return found


def grounded_twice(items: DataFrame, documents: DataFrame, **how) -> DataFrame:
    """grounded, and for items without a document once more after folding synonyms; folded tells which."""
    plain = grounded(items, documents, **how).withColumn("folded", F.lit(False))
    rest = items.join(plain.select("item_id").distinct(), "item_id", "left_anti")
    return plain.unionByName(grounded(rest, documents, fold=True, **how).withColumn("folded", F.lit(True)))


def absent_terms(items: DataFrame, documents: DataFrame, letters: int = 14) -> DataFrame:
    """item_id, term: words of at least so many letters that are in no document, not even inside another word.

    A term stands inside a longer word only where its first letters do: the words' runs of letters characters are joined
    with these, then the whole term decides.
    """
    long_words = lambda df, key: df.select(*key, F.explode_outer(F.regexp_extract_all(X.ascii_fold(F.lower("text")), F.lit(rf"\b([a-z]{{{letters},}})\b"))).alias("term")).where("term is not null").distinct()
    asked = long_words(items, ["item_id"])
    runs = documents.select(F.explode_outer(F.regexp_extract_all(X.ascii_fold(F.lower("text")), F.lit(rf"([a-z]{{{letters},}})"))).alias("v")).where("v is not null").distinct()
    grams = runs.select("v", F.explode_outer(F.transform(F.sequence(F.lit(1), F.length("v") - letters + 1), lambda i: F.substring(F.col("v"), i, F.lit(letters)))).alias("g"))
    terms = asked.select("term").distinct().select("term", F.substring("term", 1, letters).alias("g"))
    inside = terms.join(grams, "g").where(F.contains("v", "term")).select("term").distinct()
    return asked.join(inside, "term", "left_anti").select("item_id", "term")


def truly_absent(absent: DataFrame, documents: DataFrame, letters: int = 14) -> DataFrame:
    """absent(item_id, term) without terms that a document has in the other spelling (-isation, -ization) or with hyphens inside."""
    flip = F.when(F.contains("term", F.lit("isation")), F.replace("term", F.lit("isation"), F.lit("ization"))).when(F.contains("term", F.lit("ization")), F.replace("term", F.lit("ization"), F.lit("isation")))
    flipped = absent.withColumn("f", flip).where("f is not null").select("item_id", "term", F.col("f").alias("text"))
    as_items = flipped.select(F.struct("item_id", "term").alias("item_id"), "text")
    other = absent_terms(as_items, documents, letters).select("item_id.item_id", "item_id.term")
    spelt = flipped.select("item_id", "term").join(other, ["item_id", "term"], "left_anti")
    joined = documents.select(F.replace("text", F.lit("-"), F.lit("")).alias("text"))
    whole = absent.select(F.struct("item_id", "term").alias("item_id"), F.col("term").alias("text"))
    hyphened = absent.join(absent_terms(whole, joined, letters).select("item_id.item_id", "item_id.term"), ["item_id", "term"], "left_anti")
    return absent.join(spelt.unionByName(hyphened).distinct(), ["item_id", "term"], "left_anti")


def stale(absent: DataFrame, most: int = 6, shown: int = 12) -> DataFrame:
    """item_id, terms (the first shown by name), stale: at least most absent terms."""
    by = absent.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("t"))
    return by.select("item_id", F.slice("t", 1, shown).alias("terms"), (F.size("t") >= most).alias("stale"))


def ungrounded_phrases(items: DataFrame, documents: DataFrame, letters: int = 6, share: float = 0.75) -> DataFrame:
    """item_id, phrase, grounded: runs of four long words that no document has and of whose words less than share are in one."""
    word = f"[a-z]{{{letters},}}"
    pattern = rf"\b({word} {word} {word} {word})\b"
    found = lambda df, *k: df.select(*k, F.explode_outer(F.regexp_extract_all(X.collapse(X.ascii_fold(F.lower("text"))), F.lit(pattern))).alias("phrase")).where("phrase is not null").distinct()
    docs = documents.select(X.collapse(X.ascii_fold(F.lower("text"))).alias("s"))
    four = docs.select(F.split("s", " ").alias("words")).select(F.explode_outer(_phrases()).alias("phrase")).where(F.col("phrase").rlike(f"^{word} {word} {word} {word}$")).distinct()
    asked = found(items, "item_id").join(four, "phrase", "left_anti")
    vocabulary = docs.select(F.explode_outer(F.regexp_extract_all("s", F.lit(rf"\b({word})\b"))).alias("w")).where("w is not null").distinct()
    words = asked.select("item_id", "phrase", F.explode_outer(F.split("phrase", " ")).alias("w")).join(vocabulary.withColumn("ok", F.lit(1)), "w", "left")
    return words.groupBy("item_id", "phrase").agg(F.avg(F.coalesce("ok", F.lit(0))).alias("grounded")).where(F.col("grounded") < share)


def _phrases() -> Column:
    """The runs of four words of column words, without marks at their ends."""
    clean = lambda i, k: F.regexp_replace(F.get("words", i + k), "^[^a-z0-9]+" if k == 0 else "[^a-z0-9]+$", "") if k in (0, 3) else F.get("words", i + k)
    return F.when(F.size("words") >= 4, F.transform(F.sequence(F.lit(0), F.size("words") - 4), lambda i: F.concat_ws(" ", *[clean(i, k) for k in range(4)])))


def math_quality(c: Column) -> tuple[Column, Column]:
    """Issues of a formula (array) and its status: ok, needs_check or broken."""
    issues = F.array_compact(F.array(
        F.when(X.count_of(c, r"\{") != X.count_of(c, r"\}"), "unbalanced braces"),
        F.when(X.count_of(c, r"\$") % 2 != 0, "unbalanced dollars"),
        F.when(X.count_of(c, r"\\left") != X.count_of(c, r"\\right"), "unbalanced left and right"),
        F.when(c.rlike(r"\{\s*\}"), "empty group"),
        F.when(c.rlike(r"\.{6,}"), "leader dots"),
        F.when(~c.contains("$") & c.rlike(r"\\[a-zA-Z]+"), "bare command"),
    ))
    broken = F.exists(issues, lambda i: i.startswith("unbalanced"))
    return issues, F.when(broken, "broken").when(F.size(issues) > 0, "needs_check").otherwise("ok")


#: What extraction leaves of mathematics, by the issue it makes.
TOKENS = [
    ("raw phi", r"[ϕ](?![a-z])"), ("missing glyph", "\\[missing glyphs\\]|\u25a1|\ufffd"), ("control character", "[\x01\x02\x03]"), ("bibliography", r"(?i)\bBIBLIOGRAPHY\b"), ("broken notation", r"(?i)\?\[|∑N\s+1\s+N|varp\?"), ("raw Xt1", r"\bXt1\b|\bXtn\b"), ("raw X1", r"\bX1\b|\bXn\b"), ("raw R d", r"\bR\s+[dn]\b"), ("raw Sigma", r"\bSigma\b"), ("raw rho", r"\brho\b|\bgamma\b"),
    ("raw sum", r"\bPn\s*i\s*=\s*1\b|\bsum_i\b"), ("artefact", "\ufffe"), ("raw Xt", r"\bXt\b|\bXt\+|\bXt↑1"), ("symbols", r"\bsω\b|\bϑ\b|\bς\b|\bϖ\b|\bϱ\b|↑|↓|↖"), ("hyphenation", r"(?i)dis-\s*"),
]


def math_tokens(c: Column) -> tuple[Column, Column]:
    """Issues of a text with mathematics (array) and its quality: low from three issues on or without any text, medium with one, else high."""
    issues = F.array_compact(F.array(*[F.when(c.rlike(p), n) for n, p in TOKENS], F.when(X.count_of(c, r"\\\(") != X.count_of(c, r"\\\)"), "delimiters")))
    return issues, F.when(F.coalesce(F.trim(c), F.lit("")) == "", "low").when(F.size(issues) >= 3, "low").when(F.size(issues) > 0, "medium").otherwise("high")


def math_audit(texts: DataFrame, text: str = "text") -> DataFrame:
    """issue, texts: how many texts have each issue, of math_quality and math_tokens."""
    both = texts.select(F.explode_outer(F.array_distinct(F.concat(math_quality(F.col(text))[0], math_tokens(F.col(text))[0]))).alias("issue"))
    return both.where("issue is not null").groupBy("issue").agg(F.count("*").alias("texts"))
