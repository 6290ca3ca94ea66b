"""Secret scans: candidate strings are found by shape, and a random forest removes the false positives.

The forest sees a candidate's length and character kinds, how usual its letter transitions are, how much of it is
dictionary words, the path and the words around it. Dictionary and transitions are counted over all documents. The
labelled findings are made, since no table has any: secrets and look-alikes of known kinds are drawn and put into windows of
a sample of the documents, so a label is known by construction and isn't derived from what the forest is given.
"""

from __future__ import annotations

import random
import re
import string
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .hashing import batches

#: Words of credentials, words of examples, of identifiers that aren't secret, and the shapes of well-known keys.
CREDENTIALS = r"secret|token|passw(?:or)?d|passphrase|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth|credential|bearer"
CREDENTIAL = re.compile(rf"(?i)({CREDENTIALS})")
EXAMPLE = re.compile(r"(?i)(example|sample|dummy|placeholder|changeme|your[_\-]|test|mock|fixture|spec)")
IDENTIFIER = re.compile(r"(?i)(commit|checksum|sha-?\d*|md5|digest|uuid|revision|version|etag|build|hash|isbn|serial|order|ticket|phone|tel|card)")
KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|AIza[0-9A-Za-z_\-]{35}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9_\-]{20,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*|-----BEGIN [A-Z ]*PRIVATE KEY-----.*)$", re.S)
#: Candidates: key blocks, values given to a credential's name, and runs of characters of keys.
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s\\]{16,}?-----END [A-Z ]{0,30}PRIVATE KEY-----")
GIVEN = re.compile(rf"(?i)(?:{CREDENTIALS})[\w\-.]{{0,24}}[\"']?\s{{0,3}}(?::=|=>|[=:])\s{{0,3}}[\"'`]?([^\s\"'`<>;,]{{8,}})")
SHAPE = re.compile(r"[A-Za-z0-9_\-+/=.@:~%$#]{8,}")
INSIDE = re.compile(r"^([A-Za-z][\w\-.]{1,40}?)[=:](?=[^=/])")
NAME = re.compile(r"([A-Za-z][\w\-.]{0,40})[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}[\"'`]?$")
WORD, CHUNK = re.compile(r"[A-Za-z]{3,}"), re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Words of prose: lower-case letters between white space, a mark may follow.
PROSE = r"(?<![^\s])([a-z]{3,24})(?=[.,;:!?]?(?:\s|$))"
FEATURES = ("length", "digits", "uppers", "symbols", "switches", "distinct", "entropy", "hex", "digits only", "covered", "transitions", "vowels", "known", "named", "credential near", "identifier near", "example", "example path", "literal", "address", "call")
LETTERS = {c: k for k, c in enumerate(string.ascii_lowercase)}


@dataclass
class Lexicon:
    """Bits of the dictionary's words, and the logarithms of how often one letter follows another in them."""

    bits: np.ndarray
    logs: np.ndarray

    def has(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        n = len(self.bits) * 64 - 1
        return all(int(self.bits[at >> 6]) >> (at & 63) & 1 for at in (h & n, h >> 32 & n))

    def usual(self, value: str) -> float:
        """Mean logarithm of the transitions between neighbouring letters; -3 where there are none."""
        low = value.lower()
        got = [self.logs[LETTERS[a], LETTERS[b]] for a, b in zip(low, low[1:], strict=False) if a in LETTERS and b in LETTERS]
        return float(np.mean(got)) if got else -3.0


@dataclass
class Finding:
    start: int
    end: int
    value: str
    features: list[float]


@dataclass
class Model:
    forest: Forest
    lexicon: Lexicon


def lexicon(documents: DataFrame, share: float = 1e-5) -> Lexicon:
    """The words that stand in at least two documents and in the part share of all; at most (words a document) / share of them.

    Its bits are put together in tasks, 16 for each word; the driver gets the bits and at most 26 x 26 counts.
    """
    total = documents.count()
    each = documents.select(F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(PROSE)))).alias("w")).where("w is not null")
    words = staged(each.groupBy("w").count().where(F.col("count") >= max(2, share * total)).select("w", F.xxhash64("w").alias("h")), "secret-words")
    n = 1 << max(10, (16 * words.count()).bit_length())
    places = words.select(F.explode(F.array(F.col("h").bitwiseAND(n - 1), F.shiftrightunsigned("h", 32).bitwiseAND(n - 1))).alias("at"))
    bits = np.zeros(n // 64, np.uint64)
    got = places.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toPandas()
    bits[got["k"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    pairs = words.select(F.explode_outer(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p")).groupBy("p").count().collect()
    counts = np.ones((26, 26))
    for p, c in pairs:
        if p:
            counts[LETTERS[p[0]], LETTERS[p[1]]] += c
    return Lexicon(bits, np.log(counts / counts.sum(1, keepdims=True)))


def findings(text: str | None, path: str | None, lex: Lexicon) -> list[Finding]:
    """The candidates of a whole text with their features; offsets are in characters of the text.

    Blocks and values given to a credential's name come first; a run of characters is one of its own where it meets
    none of them, has a known shape, or 12 characters and a digit.
    """
    text, spans = text or "", []
    for m in BLOCK.finditer(text):
        spans.append((m.start(), m.end(), ""))
    if CREDENTIAL.search(text):
        for m in GIVEN.finditer(text):
            value = m.group(1).rstrip(".:)]}")
            if len(value) >= 8 and not any(s < m.end(1) and m.start(1) < e for s, e, _ in spans):
                spans.append((m.start(1), m.start(1) + len(value), m.group(0)[: m.start(1) - m.start()]))
    taken = sorted(spans)
    at = 0
    for m in SHAPE.finditer(text):
        start, value, name = m.start(), m.group(), ""
        if inner := INSIDE.match(value):
            name, start, value = inner[1], start + inner.end(), value[inner.end() :]
        value = value.rstrip(".:=") if not re.search(r"[A-Za-z0-9]==?$", value) else value.rstrip(".:")
        if not (len(value) >= 12 and any(c.isdigit() for c in value) or KNOWN.match(value)):
            continue
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < start + len(value):
            continue
        if not name and (front := NAME.search(text[max(0, start - 50) : start])):
            name = front[1]
        spans.append((start, start + len(value), name))
    return [Finding(s, e, text[s:e], _features(text, s, e, name, path or "", lex)) for s, e, name in sorted(spans)]


def _features(text: str, start: int, end: int, name: str, path: str, lex: Lexicon) -> list[float]:
    value = text[start:end]
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    counts = np.unique(list(value), return_counts=True)[1] / n
    chunks = [c for c in CHUNK.findall(value) if len(c) >= 3]
    covered = sum(len(c) for c in chunks if lex.has(c.lower()))
    letters = [c for c in value.lower() if c in LETTERS]
    around = text[max(0, start - 60) : start] + " " + text[end : end + 40]
    return [
        min(n, 200), kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        len(counts) / n, float(-(counts * np.log2(counts)).sum()), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(re.fullmatch(r"[\d.\-:/+]+", value))), covered / n,
        lex.usual(value), sum(c in "aeiouy" for c in letters) / max(1, len(letters)), float(bool(KNOWN.match(value))), float(bool(CREDENTIAL.search(name))), float(bool(CREDENTIAL.search(around))), float(bool(IDENTIFIER.search(around))),
        float(bool(EXAMPLE.search(around) or EXAMPLE.search(value))), float(bool(EXAMPLE.search(path))), float(start > 0 and text[start - 1] in "=\"'`"), float("@" in value or "//" in value or "/" in value[1:] and "." in value), float(text[end : end + 1] == "(" or value.endswith("(") or "()" in value),
    ]


class Forest:
    """Random forest of probability trees on bootstrap samples; a few features are tried at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows].astype(float), depth, rng))

    def _grow(self, x, y, depth, rng):
        p = float(y.mean())
        if depth == 0 or len(y) < 4 or p in (0.0, 1.0):
            return p
        best = None
        for f in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]) + 1)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                left = s[cut] / (cut + 1)
                right = (s[-1] - s[cut]) / (len(y) - cut - 1)
                loss = (cut + 1) * left * (1 - left) + (len(y) - cut - 1) * right * (1 - right)
                k = loss.argmin()
                if best is None or loss[k] < best[0]:
                    low, high = v[cut[k]], v[cut[k] + 1]
                    middle = low + (high - low) / 2
                    best = (loss[k], f, middle if middle < high else low)  # between neighbouring doubles there is none
        if best is None:
            return p
        go = x[:, best[1]] <= best[2]
        return int(best[1]), float(best[2]), self._grow(x[go], y[go], depth - 1, rng), self._grow(x[~go], y[~go], depth - 1, rng)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))

        def walk(node, rows):
            if isinstance(node, float):
                total[rows] += node
            elif len(rows):
                go = x[rows, node[0]] <= node[1]
                walk(node[2], rows[go])
                walk(node[3], rows[~go])

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return total / len(self.trees)


def drawn(label: int, rnd: random.Random, words: list[str]) -> tuple[str, str]:
    """A labelled finding: a piece of text with {} for the value, and the value. words are some of the place it is put into.

    Secrets are random strings of the usual alphabets and lengths, mostly given to a name, and pass phrases that
    people make; look-alikes are check sums, identifiers, numbers, addresses, paths, code and words, some of them given to the
    names of credentials, and placeholders.
    """
    some = lambda chars, *sizes: "".join(rnd.choice(chars) for _ in range(rnd.choice(sizes)))
    alnum, hexa, lower, upper = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase
    name = rnd.choice(["token", "secret", "password", "passwd", "pwd", "api_key", "apiKey", "API-KEY", "access_key", "private_key", "auth_token", "client_secret", "db_password", "SECRET_KEY", "Bearer", "credentials"])
    plain = rnd.choice(["id", "name", "value", "key", "ref", "url", "file", "label", "n", "data", "path", "state"])
    given = rnd.choice(['%s = "{}"', "%s = '{}'", "%s={}", '%s: "{}"', '"%s": "{}"', "%s: {}", "%s := `{}`", "export %s={}"])
    word = lambda: rnd.choice(words) if words else some(lower, 4, 6, 8)
    if label:
        value = rnd.choice([
            lambda: some(hexa, 18, 24, 32, 40, 64), lambda: some(alnum, 12, 16, 20, 24, 32, 40), lambda: some(alnum + "+/", 40, 44) + rnd.choice(["", "="]), lambda: some(lower, 12, 16, 20), lambda: some(string.ascii_letters, 12, 16, 24), lambda: some(lower + string.digits, 10, 16, 24),
            lambda: some(lower, 3, 4) + some(string.digits, 1, 2) + some(string.ascii_letters, 3, 4) + some(string.digits + "!*&", 1, 2), lambda: some(lower, 8, 9, 10), lambda: some(alnum + "!#$%&*?", 10, 14, 18), lambda: word().capitalize() + some(string.digits + "!*", 4, 5) + some(lower, 2, 3),
        ])()
        known = rnd.choice([lambda: "AKIA" + some(upper + string.digits, 16), lambda: "ASIA" + some(upper, 16), lambda: "ghp_" + some(alnum, 36), lambda: "AIza" + some(alnum + "_-", 35), lambda: "xoxb-" + some(alnum, 24), lambda: "sk-" + some(alnum, 32, 48), lambda: f"eyJ{some(alnum, 20)}.{some(alnum, 40)}.{some(alnum + '_-', 43)}"])()
        block = f"-----BEGIN RSA PRIVATE KEY-----\n{some(alnum + '+/', 64, 200)}\n-----END RSA PRIVATE KEY-----"
        return rnd.choice([(given % name, value)] * 7 + [(rnd.choice(["{}", "key {} here", f"{plain}={{}}", "use {} for it"]), known)] * 3 + [("{}", block)])
    say = lambda: rnd.choice(["string", "required", "none", "optional", "undefined"]) + rnd.choice(["", "", " value"])
    code = lambda: rnd.choice(["get", "read", "make", "load"]) + word().capitalize() + rnd.choice(["()", "(request)", "Value()", ""])
    return rnd.choice([
        lambda: (rnd.choice(["commit {}", "checksum: {}", "sha1={}", "md5 {}", "revision {}", "etag: \"{}\"", "build {}"]), some(hexa, 32, 40, 40, 64)), lambda: (rnd.choice(["id={}", "uuid: {}", "{}", f'{plain} = "{{}}"']), str(uuid.UUID(int=rnd.getrandbits(128)))),
        lambda: (rnd.choice(["{}", "tel {}", "at {}", f"{plain}={{}}", "card {} ok"]), rnd.choice(["20%02d-%02d-%02dT%02d:00:00" % tuple(rnd.randrange(10, 28) for _ in range(4)), some(string.digits, 12, 13, 16), "+" + some(string.digits, 12), ".".join(some(string.digits, 1, 2, 3) for _ in range(5)), some(string.digits, 4) + "-" + some(string.digits, 4) + "-" + some(string.digits, 4)])),
        lambda: (rnd.choice(["{}", "see {}", 'href="{}"', f"{plain}: {{}}"]), rnd.choice([f"https://{word()}.example.org/{word()}/{some(string.digits, 3, 4)}", f"{word()}.{word()}{some(string.digits, 1, 2)}@{word()}.org", f"/usr/lib/{word()}-{some(string.digits, 1)}.{some(string.digits, 1)}/{word()}.so", f"{word()}-{some(string.digits, 1)}.{some(string.digits, 1, 2)}.{some(string.digits, 1)}.tar.gz"])),
        lambda: (rnd.choice(["{}", f"{plain} = {{}}"]), f"{word()}_{word()}_{some(string.digits, 1, 2, 4)}"), lambda: (rnd.choice([f"{name}: {{}}", f"{name} : {{}}", f"the {name}: {{}} of it"]), rnd.choice([word() + word()[:3], say().replace(" ", ""), "required", "as" + word()])),
        lambda: (f"{name} = {{}}", code()), lambda: (given % name, rnd.choice(["YOUR_API_KEY", "your-token-here", "changeme123", "xxxxxxxxxxxx", "<placeholder1>", "example-secret-1", "dummy_password1", "${SECRET_NAME}", "********", "test-token-0001"])),
        lambda: (f'{rnd.choice(["token_count", "tokenizer", "secretary", "authors", "author_email", "password_hint"])} = "{{}}"', rnd.choice([some(string.digits, 8, 12), word() + "-" + word() + "-" + word(), word() + " " + word()])),
    ])()


def labelled(windows: list[tuple[str, str | None]], lex: Lexicon, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of drawn findings, one of each label in each window (text, path) of the documents."""
    rnd, x, y = random.Random(seed), [], []
    for text, path in windows:
        words = [w for w in WORD.findall(text) if w.islower()]
        for label in (1, 0):
            frame, value = drawn(label, rnd, words)
            cut = rnd.randrange(len(text) + 1)
            front = text[:cut] + rnd.choice([" ", "\n", "\n    "]) + frame[: frame.index("{}")]
            where = rnd.choice([path] * 6 + ["src/config.py", ".env", "docs/guide.md"] + ["tests/fixtures/keys.txt"] * (1 if label else 3))
            whole = front + value + frame[frame.index("{}") + 2 :] + rnd.choice([" ", "\n"]) + text[cut:]
            got = [f for f in findings(whole, where, lex) if f.start < len(front) + len(value) and f.end > len(front)]
            for f in got[:1]:
                x.append(f.features)
                y.append(label)
    return np.array(x), np.array(y)


def train(documents: DataFrame, sample: int = 3000, window: int = 400) -> Model:
    """The lexicon of all documents(text, source), and a forest taught by findings put into windows of at most sample of them, chosen by hash.

    The windows, of at most so many characters, are all that the driver gets of texts. Without documents the findings stand alone.
    """
    lex, total = lexicon(documents), documents.count()
    h = F.xxhash64("text", F.lit("window"))
    near = documents.where(F.col("text").isNotNull()).withColumn("_h", h).where(F.pmod("_h", F.lit(1 << 30)) <= int(min(1, (4 * sample + 100) / max(1, total)) * (1 << 30)))
    at = F.pmod("_h", F.greatest(F.lit(1), F.length("text") - window)).cast("int") + 1
    some = near.select("_h", F.substring(F.col("text"), at, F.lit(window)).alias("t"), F.col("source").cast("string").alias("s")).orderBy("_h", "t", "s").limit(sample).collect()
    windows = [(r["t"], r["s"]) for r in some]
    windows += [("", None)] * max(0, min(sample, 1000) - len(windows))
    return Model(Forest(*labelled(windows, lex)), lex)


def judged(found: list[Finding], model: Model) -> np.ndarray:
    """Probability that each finding is a secret."""
    return model.forest.probability(np.array([f.features for f in found])) if found else np.zeros(0)


def scan(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """documents with columns text and source, plus n_candidates, secrets (start, end, score of those kept) and redacted: the text with each secret as [SECRET].

    Columns of those names are replaced. Null and empty texts have no candidates, null stays null; repeated rows are
    judged alike; a tie with least is a secret; other columns, nulls in them too, stay.
    """
    added = [T.StructField("n_candidates", T.LongType()), T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))), T.StructField("redacted", T.StringType())]
    kept = documents.select(*[c for c in documents.columns if c not in [f.name for f in added]])
    names, shared = kept.columns, documents.sparkSession.sparkContext.broadcast(model)
    text_at, path_at = names.index("text"), names.index("source")

    def of(it):
        for b in batches(it):
            texts, paths = b.column(text_at).to_pylist(), b.column(path_at).to_pylist()
            each = [findings(t, None if p is None else str(p), shared.value.lexicon) for t, p in zip(texts, paths, strict=True)]
            score = judged([f for fs in each for f in fs], shared.value)
            counts, spans, clean, at = [], [], [], 0
            for t, fs in zip(texts, each, strict=True):
                own = [(f, float(s)) for f, s in zip(fs, score[at : at + len(fs)], strict=True) if s >= least]
                at += len(fs)
                counts.append(len(fs))
                spans.append([{"start": f.start, "end": f.end, "score": s} for f, s in own])
                for f, _ in reversed(own):
                    t = f"{t[: f.start]}[SECRET]{t[f.end :]}"
                clean.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))), pa.array(clean, pa.string())], [*names, *[f.name for f in added]])

    return kept.mapInArrow(of, T.StructType([*kept.schema.fields, *added]))


def document_secrets(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_candidates, n_secrets, max_score (0 without secrets), spans_sha256 of the secrets' start-end pairs.

    Null and empty texts have no candidates; each row is judged by itself, repeated ones and those without a doc_id too.
    """
    found = scan(documents.select("doc_id", "text", "source"), train(documents))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.coalesce(F.array_max(F.transform("secrets", lambda s: s["score"])), F.lit(0.0)).alias("max_score"), F.sha2(spans.cast("binary"), 256).alias("spans_sha256"))
