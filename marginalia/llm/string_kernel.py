"""Toxicity by a subsequence string kernel and a support vector machine on Nystrom landmarks.

Words are compared by their common subsequences of three characters, gaps inside which cost DECAY for each
character, so an insult with characters inserted, dropped or spaced out stays near the plain one. Kernel values to
landmark words are whitened (Nystrom) and a linear SVM is trained on them. A document is as toxic as its most toxic
word. Which words of a labelled document carry its label is learnt in rounds, as in multiple-instance SVMs.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .hashing import batches, mix, prefix_sums, span_hashes

DECAY, SPAN = 0.35, 6
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
SPACE, HEAD, TAIL = 255, 61, 62
#: Look-alike characters.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "ß": "s"}


@cache
def fold_table() -> np.ndarray:
    """Code of each BMP character: 1-26 for letters without accents or look-alikes, others up to 60; 0 is left out."""
    out = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        base = ALIKE.get(c) or unicodedata.normalize("NFKD", c.lower())[:1]
        if c.isspace():
            out[i] = SPACE
        elif "a" <= base <= "z":
            out[i] = ord(base) - 96
        elif c.isalnum():
            out[i] = 27 + i % 34
    for c in "!@$":  # mostly punctuation: only inside a word, see fold()
        out[ord(c)] = 0
    return out


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts' words, head and tail marks included, where words begin (n + 1), and the text of each word.

    Marks between letters are dropped, and neighbouring words of one letter are joined: i.d.i.o.t, i d i o t.
    """
    low = [(t or "") + "\n" for t in texts]
    wide = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    table = fold_table()
    code = np.where(wide < 0x10000, table[np.minimum(wide, 0xFFFF)], 27 + wide % 34).astype(np.uint8)
    inner = np.zeros(len(code), bool)
    inner[1:-1] = (table[np.minimum(wide[:-2], 0xFFFF)] - np.uint8(1) < 60) & (table[np.minimum(wide[2:], 0xFFFF)] - np.uint8(1) < 60)
    for c, to in (("!", 9), ("@", 1), ("$", 19)):
        code[inner & (wide == ord(c))] = to
    keep = code > 0
    code, owner = code[keep], owner[keep]
    is_space = code == SPACE
    alone = np.zeros(len(code), bool)
    if len(code) > 2:
        alone[1:-1] = ~is_space[1:-1] & is_space[:-2] & is_space[2:]
        alone[0] = ~is_space[0] & is_space[1]
        between = np.zeros(len(code), bool)
        between[1:-1] = is_space[1:-1] & alone[:-2] & alone[2:] & (owner[:-2] == owner[2:])
        code, owner, is_space = code[~between], owner[~between], is_space[~between]
    first = np.flatnonzero(~is_space & np.concatenate(([True], is_space[:-1])))
    last = np.flatnonzero(is_space & np.concatenate(([False], ~is_space[:-1])))
    n = last - first
    begin = np.concatenate(([0], np.cumsum(n + 2)))
    out = np.empty(begin[-1], np.uint8)
    out[begin[:-1]], out[begin[1:] - 1] = HEAD, TAIL
    body = np.ones(len(out), bool)
    body[begin[:-1]] = body[begin[1:] - 1] = False
    out[body] = code[~is_space]
    return out, begin, owner[first]


def unique_words(code: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and bounds of the distinct words, and which one each word is."""
    h = span_hashes(prefix_sums(code), begin[:-1], begin[1:])
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    n = begin[index + 1] - begin[index]
    to = np.concatenate(([0], np.cumsum(n)))
    return code[np.repeat(begin[index] - to[:-1], n) + np.arange(to[-1])], to, inverse


def subsequences(code: np.ndarray, begin: np.ndarray):
    """For each gap pattern: number of the word, key of the three characters, weight."""
    word = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    c = code.astype(np.int32)
    for a, b in GAPS:
        if len(c) > b:
            at = np.flatnonzero(word[:-b] == word[b:])
            yield word[at], c[at] << 12 | c[at + a] << 6 | c[at + b], DECAY ** (b - 2)


def norms(code: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The root of each word's kernel value with itself: a subsequence that it has several times counts with the sum of its weights."""
    out = np.zeros(len(begin) - 1)
    for lo in range(0, len(out), 10_000):
        hi = min(lo + 10_000, len(out))
        parts = list(subsequences(code[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo]))
        if parts:
            at = np.concatenate([word.astype(np.int64) << 18 | key for word, key, _ in parts])
            weight = np.repeat([w for *_, w in parts], [len(word) for word, *_ in parts])
            order = np.argsort(at)
            at, weight = at[order], weight[order]
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            if len(heads):
                out[lo:hi] = np.bincount(at[heads] >> 18, np.add.reduceat(weight, heads) ** 2, hi - lo)
    return np.sqrt(np.maximum(out, 1e-9))


@dataclass
class Model:
    weight: np.ndarray  # of each subsequence of three, from the landmarks
    bias: float
    slope: float  # of the logistic curve over margins
    shift: float

    def margins(self, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        total = np.zeros(len(begin) - 1)
        for lo in range(0, len(total), 50_000):
            hi = min(lo + 50_000, len(total))
            for word, key, w in subsequences(code[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo]):
                total[lo:hi] += np.bincount(word, self.weight[key] * w, hi - lo)
        return total / norms(code, begin) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _kernel(code, begin, columns: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Kernel values of words to the landmarks: basis has a row for each landmark, a column for each key in columns."""
    out = np.zeros((len(begin) - 1, len(basis)), np.float32)
    by_key = np.ascontiguousarray(basis.T)
    for lo in range(0, len(begin) - 1, 1000):
        hi = min(lo + 1000, len(begin) - 1)
        for word, key, w in subsequences(code[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo]):
            at = np.searchsorted(columns, key).clip(max=len(columns) - 1)
            ok = columns[at] == key
            word, at = word[ok], at[ok]
            if len(word):
                heads = np.flatnonzero(np.diff(word, prepend=-1))
                out[lo + word[heads]] += np.add.reduceat(by_key[at] * np.float32(w), heads)
    return out / norms(code, begin).astype(np.float32)[:, None]


def _pick(code, begin, rows):
    n = np.diff(begin)[rows]
    to = np.concatenate(([0], np.cumsum(n)))
    return code[np.repeat(begin[:-1][rows] - to[:-1], n) + np.arange(to[-1])], to


def _near_copies(owner: np.ndarray, word: np.ndarray, texts: int) -> np.ndarray:
    """Texts whose words are nearly those of an earlier one, by three bands of three least hashes: their words would count as often."""
    out = np.zeros(texts, bool)
    for band in range(3):
        key = np.zeros(texts, np.uint64)
        for k in range(3):
            least = np.full(texts, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, owner, mix(word.astype(np.uint64) + np.uint64(1_000_003 * (3 * band + k + 1))))
            key = mix(key + least)
        first = np.unique(key, return_index=True)[1]
        again = np.ones(texts, bool)
        again[first] = False
        out |= again
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by Newton steps over the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3  # the bias
    w = np.zeros(x.shape[1])
    inside = np.ones(len(x), bool)
    for _ in range(30):
        part = x[inside] * weight[inside, None]
        w = np.linalg.solve(ridge + 2 * c * part.T @ x[inside], 2 * c * part.T @ y[inside])
        new = y * (x @ w) < 1
        if (new == inside).all():
            break
        inside = new
    return w[:-1], w[-1]


def fit(texts: list[str | None], toxic: np.ndarray, landmarks: int = 500, negatives: int = 6000, rounds: int = 6) -> Model | None:
    """A model of labelled texts, or None where one of the labels is missing.

    The sample that is fitted is bounded: at most negatives words of toxic texts, those of most texts, and as many of
    clean ones, half drawn at random, the others those that the model before found worst.
    """
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return None
    check = np.arange(len(toxic)) % 4 == 3  # these set the border between the scores, the others the model
    if not all(part.any() and not part.all() for part in (toxic[check], toxic[~check])):
        check = np.zeros(len(toxic), bool)
    parts, sizes, pairs, words = [], [], [], 0
    for lo in range(0, len(texts), 200):  # distinct words of a few texts at a time
        raw, at, owner = fold(texts[lo : lo + 200])
        code, begin, word = unique_words(raw, at)
        pair = np.unique(owner.astype(np.int64) * len(begin) + word)
        pairs.append(np.stack((pair // len(begin) + lo, pair % len(begin) + words)))
        parts.append(code)
        sizes.append(np.diff(begin))
        words += len(begin) - 1
    owner, word = np.concatenate(pairs, 1)
    code, begin, same = unique_words(np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))
    word = same[word]
    words, bad, taught = len(begin) - 1, toxic[owner], ~check[owner] & ~_near_copies(owner, word, len(toxic))[owner]
    n_bad, n_fine = np.bincount(word[bad & taught], minlength=words), np.bincount(word[~bad & taught], minlength=words)
    rate = toxic.mean()
    usable = np.diff(begin) >= 5
    # words that stand in toxic texts more than chance explains: for each number of texts with a word and of clean ones
    # among these, how many words chance would bring there against how many there are
    n, share = n_bad + n_fine, max(rate, 0.02)
    cell = n.clip(max=400) * 8 + n_fine.clip(max=7)
    there = np.bincount(cell[usable], minlength=3208)
    any_ = np.bincount(n[usable].clip(max=400), minlength=401)
    size, clean = np.divmod(np.arange(3208), 8)
    log = np.cumsum(np.log(np.maximum(1, np.arange(402))))
    chance = any_[size] * np.exp(log[size] - log[clean] - log[np.maximum(0, size - clean)] + np.maximum(0, size - clean) * np.log(share) + clean * np.log1p(-share))
    good = (there > 0) & (chance <= 0.05 * there) & (clean < 7) & (clean <= 0.2 * size) & (size > 1)
    seed = usable & good[cell]
    if not seed.any():
        evidence = np.where(usable, n_bad * -np.log(share) - 3.0 * n_fine, -np.inf)
        seed = evidence >= np.sort(evidence)[-min(3, words)]
    rng = np.random.default_rng(7)
    fine = np.flatnonzero((n_fine > 0) & (np.diff(begin) > 2))
    base = rng.permutation(fine)[: negatives // 2]
    model, score, hard = None, np.where(seed, 1.0, -1.0), np.zeros(0, np.int64)
    for k in range(rounds):
        # positive words: those that chance doesn't explain, then those like them that no clean text has
        pos = np.flatnonzero(usable & (n_bad > 0) & (seed | ((score > 0.3) & (n_fine == 0) & (k > 1))))
        if not len(pos):
            break
        pos = pos[np.argsort(-n_bad[pos], kind="stable")][:negatives]
        if k:  # clean texts' words that the last model found worst
            hard = np.union1d(hard, fine[np.argsort(-score[fine], kind="stable")][: negatives // 4])
        hard = np.setdiff1d(hard, pos)
        neg = np.union1d(np.setdiff1d(base, pos), hard)
        worst = hard[np.argsort(-score[hard], kind="stable")][: landmarks // 3]
        marks = np.unique(np.concatenate((pos[: landmarks // 4], pos[:: max(1, len(pos) * 4 // landmarks)], worst, neg[rng.permutation(len(neg))][: landmarks // 3])))
        lc, lb = _pick(code, begin, marks)
        keys = np.unique(np.concatenate([key for _, key, _ in subsequences(lc, lb)]))
        basis = np.zeros((len(marks), len(keys)), np.float32)
        for wd, key, w in subsequences(lc, lb):
            np.add.at(basis, (wd, np.searchsorted(keys, key)), w)
        basis /= norms(lc, lb)[:, None]
        value, vector = np.linalg.eigh(_kernel(lc, lb, keys, basis))
        white = vector[:, value > 1e-3] / np.sqrt(value[value > 1e-3])
        rows = np.concatenate((pos, neg))
        y = np.where(np.arange(len(rows)) < len(pos), 1.0, -1.0)
        x = _kernel(*_pick(code, begin, rows), keys, basis) @ white
        w, bias = _svm(x, y, np.where(y > 0, n_bad[rows], n_fine[rows]).clip(5, 500) / 50)
        weight = np.zeros(1 << 18)
        weight[keys] = basis.T @ (white @ w)
        model = Model(weight, bias, 1.0, 0.0)
        score = model.margins(code, begin)
        score[~usable] = -9
    if model is None:
        return None
    top = np.full(len(toxic), -9.0)
    np.maximum.at(top, owner, score[word])
    if check.any():
        top, toxic = top[check], toxic[check]
    # the logistic curve has the clean texts' highest margins below one half: its middle is the border that costs least
    order = np.sort(top)
    cuts = (order[1:] + order[:-1]) / 2
    clean_above = (~toxic).sum() - np.searchsorted(np.sort(top[~toxic]), cuts, "right")
    wrong = 1.5 * clean_above + np.searchsorted(np.sort(top[toxic]), cuts, "right")  # a clean text above costs more than one missed
    best = cuts[wrong == wrong.min()]
    middle = float(np.median(best))
    model.slope = 6.0
    model.shift = -6.0 * middle + np.log(0.7 / 0.3)
    return model


def score_texts(df: DataFrame, model: Model | None) -> DataFrame:
    """df with score in [0, 1] of its whole column text (replaced if there). Texts without words, and all without a model, get 0."""
    kept = df.select(*[c for c in df.columns if c != "score"])
    names, shared = kept.columns, df.sparkSession.sparkContext.broadcast(model)
    place = names.index("text")

    def of(it):
        m = shared.value
        for b in batches(it):
            out = np.zeros(b.num_rows)
            if m is not None:
                raw, at, owner = fold(b.column(place).to_pylist())
                if len(owner):
                    code, begin, word = unique_words(raw, at)
                    p = m.probability(m.margins(code, begin))[word]
                    heads = np.flatnonzero(np.diff(owner, prepend=-1))
                    out[owner[heads]] = np.maximum.reduceat(p, heads)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*names, "score"])

    return kept.mapInArrow(of, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def train(documents: DataFrame, labels: DataFrame, per_label: int = 1000, most_bytes: int = 64 << 20) -> Model | None:
    """A model from at most per_label labelled rows of each kind, and at most most_bytes of texts, chosen by hash of the id, held-out ids never.

    A document with several labels is toxic if one is; null labels and ids and null texts don't count; repeated rows
    count once.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    h = F.xxhash64("doc_id", F.lit("sample"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    near = F.pmod(h, F.lit(1 << 30)) <= F.when(F.col("toxic") == 1, _place(per_label, sizes.get(1, 0))).otherwise(_place(per_label, sizes.get(0, 0)))
    some = [known.where(near & (F.col("toxic") == y)).orderBy(h, "doc_id").limit(per_label) for y in (0, 1)]
    texts = documents.select("doc_id", "text").where("text is not null")
    ids = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    # the driver sees lengths first, at most two rows a label for each that it asked for
    lengths = ids.groupBy("doc_id", "toxic").agg(F.min(F.octet_length("text")).alias("n")).withColumn("_h", h).orderBy("_h", "doc_id").collect()
    chosen, used = [], 0
    for r in lengths:
        if used + r["n"] <= most_bytes:
            chosen.append((r["doc_id"], r["toxic"]))
            used += r["n"]
    if not chosen:
        return None
    wanted = documents.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.octet_length("text"), "text")).alias("text")).orderBy("doc_id").select("text", "toxic").toPandas()
    return fit(list(rows["text"]), rows["toxic"].to_numpy() == 1)


def _place(n: int, rows: int) -> int:
    """A bound of hashes below 2**30 that about four times n of so many rows stay under."""
    return int(min(1, (4 * n + 100) / max(1, rows)) * (1 << 30))


def document_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from 0.7).

    Null, empty and wordless texts have score 0; each row is scored by its own text, repeated ones alike; rows without a
    doc_id are held out; without labels of both kinds all scores are 0. A score of 0.7 itself is predicted.
    """
    scored = score_texts(documents.select("doc_id", held_out().alias("held_out"), "text"), train(documents, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
