"""Language identification by bit-sliced Bloom filters over character n-grams.

One slot of the filter holds a bit for each language, so ANDing the slots of an n-gram gives at once all languages
whose filter has it. A text's language is the one with most member n-grams, less those expected by chance.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_sample, held_out
from .hashing import batches, mix

GRAMS = (2, 3, 4)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of all texts with a space before and after each word, the text of each, and which texts have a letter."""
    low = [" " + (t or "").lower() + " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letters()[code]
    c = np.where(letter, code, 32).astype(np.uint64)
    hashes, owners = [], []
    for n in GRAMS:
        size = len(c) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        solid = np.ones(size, bool)  # inner places are letters; one end at least is one
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : k + size]
            if 0 < k < n - 1:
                solid &= letter[k : k + size]
        solid &= letter[:size] | letter[n - 1 :]
        solid &= owner[:size] == owner[n - 1 :]
        hashes.append(h[solid])
        owners.append(owner[:size][solid])
    has = np.zeros(len(low), bool)
    has[owner[letter]] = True
    return (mix(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)), (np.concatenate(owners) if owners else np.zeros(0, np.int64)), has


class BloomFilters:
    """Slots with a bit for each language, in one word or, beyond 64 languages, in several."""

    def __init__(self, members: dict[str, np.ndarray], usual: str, probes: int = 3):
        """Slots for the n-grams of each language, so many that an eighth of them at most is filled by one; usual is the language of texts without a known n-gram."""
        bits = max(16, int(8 * probes * max(len(h) for h in members.values())).bit_length())
        self.langs, self.usual, self.probes, self.mask = sorted(members), usual, probes, (1 << bits) - 1
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if np.iinfo(k).bits >= len(members)), np.uint64)
        self.slots = np.zeros((-(-len(members) // 64), 1 << bits), kind)
        for i, lang in enumerate(self.langs):
            for at in self._places(members[lang]):
                self.slots[i // 64, at] |= kind(1 << i % 64)
        filled = np.array([np.mean(self.slots[i // 64] >> kind(i % 64) & kind(1)) for i in range(len(self.langs))])
        self.chance = filled**probes  # false positives of each language

    def _places(self, h: np.ndarray):
        step = h >> np.uint64(32) | np.uint64(1)
        for k in range(self.probes):
            yield ((h + np.uint64(k) * step) & np.uint64(self.mask)).astype(np.int64)

    def languages(self, h: np.ndarray) -> np.ndarray:
        """Bit masks of the languages of each n-gram, words x n-grams."""
        out = None
        for at in self._places(h):
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out

    def scores(self, h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Corrected member counts, texts x languages."""
        mask, total = self.languages(h), np.bincount(owner, minlength=texts)
        kind = self.slots.dtype.type
        hits = np.stack([np.bincount(owner, mask[i // 64] >> kind(i % 64) & kind(1), texts) for i in range(len(self.langs))], 1)
        return np.maximum(0, (hits - total[:, None] * self.chance) / (1 - self.chance))


def train(labelled: DataFrame, sample: int = 1000, cover: float = 0.99, ratio: float = 0.6) -> BloomFilters | None:
    """Filters from rows (text, lang) with a lang: at most sample distinct texts of each language, chosen by hash.

    A language's filter holds the most frequent n-grams that make up the part cover of all its n-grams, of these the
    ones whose share in that language is at least ratio times the largest share in any. Filters are as large as that
    takes. Texts of the sample are counted in tasks; the driver gets the filters' n-grams, whose number the sample
    bounds. The usual language is that of most n-grams, ties by name. None without labelled rows.
    """
    some = distinct_sample(labelled.where("lang is not null and text is not null"), "lang", "text", sample).repartition(12)

    def count(it):
        totals: dict[str, pd.Series] = {}
        for b in batches(it, 1 << 18):
            langs, texts = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            h, owner, _ = grams_of(texts)
            for lang in np.unique(langs):
                key, n = np.unique(h[(langs == lang)[owner]], return_counts=True)
                s = pd.Series(n, key)
                totals[lang] = totals[lang].add(s, fill_value=0) if lang in totals else s
        for lang, s in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s.index.to_numpy().astype(np.uint64).view(np.int64)), pa.array(s.to_numpy().astype(np.int64))], ["lang", "h", "n"])

    counts = some.mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang")
    before = F.sum("n").over(by.orderBy(F.desc("n"), "h").rowsBetween(Window.unboundedPreceding, -1))
    top = counts.withColumns({"total": F.sum("n").over(by), "before": F.coalesce(before, F.lit(0))}).where(F.col("before") < cover * F.col("total")).withColumn("p", F.col("n") / F.col("total"))
    own = top.withColumn("best", F.max("p").over(Window.partitionBy("h"))).where(F.col("p") >= ratio * F.col("best"))
    got = own.select("lang", "h", "total").toPandas()
    if got.empty:
        return None
    totals = got.groupby("lang")["total"].max()
    return BloomFilters({lang: g["h"].to_numpy().view(np.uint64) for lang, g in got.groupby("lang")}, totals[totals == totals.max()].index.min())


def identify(documents: DataFrame, filters: BloomFilters | None) -> DataFrame:
    """documents (columns text and any others but lang_pred, score) with lang_pred and score.

    score is the winner's share of all languages' corrected counts. Text that is null or has no letter: und, 0.
    A text with letters whose n-grams are in no filter has the usual language and score 0; without filters all is und.
    Ties: first by name. Repeated rows stay.
    """
    names = [c for c in documents.columns if c not in ("lang_pred", "score")]
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    place = names.index("text")

    def of(it):
        for b in batches(it, 1 << 18):
            model, texts = shared.value, b.column(place).to_pylist()
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None:
                h, owner, has = grams_of(texts)
                s = model.scores(h, owner, len(texts))
                total, best = s.sum(1), s.argmax(1)
                lang[has] = model.usual
                ok = has & (total > 0)
                lang[ok] = np.array(model.langs, object)[best[ok]]
                score[ok] = s.max(1)[ok] / total[ok]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    kept = documents.select(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(of, schema)


def document_languages(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; taught by text and lang of rows that aren't held out."""
    filters = train(documents.where(~held_out()).select("text", "lang"))
    return identify(documents.select("doc_id", held_out().alias("held_out"), "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
