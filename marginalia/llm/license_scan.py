"""Licence scans: MinHash bands over overlapping windows of words retrieve templates; exact shingle containment verifies them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import batches, byte_batch, mix, prefix_sums, span_hashes, words_in
from .license_texts import TEMPLATES

WIDTH = 5  # words in a shingle


def _is_word() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return ok


def _shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the shingle that starts at each word, the text of each, and where each text's begin. A text of 1 to 4 words is one shingle."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)
    first, last, begin = words_in(low, offsets, _is_word())
    words = span_hashes(prefix_sums(low), first, last)
    n = np.diff(begin)
    count = np.where(n >= WIDTH, n - WIDTH + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    head = np.cumsum(count) - count
    start = np.repeat(begin[:-1] - head, count) + np.arange(len(owner))
    return span_hashes(prefix_sums(words), start, np.minimum(start + WIDTH, begin[1:][owner])), owner, np.append(head, len(owner))


class Templates:
    """Signatures of the templates by size, and the band settings of each size.

    A template of n shingles matches where a window of n shingles of a text holds the part least of its set. Windows that
    begin at every fourth of n are looked up, so one lies within an eighth of n of the best: it shares at least
    least - 1/8 of the template's shingles, a Jaccard similarity of (least - 1/8) / (1 + 1/8 + 1 - least) at least. Bands
    have one row; there are so many that the chance that none is equal is below miss. Templates of up to five words are
    one shingle: for these the look-up is exact. Windows end with their text.
    """

    def __init__(self, templates: list[tuple[str, str]] | None = None, least: float = 0.8, miss: float = 1e-4):
        templates = templates or TEMPLATES
        self.names, self.least = [n for n, _ in templates], least
        h, _, begin = _shingles(*byte_batch(pa.array([t for _, t in templates])))
        self.sets = [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        self.length = np.diff(begin)
        self.sizes: dict[int, dict] = {}
        for i, n in enumerate(self.length.tolist()):
            if n:
                self.sizes.setdefault(n, {"templates": []})["templates"].append(i)
        for n, entry in self.sizes.items():
            stride = max(1, n // 4)
            off = stride // 2
            common = math.ceil(least * min(len(self.sets[i]) for i in entry["templates"])) - off
            similar = common / (2 * n - common)
            bands = 1 if n == 1 else math.ceil(math.log(miss) / math.log(1 - max(0.05, min(similar, 0.999))))
            keys = [np.array([mix(self.sets[i] + np.uint64(1000003 * (k + 1))).min() for i in entry["templates"]]) for k in range(bands)]
            entry |= {"stride": stride, "bands": bands, "keys": keys}

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, float]]:
        """(text, template, first word of the window, containment): the best window of each template in each text, the first of equals."""
        h, owner, begin = _shingles(*byte_batch(texts))
        most = max((e["bands"] for e in self.sizes.values()), default=0)
        end = begin[owner + 1] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)  # shingles left in the text
        place = np.arange(len(h)) - begin[owner] if len(h) else end

        def joined(low: np.ndarray, by: int) -> np.ndarray:
            """Minima of low at each place and by places after it, where the text goes on as far."""
            out, far = low.copy(), np.flatnonzero(end > by)
            out[far] = np.minimum(low[far], low[far + by])
            return out

        seen: set[tuple[int, int]] = set()
        for k in range(most):
            low, have = mix(h + np.uint64(1000003 * (k + 1))), 1
            for n in sorted(self.sizes):
                entry = self.sizes[n]
                while have * 2 <= n:  # minima of have shingles from each place, doubled
                    low = joined(low, have)
                    have *= 2
                if k >= entry["bands"]:
                    continue
                begins = np.flatnonzero(place % entry["stride"] == 0)
                window = low[begins]
                if have < n:
                    far = end[begins] > n - have
                    window[far] = np.minimum(window[far], low[begins[far] + n - have])
                for key, i in zip(entry["keys"][k], entry["templates"], strict=True):
                    seen.update((int(owner[p]), i) for p in begins[window == key])
        out = []
        for text, i in sorted(seen):
            share, at = self._best(h[begin[text] : begin[text + 1]], i)
            if share >= self.least:
                out.append((text, i, at, share))
        return out

    def _best(self, own: np.ndarray, i: int) -> tuple[float, int]:
        """The largest part of template i that a window of its length holds, and where the first such window's first hit is."""
        places = np.flatnonzero(np.isin(own, self.sets[i]))
        ids, n = own[places].tolist(), int(self.length[i])
        inside: dict[int, int] = {}
        best, at, lo = 0, 0, 0
        for hi, (p, x) in enumerate(zip(places.tolist(), ids, strict=True)):
            inside[x] = inside.get(x, 0) + 1
            while places[lo] <= p - n:
                inside[ids[lo]] -= 1
                if not inside[ids[lo]]:
                    del inside[ids[lo]]
                lo += 1
            if len(inside) > best:
                best, at = len(inside), int(places[lo])
        return best / len(self.sets[i]), at


def read_templates(spark, path: str) -> list[tuple[str, str]]:
    """(name, text) of the text files of a folder, such as a collection of whole licences: to be added to TEMPLATES. At most 1,000 files of 200,000 characters."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").limit(1001).collect()
    if len(rows) > 1000 or any(len(r["value"]) > 200_000 for r in rows):
        raise ValueError("too many or too large templates to broadcast")
    return [(r["name"], r["value"]) for r in rows]


@lru_cache(1)
def _templates() -> Templates:
    return Templates()


def scan(documents: DataFrame, templates: Templates | None = None) -> DataFrame:
    """documents with matches: an array of (license, template, word, containment), best window of each template, whole texts.

    Null and empty texts have none; repeated rows have the same; templates that match alike are all named. A column of
    that name is replaced, others stay. The templates, a short list, are broadcast.
    """
    kept = documents.select(*[c for c in documents.columns if c != "matches"])
    names, shared = kept.columns, documents.sparkSession.sparkContext.broadcast(templates or _templates())
    place = names.index("text")
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("word", pa.int32()), ("containment", pa.float64())]))

    def of(it):
        t = shared.value
        for b in batches(it):
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for text, i, p, share in t.matches(b.column(place)):
                out[text].append({"license": t.names[i], "template": i, "word": p, "containment": share})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*names, "matches"])

    row = T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("containment", T.DoubleType())])
    return kept.mapInArrow(of, T.StructType([*kept.schema.fields, T.StructField("matches", T.ArrayType(row))]))


def document_licenses(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_matches, licenses (sorted names, comma-joined), best containment (0 without a match)."""
    found = scan(documents.select("doc_id", "text"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("best"))
