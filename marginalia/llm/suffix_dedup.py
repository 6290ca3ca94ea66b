"""Removal of repeated substrings by suffix order, over all documents.

Every window of LENGTH bytes is owned by its least hashed gram (the leftmost of equals), which depends on its content
alone, so equal windows have equal owners. Consecutive windows with one owner are a run. Runs that share the owner
but not the whole content are cut by the content that all their windows share, and what then still shares a key goes
to shards whose suffixes are put in order by induced sorting; windows that share LENGTH bytes with the one in front
there, by the common-prefix values that the sort carries, are repeats. Owners with more runs than a shard has room
for (a passage in very many documents, whose neighbours differ) aren't sorted: each of their windows is compared by
the hash of its content. All other decisions need no text: a lone owner is unique, and the later ones of equal runs
are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .hashing import batches, byte_batch, mix, prefix_sums, span_hashes
from .induced_sort import suffix_blocks

GRAM = 32
STEP = 8  # windows that are cut together


def window_runs(raw: np.ndarray, offsets: np.ndarray, length: int):
    """For each run of windows: its first window, its number of windows, the place of its owner; and the text of each."""
    windows = np.maximum(0, np.diff(offsets) - length + 1)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    gram = min(GRAM, length)
    sums = prefix_sums(raw)
    at = np.arange(len(raw) - gram + 1)
    h = span_hashes(sums, at, at + gram)
    best = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # the leftmost of equals
    span, have = length - gram + 1, 1
    while have * 2 <= span:
        best[: len(best) - have] = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    start = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(total)
    owner = (np.minimum(best[start], best[start + span - have]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(windows)), windows)
    heads = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]))))
    return start[heads], np.diff(np.append(heads, total)), owner[heads], text[heads]


def _runs(documents: DataFrame, length: int) -> DataFrame:
    """h1 (owner), h2 (content), doc_id, place (first window * 4096 + windows), known: a later one of equal runs met in one batch.

    Known repeats get an owner of their own, so that a passage in very many documents has a row for each batch only.
    """

    def of(it):
        for b in batches(it):
            raw, off = byte_batch(b.column(1))
            start, n, owner, text = window_runs(raw, off, length)
            if not len(start):
                continue
            sums = prefix_sums(raw)
            h1 = span_hashes(sums, owner, owner + min(GRAM, length))
            h2 = span_hashes(sums, start, start + n - 1 + length)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((start, ids[text], h2, h1))
            known = np.zeros(len(order), bool)
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            place = (start - off[text]) * 4096 + n
            # repeated rows of one document aren't repeats of each other
            twin = (ids[text][order][1:] == ids[text][order][:-1]) & (place[order][1:] == place[order][:-1])
            known[order[1:]] = same & ~twin
            h1 = np.where(known, mix(h1 ^ mix(ids[text].astype(np.uint64)) ^ mix(place.astype(np.uint64))), h1)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[text]), pa.array(place), pa.array(known)], ["h1", "h2", "doc_id", "place", "known"])

    return documents.mapInArrow(of, "h1 long, h2 long, doc_id long, place long, known boolean")


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, text, places) to the parts of the runs: key, doc_id, place, part (bytes)."""

    def of(it):
        for b in batches(it):
            keys, ids, places, parts = [], [], [], []
            raw, off = byte_batch(b.column(1))
            lists = b.column(2).to_pylist()
            own = [p for p in lists if p]
            if not own:
                continue
            text = np.repeat(np.arange(len(lists)), [len(p or ()) for p in lists])
            place = np.concatenate([np.asarray(p, np.int64) for p in own])
            first, n = off[text] + place // 4096, place % 4096
            # the owner of a run is that of its first window
            sums = prefix_sums(raw)
            gram = min(GRAM, length)
            at = np.arange(len(raw) - gram + 1)
            best = (span_hashes(sums, at, at + gram) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
            span, have = length - gram + 1, 1
            while have * 2 <= span:
                best[: len(best) - have] = np.minimum(best[: len(best) - have], best[have:])
                have *= 2
            owner = (np.minimum(best[first], best[first + span - have]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            doc = b.column(0).to_numpy(zero_copy_only=False)
            # windows by their distance to the owner, STEP together; all of those share length - STEP + 1 bytes
            far = (owner - first) // STEP
            near = (owner - first - n + 1) // STEP
            count = far - near + 1
            row = np.repeat(np.arange(len(first)), count)
            group = far[row] - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            lo = np.maximum(first[row], owner[row] - group * STEP - STEP + 1)
            hi = np.minimum(first[row] + n[row] - 1, owner[row] - group * STEP)
            shared = owner[row] - group * STEP
            key = mix(span_hashes(sums, shared, shared + length - STEP + 1) + group.astype(np.uint64))
            data = raw.tobytes()
            ids, keys = doc[text[row]], key.view(np.int64)
            places = (lo - off[text[row]]) * 4096 + hi - lo + 1
            parts = pa.array([data[i:j] for i, j in zip(lo, hi + length, strict=True)], pa.binary())
            for s in range(0, len(row), 50_000):
                e = slice(s, s + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[e]), pa.array(ids[e]), pa.array(places[e]), parts[e]], ["key", "doc_id", "place", "part"])

    return joined.mapInArrow(of, "key long, doc_id long, place long, part binary")


def _windows(joined: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, text, places) to the single windows of the runs: h1 and h2 (two hashes of the content), doc_id, place, known as in _runs.

    A window that is met in many documents has a row for each batch only; known ones in a row are one place.
    """

    def of(it):
        for b in batches(it):
            raw, off = byte_batch(b.column(1))
            lists = b.column(2).to_pylist()
            own = [p for p in lists if p]
            if not own:
                continue
            text = np.repeat(np.arange(len(lists)), [len(p or ()) for p in lists])
            place = np.concatenate([np.asarray(p, np.int64) for p in own])
            n = place % 4096
            row = np.repeat(np.arange(len(n)), n)
            start = (off[text] + place // 4096)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            sums = prefix_sums(raw)
            h2 = span_hashes(sums, start, start + length)
            h1 = mix(span_hashes(sums, start + 1, start + length - 1))
            doc = b.column(0).to_numpy(zero_copy_only=False)[text[row]]
            pos = start - off[text[row]]
            order = np.lexsort((pos, doc, h2, h1))
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            # repeated rows of one document aren't repeats of each other
            twin = (doc[order][1:] == doc[order][:-1]) & (pos[order][1:] == pos[order][:-1])
            known = np.zeros(len(order), bool)
            known[order[1:]] = same & ~twin
            heads = np.flatnonzero(np.concatenate(([True], ~(known[1:] & known[:-1] & (row[1:] == row[:-1])))))
            count = np.diff(np.append(heads, len(row)))
            h1, h2, doc, pos, known = h1[heads], h2[heads], doc[heads], pos[heads], known[heads]
            h1 = np.where(known, mix(h1 ^ mix(doc.astype(np.uint64)) ^ mix(pos.astype(np.uint64))), h1)
            places = pos * 4096 + count
            for s in range(0, len(heads), 50_000):
                e = slice(s, s + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(h1[e].view(np.int64)), pa.array(h2[e].view(np.int64)), pa.array(doc[e]), pa.array(places[e]), pa.array(known[e])], ["h1", "h2", "doc_id", "place", "known"])

    return joined.mapInArrow(of, "h1 long, h2 long, doc_id long, place long, known boolean")


def _sorted_repeats(parts: DataFrame, length: int, shard: int) -> DataFrame:
    """Repeats among parts that share a key: (doc_id, place) of the windows, by the suffix order of shards of whole keys."""

    def repeats(ids: np.ndarray, place: np.ndarray, blobs: list[bytes]):
        text = np.frombuffer(b"\0".join([*blobs, b""]), np.uint8)
        size = np.array([len(x) for x in blobs])
        begin = np.cumsum(size + 1) - size - 1
        symbols = text.astype(np.int16) + 1
        symbols[begin + size] = 0  # ends of parts
        row = np.full(len(text) + 1, -1, np.int32)
        n = place % 4096
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row[at] = np.repeat(np.arange(len(n)), n)
        wins, joined, least = [], [], 0  # least: of the values since the last window
        for order, values in suffix_blocks(symbols, length):
            at = np.flatnonzero(row[order] >= 0)
            if not len(at):
                least = min(least, int(values.min()))
                continue
            low = np.minimum.reduceat(values[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
            low[0] = min(low[0], least)
            least = int(values[at[-1] + 1 :].min(initial=length))
            wins.append(order[at])
            joined.append(low >= length)  # shares length bytes with the window in front
        wins, joined = np.concatenate(wins), np.concatenate(joined)
        cls = np.cumsum(~joined)
        who = row[wins]
        pos = place[who] // 4096 + wins - begin[who]
        order = np.lexsort((pos, ids[who], cls))
        first = np.concatenate(([True], np.diff(cls[order]) > 0))
        head = order[np.flatnonzero(first)][np.cumsum(first) - 1]
        twin = (ids[who[order]] == ids[who[head]]) & (pos[order] == pos[head])  # the first one itself, or a repeated row of it
        later = order[~twin]
        return ids[who[later]], pos[later] * 4096 + 1

    def of(it):
        held, size = [], 0
        for b in it:
            # rows come sorted by key; a shard ends where a key does
            held.append(b)
            size += b.nbytes
            if size < shard:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from out(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from out(pa.Table.from_batches(held))

    def out(t: pa.Table):
        ids, place = repeats(t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place)], ["doc_id", "place"])

    return parts.select("key", "doc_id", "place", "part").mapInArrow(of, "doc_id long, place long")


def _apply(joined: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, text, places) to the digest of what is left of each text."""

    def of(it):
        for b in batches(it):
            raw, off = byte_batch(b.column(1))
            data, rows = raw.tobytes(), []
            for k, places in enumerate(b.column(2).to_pylist()):
                text = data[off[k] : off[k + 1]]
                change = np.zeros(len(text) + 1, np.int32)
                if places:
                    p = np.asarray(places, np.int64)
                    np.add.at(change, p // 4096, 1)
                    np.add.at(change, p // 4096 + p % 4096 - 1 + length, -1)
                gone = np.cumsum(change)[:-1] > 0
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def shared_parts(dealt: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The parts of open runs that share their key with another one, in the order of the keys within each partition."""
    open_ = runs.where("open and not many and not again").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    parts = _cut(dealt.join(open_, "doc_id", "left"), length)
    return parts.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").sortWithinPartitions("key")


def repeats(documents: DataFrame, length: int = 100, shard: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """The documents dealt by doc_id, and (doc_id, places) of windows of length bytes that also start earlier.

    A place is first window * 4096 + number of windows. The texts are dealt once; Spark reuses that exchange.
    """
    spark = documents.sparkSession
    # without nulls in the key no filter is put below the exchange, which both joins then share
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    dealt = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    own, order = Window.partitionBy("h1"), Window.partitionBy("h1", "h2").orderBy("doc_id", "place")
    seen = _runs(docs, length).withColumns({"rank": F.rank().over(order), "lo": F.min("h2").over(own), "hi": F.max("h2").over(own), "n": F.count("*").over(own)})
    again, open_ = F.col("known") | (F.col("rank") > 1), F.col("lo") < F.col("hi")
    # a key's parts are of one owner, one from a run: without the owners of many runs, no key exceeds a shard
    runs = staged(seen.select("doc_id", "place", again.alias("again"), open_.alias("open"), (F.col("n") > shard // (length + STEP + 64)).alias("many")).where("again or open"), "suffix-runs")
    together = shared_parts(dealt, runs, length)
    many = runs.where("open and many and not again").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    windows = _windows(dealt.join(many, "doc_id").select("doc_id", "text", "places"), length).withColumn("rank", F.rank().over(order))
    found = runs.where("again").select("doc_id", "place").unionByName(_sorted_repeats(together, length, shard)).unionByName(windows.where("known or rank > 1").select("doc_id", "place"))
    return dealt, found.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def deduplicated(documents: DataFrame, length: int = 100, shard: int = 4 << 20) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing every byte of a window that also starts earlier.

    Earlier: smaller doc_id, or the same one and an earlier start. Null and empty texts have no bytes; rows that
    repeat a doc_id with its text are one document; texts that share a doc_id count by their places alone; a null
    doc_id is the least.
    """
    dealt, found = repeats(documents, length, shard)
    out = _apply(dealt.join(found, "doc_id", "left").select("doc_id", "text", "places"), length)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
