"""N-gram Jaccard join by parity sketches.

The shingles of a document are dealt by hash to blocks, and each block keeps the XOR of its shingles' hashes: a
shingle in one document only changes one block. At a Jaccard similarity of t two sets of a and b shingles differ in
at most (1 - t) / (1 + t) * (a + b) shingles, so of more blocks than that one at least is equal (pigeonhole). Blocks
are therefore numbered by size band and joined on their value; in the join the Hamming distance of short bit
sketches, a lower bound of the difference, decides first, that of sketches as wide as the sets are large next, and
then the sets themselves. Nothing is dropped: see _emit for empty blocks.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, staged
from .components import components
from .hashing import batches, byte_batch, mix, prefix_sums, span_hashes, words_in

SKETCH = 16  # longs of 64 bits: 1,024 bits tell sets of up to about 2,500 shingles apart, the wide sketches larger ones
BAND = 1.75  # about the fewest keys a document: a wider band has more blocks, a narrower one sends more documents to two
SHARE = 20_000  # a block key with more than this part of all keys is dealt to several tasks; there can't be more such keys
TURNS = 4  # all keys are shuffled in so many turns, by hash: of what is shuffled one turn's share is on disk at a time


def _is_word() -> np.ndarray:
    ok = np.ones(256, bool)
    ok[[32, *range(9, 14)]] = False
    return ok


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin (n + 1)."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)
    first, last, begin = words_in(low, offsets, _is_word())
    words = span_hashes(prefix_sums(low), first, last)
    n = np.diff(begin)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    start = np.repeat(begin[:-1], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(start + width, begin[1:][owner])
    h = span_hashes(prefix_sums(words), start, end)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[keep], h[keep]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def _xor_by(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros(groups, np.uint64)
    order = np.argsort(group, kind="stable")
    g, v = group[order], values[order]
    if len(g):
        heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        out[g[heads]] = np.bitwise_xor.reduceat(v, heads)
    return out


def _bands(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The size band of each count, and whether a partner may lie in the next band."""
    edges = [1]
    while edges[-1] <= (int(n.max()) if len(n) else 1) * 2:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    edges = np.array(edges)
    band = np.searchsorted(edges, n, "right") - 1
    return band, n * t.denominator >= edges[band + 1] * t.numerator


def _blocks(band: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each band: the number of blocks, how many of them are spare, and how many more than one a linked pair shares at least.

    A linked pair differs in at most blocks - spare - more - 1 of them. Bands where that is none have no blocks: their
    links are between equal sets only.
    """
    top = int(band.max()) + 1 if len(band) else 0
    edges = [1]
    while len(edges) <= top + 1:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    most = np.array([int((1 - t) / (1 + t) * 2 * (e - 1)) for e in edges[1:]])  # both sets have fewer than the band's upper edge
    lower = np.maximum(1, np.array([int(t * e) for e in edges[:-1]]))
    more = np.where(most == 0, 0, most // 8 + 2)
    base = most + 1 + more
    spare = np.where(most == 0, 0, np.ceil(2 + 2 * base * np.exp(-lower / base))).astype(int)
    return np.where(most == 0, 0, base + spare)[band], spare[band], more[band]


def _emit(h: np.ndarray, begin: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of all texts, where each text's begin, and how many of its keys may be left out: a linked pair shares more.

    An empty block says little and would join many documents, so there are spare blocks: a document with no more
    empty blocks than spare ones doesn't emit them (a linked pair shares more blocks than that, one of them filled);
    one with more emits them all.
    """
    n = np.diff(begin)
    band, near = _bands(n, t)
    keys, owners = [], []
    for plus, rows in ((0, np.flatnonzero(n > 0)), (1, np.flatnonzero((n > 0) & near))):
        m, spare, _ = _blocks(band[rows] + plus, t)
        rows, m, spare = rows[m > 0], m[m > 0], spare[m > 0]
        at = np.concatenate(([0], np.cumsum(m)))
        take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(rows)), n[rows])
        value = _xor_by(at[own] + (mix(h[take] + np.uint64(7)) % m[own].astype(np.uint64)).astype(np.int64), h[take], int(at[-1]))
        row = np.repeat(np.arange(len(rows)), m)
        block = np.arange(len(row)) - at[row]
        empty = value == 0
        out = ~empty | (np.bincount(row, empty, len(rows)) > spare)[row]
        tag = (band[rows] + plus)[row].astype(np.uint64) << np.uint64(40) | block.astype(np.uint64)
        # 48 bits: a quarter less to shuffle, and the few chance meetings don't get past the sketches
        keys.append((mix(value + mix(tag + np.uint64(1))) >> np.uint64(16))[out])
        owners.append(rows[row[out]])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.searchsorted(owners[order], np.arange(len(n) + 1)), np.where(n > 0, _blocks(band, t)[2], 0)


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


def _parity(h: np.ndarray, own: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """Bit sketches of longs[d] words of 64 bits for each text d, one after the other: a shingle flips one bit."""
    at = np.cumsum(longs) - longs
    bit = mix(h + np.uint64(99)) % (np.uint64(64) * longs[own].astype(np.uint64))
    return _xor_by(at[own] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)), int(longs.sum()))


def features(documents: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """doc_id, n, s1, s2 (identity of the set), sketch, keys, spared (how many keys may be left out) for each document."""

    def of(it):
        for b in batches(it):
            raw, off = byte_batch(b.column(0))
            h, begin = shingle_sets(raw, off, width)
            n = np.diff(begin)
            own = np.repeat(np.arange(len(n)), n)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            np.add.at(s1, own, mix(h))
            np.add.at(s2, own, mix(h ^ np.uint64(0x5555555555555555)))
            sketch = _parity(h, own, np.full(len(n), SKETCH))
            keys, at, spared = _emit(h, begin, threshold)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(sketch, np.arange(len(n) + 1) * SKETCH), _lists(keys, at), pa.array(spared.astype(np.int64))], ["doc_id", "n", "s1", "s2", "sketch", "keys", "spared"])

    long_, longs = T.LongType(), T.ArrayType(T.LongType())
    made = [("n", long_), ("s1", long_), ("s2", long_), ("sketch", longs), ("keys", longs), ("spared", long_)]
    return documents.select("text", "doc_id").mapInArrow(of, T.StructType([documents.schema["doc_id"], *[T.StructField(*f) for f in made]]))


def _sets(documents: DataFrame, width: int) -> DataFrame:
    """node, h (its shingles' hashes) and wide, a sketch of four to eight bits for each shingle, its length a power of two."""

    def of(it):
        for b in batches(it):
            h, begin = shingle_sets(*byte_batch(b.column(0)), width)
            n = np.diff(begin)
            longs = 1 << np.ceil(np.log2(np.maximum(1, n / 16))).astype(np.int64)
            wide = _parity(h, np.repeat(np.arange(len(n)), n), longs)
            yield pa.RecordBatch.from_arrays([b.column(1), _lists(h, begin), _lists(wide, np.concatenate(([0], np.cumsum(longs))))], ["node", "h", "wide"])

    longs = T.ArrayType(T.LongType())
    return documents.select("text", "node").mapInArrow(of, T.StructType([documents.schema["node"], T.StructField("h", longs), T.StructField("wide", longs)]))


def _distance(a: Column, b: Column) -> Column:
    """Hamming distance of two sketches; one of twice the other's length is folded first, of others nothing is known: 0."""
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda c, v: c + v)
    half = lambda x, m: F.zip_with(F.slice(x, 1, m), F.slice(x, m + 1, m), lambda p, q: p.bitwiseXOR(q))
    m, n = F.size(a), F.size(b)
    return F.when(m == n, bits(a, b)).when(m == 2 * n, bits(half(a, n), b)).when(n == 2 * m, bits(a, half(b, m))).otherwise(0)


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Those of pairs(a, b) whose sets have a Jaccard similarity of t or more. Only pairs with close wide sketches move shingles."""
    p, q = t.numerator, t.denominator

    def with_(pairs: DataFrame, what: Column) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), what.alias(f"{side}_x"), F.size("h").alias(f"{side}_n")), side)
        return pairs

    near = with_(pairs, F.col("wide")).where(_distance(F.col("a_x"), F.col("b_x")) * (q + p) <= (F.col("a_n") + F.col("b_n")) * (q - p)).select("a", "b").distinct()
    both = with_(near, F.col("h")).withColumn("common", F.size(F.array_intersect("a_x", "b_x")))
    return both.where(F.col("common") * q >= (F.col("a_n") + F.col("b_n") - F.col("common")) * p).select("a", "b").distinct()


def _swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is staged and no longer referred to; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _staged_in_turns(parts: Iterator[DataFrame], label: str) -> list[DataFrame]:
    """Each of parts staged before the next one is begun; what one shuffled is deleted by then."""
    done = []
    for part in parts:
        done.append(staged(part, label))
        _swept(part.sparkSession)
    return done


def _turns(*column: str) -> list[Column]:
    """Conditions of which each row fulfils one, by the hash of column."""
    return [F.pmod(F.xxhash64(*column), F.lit(TURNS)) == k for k in range(TURNS)]


def _shared_blocks(held: DataFrame) -> list[DataFrame]:
    """held(key, node) of the keys of several nodes, in parts by key.

    Keys that hold more than one SHARE-th of all rows, by a sixteenth of the nodes, are cut into parts by the node's
    hash, so that no task gets a hot block; which keys those are changes nothing but the load.
    """
    some = held.where(F.pmod(F.xxhash64("node"), F.lit(16)) == 0)
    total = some.count()
    hot = some.groupBy("key").agg(F.count("*").alias("c")).where((F.col("c") * SHARE > total) & (F.col("c") > 64)).select("key", F.ceil(F.col("c") * SHARE / F.lit(max(1, total))).cast("int").alias("parts"))
    hot = staged(hot, "parity-hot")
    own = Window.partitionBy("key", "part")

    def shared(turn: Column) -> DataFrame:
        dealt = held.where(turn).join(F.broadcast(hot), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node", "key"), F.col("parts")), F.lit(0)))
        several = dealt.withColumns({"lo": F.min("node").over(own), "hi": F.max("node").over(own)}).where((F.col("lo") < F.col("hi")) | F.col("parts").isNotNull())
        return several.select("key", "node").distinct()

    return _staged_in_turns((shared(t) for t in _turns("key")), "parity-shared")


def _deciding(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """shared(key, node) without the most frequent keys of each node, as many as nodes(node, spared) say.

    Linked sets share more keys than either leaves out, and of those they share the rarest stays with both; sets with
    no more shared keys than that link with nothing. So a passage in very many documents makes no pairs by itself.
    """
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("size")), "key").join(nodes, "node")
    frequent = Window.partitionBy("node").orderBy(F.desc("size"), F.desc("key"))
    return staged(sized.withColumn("k", F.row_number().over(frequent)).where(F.col("k") > F.col("spared")).select("key", "node"), "parity-live")


def similar_groups(documents: DataFrame, width: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included) for each row.

    doc_id may have any type that has an order. Links are exact: every pair of different sets in a shared block is
    either verified or already in one component. Copies count as one set. Each set is first compared with that least
    set of its blocks with which it shares most of them; in the rounds after it about four members of each block
    (chosen by hash), then sixteen times as many and so on, are compared with the members of other components, so
    a large group of near copies is joined through few of its members.
    Null, empty and wordless texts link with nothing. Rows that share a doc_id are one node; a row without one has
    the least doc_id of the others with its set as its component, or none.
    """
    t = Fraction(threshold).limit_denominator(1000)
    docs = documents.select("doc_id", "text")
    keyed = staged(features(docs, width, t), "parity-keys")
    nodes = staged(keyed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node")), "parity-nodes")
    members = staged(keyed.select("doc_id", "n", "s1", "s2").join(nodes, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node")), "parity-members")
    # staged, as the look at hot blocks, the blocks and the sketches would each shuffle all keys for this join
    chosen = nodes.select("n", "s1", "s2", F.col("node").alias("doc_id"))
    firsts = _staged_in_turns((keyed.where(t).join(chosen.where(t), ["doc_id", "n", "s1", "s2"], "left_semi") for t in _turns("doc_id")), "parity-first")
    discard(keyed)
    first = reduce(DataFrame.unionByName, firsts)
    bits = [f"w{k}" for k in range(SKETCH)]
    sketches = staged(first.select(F.col("doc_id").alias("node"), "n", "spared", *[F.get("sketch", F.lit(k)).alias(w) for k, w in enumerate(bits)]), "parity-sketches")
    # rows that share a doc_id are one node: the least of what they spare holds for all
    spared = sketches.groupBy("node").agg(F.min("spared").alias("spared"))
    shared = _shared_blocks(first.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node")))
    for part in firsts:
        discard(part)
    live = _deciding(reduce(DataFrame.unionByName, shared), spared)
    for part in shared:
        discard(part)
    _swept(documents.sparkSession)
    sketches = sketches.drop("spared")
    p, q = t.numerator, t.denominator
    far = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in bits), F.lit(0))
    close = (F.least("a.n", "b.n") * q >= F.greatest("a.n", "b.n") * p) & (far * (q + p) <= (F.col("a.n") + F.col("b.n")) * (q - p))
    # the first round: one pair for each set
    least = live.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    votes = live.join(least, "key").where("node <> lo").groupBy("node", "lo").count().groupBy("node").agg(F.max_by("lo", F.struct("count", "lo")).alias("lo"))
    ends = votes.join(sketches.alias("b"), "node").join(sketches.withColumnRenamed("node", "lo").alias("a"), "lo")
    pairs = ends.where(close).select(F.col("lo").alias("a"), F.col("node").alias("b"))
    links, groups, sized, left, done = None, None, None, None, 0
    while True:
        pairs = staged(pairs, "parity-pairs")
        if not pairs.isEmpty():  # arrays of shingles are made for the documents of close pairs only
            wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            sets = staged(_sets(docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node", "left_semi"), width), "parity-sets")
            found = staged(_verified(pairs, sets, t), "parity-links")
            discard(sets)
            _swept(documents.sparkSession)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                groups = staged(components(links, "parity-components"), "parity-groups")
        discard(pairs)
        if sized is None:
            sizes = live.groupBy("key").agg(F.count("*").alias("size"))
            # place / 2**30 * size < k for about k members of a key, and for all of them if it has no more than k
            sized = live.join(sizes, "key").select("key", "node", "size", (F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) * F.col("size")).alias("place"))
        step = max(4, 16 * done)
        rows = sized.where(F.col("size") > done)
        rows = rows.withColumn("comp", F.col("node")) if groups is None else rows.join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        before, left = (left if done else None), staged(rows.join(mixed, "key", "left_semi").join(sketches, "node"), "parity-left")
        if before is not None:
            discard(before)
        _swept(documents.sparkSession)
        if left.isEmpty():
            break
        sized = left.select("key", "node", "size", "place")
        heads = left.where((F.col("place") >= done << 30) & (F.col("place") < step << 30))
        later = (F.col("b.place") >= step << 30) | ((F.col("b.place") >= done << 30) & (F.col("a.node") < F.col("b.node")))
        met = (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & later
        pairs = left.alias("b").join(heads.alias("a"), met & close).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
        done = step
    if groups is None:
        return members.select("doc_id", "n_shingles", F.col("node").alias("component_id"))
    return members.join(groups, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
