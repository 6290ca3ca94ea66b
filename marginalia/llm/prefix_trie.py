"""The prefix trie of conversations, and sums over its subtrees by depth bands.

A node is a sequence of turns; its key is the exclusive or of the hashes (twice 64 bits) of its turns and their places,
so that prefixes of conversations of any length are scanned in blocks. A node knows its ancestors within its band of
fixed height, never those beyond. Sums go up in two steps: nodes explode to the ancestors in their band; then the
bands' roots, a trie of their own that is summed in the same way, send their completed totals to the ancestors in the
band above. A level of bands has a node explode to at most as many rows as a band is high, and the number of levels is
the logarithm of the greatest depth to the base of that height.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.spans import numbered

from .common import staged

HEIGHT = 8  # of a band
BLOCK = HEIGHT * 512  # turns of one conversation that a task scans in a row
CHUNK = 4096  # range of conversation ids that are joined to one string


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn with nulls first, then role and text), two hashes and the bytes of the text.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation. A long conversation is numbered
    by ranges of its turns.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = numbered(rows, ["conv_id"], "turn", ["role", "text"], "pos")
    digests = [F.xxhash64(F.lit(k), "role", "text").alias(n) for k, n in ((1, "a"), (2, "b"))]
    return placed.select("conv_id", (F.col("pos") - 1).alias("pos"), *digests, F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(rows: DataFrame, period: int = 5, most: int = 9) -> DataFrame:
    """conv_id, depth (from 1), a, b, bytes, total of rows of turns(), and one row of depth 0 for each conversation.

    Conversation c begins with the first h turns of c - c % period (all if there are fewer, none if it is absent)
    and goes on with its own after its first h, where h is the unsigned crc32 of the decimal c modulo most.
    total is the number of turns that it has then.
    """
    heads = rows.where((F.col("conv_id") % period == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("head"))
    sized = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    known = sized.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % period}).join(heads, "base", "left")
    taken = known.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.greatest(F.col("h").cast("int"), F.lit(0))), F.array().cast(heads.schema["head"].dataType)))
    convs = taken.withColumn("shift", F.size("head").cast("long")).withColumn("total", F.col("shift") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    first = convs.select("conv_id", "total", F.explode("head").alias("r")).select("conv_id", (F.col("r.pos") + 1).alias("depth"), "r.a", "r.b", "r.bytes", "total")
    tails = rows.join(convs.select("conv_id", "h", "shift", "total"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shift") + 1).alias("depth"), "a", "b", "bytes", "total")
    none = F.lit(0).cast("long")
    return first.unionByName(tails).unionByName(convs.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("bytes"), "total"))


def _with_ancestors(paths: DataFrame, height: int) -> DataFrame:
    """paths(conv_id, depth, x, y, above) with above, the key of the row before, replaced by up: the keys of the ancestors in the band, its root first."""
    w = Window.partitionBy("conv_id", "block", "band").orderBy("depth")
    banded = paths.withColumn("band", F.floor((F.col("depth") - 1) / height)).withColumn("block", F.floor(F.col("band") / (BLOCK // HEIGHT)))
    up = F.concat(F.array(F.first("above").over(w)), F.collect_list(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return banded.withColumn("up", up).drop("above", "band", "block")


def paths(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """conv_id, depth, x, y, bytes, total, up of rows of rebuilt(): the node that each turn leads to. Depth 0 is the root."""
    hashed = rows.where("depth > 0").select("conv_id", "depth", "bytes", "total", F.xxhash64("depth", "a", "b").alias("p"), F.xxhash64(F.lit(3), "b", "depth", "a").alias("q"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("p").alias("bp"), F.bit_xor("q").alias("bq"))
    before = sums.select("conv_id", "block", zero(F.bit_xor("bp").over(w)).alias("cp"), zero(F.bit_xor("bq").over(w)).alias("cq"))
    own = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = hashed.withColumns({"sp": F.bit_xor("p").over(own), "sq": F.bit_xor("q").over(own)}).join(before, ["conv_id", "block"])
    keyed = scanned.withColumns({"x": F.col("sp").bitwiseXOR(F.col("cp")), "y": F.col("sq").bitwiseXOR(F.col("cq"))})
    keyed = keyed.withColumn("above", F.struct(F.col("x").bitwiseXOR(F.col("p")).alias("x"), F.col("y").bitwiseXOR(F.col("q")).alias("y")))
    return _with_ancestors(keyed.select("conv_id", "depth", "bytes", "total", "x", "y", "above"), height)


def subtree_sums(nodes: DataFrame, steps: DataFrame, weights: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """x, y and the sums of weights over the subtree of each node.

    nodes: x, y, depth, up and weights; steps: conv_id, depth, x, y, up of paths that reach all nodes; deepest: the
    greatest depth. Ancestors are many nodes' own, so sums are taken before each shuffle.
    """
    itself = F.array(F.struct("x", "y"))
    root = (F.col("depth") > 0) & (F.col("depth") % height == 0)  # of the band below
    totals = lambda df: df.groupBy(F.col("k.x").alias("x"), F.col("k.y").alias("y")).agg(*[F.sum(c).alias(c) for c in weights])
    if deepest <= height:
        return totals(nodes.select(F.explode(F.concat("up", itself)).alias("k"), *weights))
    parts = staged(totals(nodes.select(F.explode(F.when(root, itself).otherwise(F.concat("up", itself))).alias("k"), *weights)), "trie-parts")
    over = _with_ancestors(steps.where(root).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "x", "y", F.try_element_at("up", F.lit(1)).alias("above")), height)
    roots = over.groupBy("x", "y", "depth", "up").agg(F.lit(0).alias("_")).drop("_").join(parts, ["x", "y"])
    done = subtree_sums(roots, over, weights, deepest // height, height)
    sent = nodes.where(root).select("x", "y", "up").join(done, ["x", "y"]).select(F.explode("up").alias("k"), *weights)
    return totals(parts.select(F.struct("x", "y").alias("k"), *weights).unionByName(totals(sent).select(F.struct("x", "y").alias("k"), *weights)))


def _joined_hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the chunks of each key, which come one after another in order; only the hash's state is held."""
    key, state = None, None
    for part in parts:
        out = []
        for x, y, ids in zip(part.x, part.y, part.ids, strict=True):
            if (x, y) != key:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = (x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
    if state:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["x", "y", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """x, y, ends_sha256 of ends(conv_id, x, y): lowercase SHA-256 of the decimal ids in numeric order, comma-joined.

    Ids are joined to strings by ranges of CHUNK ids; a node's strings then pass through one task, as the hash has
    no parts that could be taken side by side, without ever being held together.
    """
    chunks = ends.groupBy("x", "y", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return chunks.repartition("x", "y").sortWithinPartitions("x", "y", "chunk").select("x", "y", "ids").mapInPandas(_joined_hashes, "x long, y long, ends_sha256 string")


def trie(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of rows of rebuilt(): x, y, depth, conv_id (smallest member), n_convs, parent_conv_id, n_children, n_leaves, saved_tokens, ends_sha256."""
    whole = staged(paths(rows, height), "trie-paths")
    starts = rows.where("depth = 0")
    none = F.lit(0).cast("long")
    top = starts.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(none.alias("x"), none.alias("y"), none.alias("depth"), none.alias("bytes"), F.array().cast(whole.schema["up"].dataType).alias("up"), "conv_id", "n_convs")
    below = whole.groupBy("x", "y", "depth", "bytes", "up").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))  # all but x and y follow from x and y
    nodes = staged(below.unionByName(top), "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    parent: Column = F.try_element_at("up", F.lit(-1))
    children = nodes.where("depth > 0").groupBy(parent["x"].alias("x"), parent["y"].alias("y")).agg(F.count("*").alias("n_children"))
    weighed = nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", none))
    weighed = staged(weighed.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-weighed")
    sums = subtree_sums(weighed, whole, ["n_leaves", "saved_tokens"], deepest, height)
    ends = whole.where("depth = total").select("conv_id", "x", "y").unionByName(starts.where("total = 0").select("conv_id", none.alias("x"), none.alias("y")))
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    named = weighed.drop("n_leaves", "saved_tokens").withColumns({"px": parent["x"], "py": parent["y"]}).join(above, ["px", "py"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    full = named.join(sums, ["x", "y"]).join(end_hashes(ends), ["x", "y"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return full.select("x", "y", "depth", "conv_id", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Per node of the rebuilt conversations: conv_id, depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Without conversations there is no node, the root neither; a conversation that is left without turns is a member of
    the root alone. Repeated rows are turns like others.
    """
    own = staged(turns(conversations), "trie-turns")
    nodes = trie(staged(rebuilt(own), "trie-rebuilt"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
