"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .components import components

PARTS = 8  # subspaces


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres from evenly spaced first rows of x; an empty centre stays where it was."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([_near(p, c).argmin(1) for p in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.diff(own[order], prepend=-1))
        c[own[order][heads]] = np.add.reduceat(x[order], heads) / np.diff(np.append(heads, len(x)))[:, None]
    return c


class Quantiser:
    """Coarse centres and the codebooks of the residuals' subspaces, fitted on a bounded sample of unit vectors."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = kmeans(x, lists)
        self.cuts = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        rest = x - self.coarse[_near(x, self.coarse).argmin(1)]
        self.books = [kmeans(rest[:, cut], 256) for cut in self.cuts]
        self.between = np.sqrt(_near(self.coarse, self.coarse))

    def probes(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home list of each row, and the lists whose border with it is no farther than margin (home included)."""
        d = _near(x, self.coarse)
        home = d.argmin(1)
        gap = np.where(self.between[home] > 0, (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * self.between[home], 1e-12), 0)
        return home, [np.flatnonzero(g <= margin) for g in gap]

    def codes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[home]
        return np.stack([_near(rest[:, cut], book).argmin(1) for cut, book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, home: int) -> np.ndarray:
        return self.coarse[home] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)

    def table_distances(self, q: np.ndarray, codes: np.ndarray, home: int) -> np.ndarray:
        """Squared distances of exact q to coded vectors of list home: one table look-up for each subspace."""
        rest, out = q - self.coarse[home], np.zeros((len(q), len(codes)), np.float32)
        for i, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += _near(rest[:, cut], book).astype(np.float32)[:, codes[:, i]]
        return out


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _match(q: pd.DataFrame, x: pd.DataFrame, home: int, model: Quantiser, least: float) -> pd.DataFrame:
    """Links of queries q to the vectors x of list home: rows (node, n, root), where roots join what is linked here."""
    vq, vx = unit(list(q["v"])), unit(list(x["v"]))
    codes = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
    # |q - decoded| <= |q - x| + |x - decoded|: the table distances lose no link
    reach = math.sqrt(max(0, 2 - 2 * least)) + np.sqrt(((vx - model.decoded(codes, home)) ** 2).sum(1)) + 1e-4
    a, b = [], []
    for lo in range(0, len(vq), 512):
        close = model.table_distances(vq[lo : lo + 512], codes, home) <= (reach * reach)[None, :]
        i, j = np.nonzero(close)
        for s in range(0, len(i), 1 << 16):
            e = slice(s, s + (1 << 16))
            ok = np.einsum("ij,ij->i", vq[i[e] + lo], vx[j[e]]) >= least
            a.append(i[e][ok] + lo)
            b.append(j[e][ok])
    a, b = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (a, b))
    idq, idx = q["node"].to_numpy(), x["node"].to_numpy()
    other = idq[a] != idx[b]
    a, b = a[other], b[other]
    # the pair is met again from the other side if x probes q's list; if not, it counts for x here
    lists = x["probes"].to_numpy()
    back = np.concatenate([np.asarray(p, np.int64) + k * len(model.coarse) for k, p in enumerate(lists)]) if len(lists) else np.zeros(0, np.int64)
    once = ~np.isin(b * len(model.coarse) + q["home"].to_numpy()[a], back)
    wq, wx = q["copies"].to_numpy(), x["copies"].to_numpy()
    nodes, inv = np.unique(np.concatenate((idq[a], idx[b])), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    n = np.bincount(ia, wx[b], len(nodes)) + np.bincount(ib[once], wq[a[once]], len(nodes))
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[ia], root[ib])
        new = root.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"node": nodes, "n": n.astype(np.int64), "root": nodes[root]})


def near_duplicates(vectors: DataFrame, least: float = 0.9, margin: float = 0.15, lists: int | None = None, block: int = 2048, chunk: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding).

    Copies of a vector are one indexed class with a count. lists, by default the square root of the number of
    classes and at most 16384, bounds the model that is broadcast; it is fitted on at most 40 vectors a list and
    100,000 in all, chosen by hash. A class is sent to its home list and asks all lists whose border is within margin: a neighbour at the
    threshold lies on the other side of a border farther away than that only if it is moved mostly across it, so
    recall depends on margin alone and is measured in the tests. Lists are cut into blocks and their queries into
    chunks, so a task never holds a whole list. Vectors that are null, zero or have null or non-finite components
    link with nothing; a cosine is between vectors of one length, so each length is searched by itself. Repeated
    rows are copies, 0.0 and -0.0 are equal.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)  # one zero
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(fine, v).alias("v")).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = staged(rows.where("v is not null").groupBy("h", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "pq-classes")
    lengths = [r[0] for r in classes.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()]
    links = None
    for d in lengths:
        found = _linked(classes.where(F.size("v") == d), least, margin, lists, block, chunk)
        links = found if links is None else links.unionByName(found)
    known = classes.select("h", "v", "node", "copies")
    if links is None:
        known = known.withColumns({"n": F.lit(0).cast("long"), "component": F.col("node")})
    else:
        links = staged(links, "pq-links")
        groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "pq-components")
        known = known.join(links.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(groups, "node", "left")
    known = known.select("h", F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    same = (rows["h"] == known["h"]) & (rows["v"] == known["_v"])  # the hash alone would do as a key, the vectors decide
    out = rows.join(known, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(classes: DataFrame, least: float, margin: float, lists: int | None, block: int, chunk: int) -> DataFrame:
    """(node, n, root) of the links between classes (h, v, node, copies) of vectors of one length."""
    spark, total = classes.sparkSession, classes.count()
    lists = lists or max(1, min(16384, int(math.sqrt(total))))
    most = min(40 * lists, 100_000)
    # a hash threshold first: the driver and the tasks sort about four times the sample at most
    near = classes.where(F.pmod("h", F.lit(1 << 30)) <= int(min(1, (4 * most + 100) / max(1, total)) * (1 << 30)))
    sample = near.orderBy("h", "node").limit(most).select("v").toPandas()["v"]
    model = Quantiser(unit([np.asarray(x, np.float64).tobytes() for x in sample]), lists)
    shared = spark.sparkContext.broadcast(model)

    def place(it):
        for p in it:
            if len(p):
                raw = [np.asarray(x, np.float64).tobytes() for x in p["v"]]
                x = unit(raw)
                home, probes = shared.value.probes(x, margin)
                yield pd.DataFrame({"node": p["node"], "copies": p["copies"], "v": raw, "home": home, "code": [c.tobytes() for c in shared.value.codes(x, home)], "probes": probes})

    index = staged(classes.mapInPandas(place, "node long, copies long, v binary, home int, code binary, probes array<int>"), "pq-index")
    sizes = {r[0]: r[1] for r in index.groupBy("home").count().collect()}  # a count for each list
    asked = {r[0]: r[1] for r in index.select(F.explode("probes").alias("at")).groupBy("at").count().collect()}
    cut = spark.createDataFrame([(k, -(-sizes[k] // block), -(-asked.get(k, 1) // chunk)) for k in sizes], "at int, blocks int, chunks int")
    each = lambda part, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(part)
    held = index.withColumn("at", F.col("home")).join(F.broadcast(cut), "at").withColumn("b", F.pmod(F.xxhash64("node"), "blocks")).select("*", each("c", "chunks")).select("at", "b", "c", F.lit(False).alias("asks"), "node", "copies", "v", "home", "code", "probes")
    asks = index.select("*", F.explode("probes").alias("at")).join(F.broadcast(cut), "at").withColumn("c", F.pmod(F.xxhash64("node", F.lit(1)), "chunks")).select("*", each("b", "blocks")).select("at", F.col("b").cast("long"), F.col("c").cast("int"), F.lit(True).alias("asks"), "node", "copies", "v", "home", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<int>").alias("probes"))
    cells = held.select("at", F.col("b").cast("int"), "c", "asks", "node", "copies", "v", "home", "code", "probes").unionByName(asks.withColumn("b", F.col("b").cast("int")))

    def cell(key, p: pd.DataFrame) -> pd.DataFrame:
        q, x = p[p["asks"]], p[~p["asks"]]
        if not len(q) or not len(x):
            return pd.DataFrame({"node": [], "n": [], "root": []}).astype(np.int64)
        return _match(q.reset_index(drop=True), x.reset_index(drop=True), int(key[0]), shared.value, least)

    return cells.groupBy("at", "b", "c").applyInPandas(cell, T.StructType([T.StructField(c, T.LongType()) for c in ("node", "n", "root")]))
