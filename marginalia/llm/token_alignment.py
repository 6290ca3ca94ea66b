"""Alignment of two tokenizers' tokens over the bytes of each text, and how many documents hold each linked pair of ids.

The tokens of both are intervals of bytes. Sorted by start, with the running maximum of their ends, a group begins
where a start reaches that maximum; within a group every token of A is linked with every one of B. A space after a
character that isn't white space always ends tokens of both, so texts are cut there and each task aligns a piece once.

Counts go through blocks of documents, never through (document, pair) rows: a block carries the pairs that it holds
and in how many of its documents; the corpus-wide counts of just those pairs come back to it.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20  # of text in a block of documents
KNOWN_PIECES, KNOWN_CHARS = 250_000, 16 << 20  # that a task remembers
CUT = re.compile(r"(?<=\S) (?!\Z)")  # no piece is empty: B puts no space in front of nothing
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, at array<int>, times array<int>, pairs array<long>, docs array<int>"


@dataclass
class Tokens:
    """What each id of a tokenizer stands for."""

    data: list[bytes]
    length: np.ndarray
    decimal: np.ndarray


def _tokens(data: list[bytes]) -> Tokens:
    return Tokens(data, np.array([len(d) for d in data], np.int64), np.array([str(i) for i in range(len(data))], object))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others by place from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(2)
def load(byte_bpe: str, pieces: str):
    """Both encoders (lists of texts to lists of ids; A's put a space in front themselves) and their tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a, letters = Tokenizer.from_file(byte_bpe), byte_letters()
    a.encode_special_tokens = True
    spelled = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
    b = sentencepiece.SentencePieceProcessor(model_file=pieces)
    named = [b.id_to_piece(i) for i in range(b.vocab_size())]
    if any("▁" in n.lstrip("▁") for n in named):
        raise ValueError("a piece goes on after a space: texts can't be cut there")
    data_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) else n.replace("▁", " ").encode() for i, n in enumerate(named)]
    # special tokens never come up as such: their letters needn't be those of the alphabet
    data_a = [bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s in spelled]
    return lambda t: [e.ids for e in a.encode_batch_fast([" " + x for x in t], add_special_tokens=False)], lambda t: b.encode(t, num_threads=1), _tokens(data_a), _tokens(data_b)


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals' order by group, side and start, and the group of each in that order."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(start[order][1:] >= reach[:-1])
    again = np.lexsort((start[order], side[order], group))
    return order[again], group[again]


class Pieces:
    """Pieces of text with their alignment: numbers by piece, and the linked pairs (A's id times B's size plus B's id) of all in a row."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.encode_a, self.encode_b, self.a, self.b = load(byte_bpe, pieces)
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.chars = 0
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, and 1 if bytes differ
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, new: list[str]) -> None:
        """Aligns new pieces, each taken with a space in front."""
        ids = self.encode_a(new), self.encode_b(new)
        raw = [(" " + t).encode() for t in new]
        size = np.array([len(r) for r in raw], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        bad = np.array([any(b"".join([k.data[i] for i in own[j]]) != r for own, k in zip(ids, (self.a, self.b), strict=True)) for j, r in enumerate(raw)], bool)
        start, end, side, token, piece = [], [], [], [], []
        for k, (own, tokens) in enumerate(zip(ids, (self.a, self.b), strict=True)):
            count = np.array([0 if x else len(i) for i, x in zip(own, bad, strict=True)], np.int64)
            flat = np.fromiter((t for i, x in zip(own, bad, strict=True) if not x for t in i), np.int64, count.sum())
            length = tokens.length[flat]
            to = np.cumsum(length)
            owner = np.repeat(np.arange(len(new)), count)
            before = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(count)])[:-1]]  # bytes of the side before each piece
            stop = to - before[owner] + base[owner]
            start.append(stop - length), end.append(stop), side.append(np.full(len(flat), k)), token.append(flat), piece.append(owner)
        start, end, side, token, piece = (np.concatenate(x) for x in (start, end, side, token, piece))
        order, group = coalesced(start, end, side)
        side, token, piece = side[order], token[order], piece[order]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        in_a, in_b = np.bincount(group[side == 0], minlength=n_groups), np.bincount(group[side == 1], minlength=n_groups)
        # each token of A with the run of B's tokens in its group
        of = group[side == 0]
        times, b_first = in_b[of], np.concatenate([[0], np.cumsum(in_b)])
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pair = np.repeat(token[side == 0], times) * len(self.b.data) + token[side == 1][np.repeat(b_first[of], times) + step]
        links = np.bincount(np.repeat(piece[side == 0], times), minlength=len(new))
        opens = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        numbers = np.stack([np.bincount(piece[side == 0], minlength=len(new)), np.bincount(piece[side == 1], minlength=len(new)), np.bincount(piece[opens], minlength=len(new)), links, bad], 1)
        last = np.concatenate([opens[1:], [True]]) if len(group) else opens
        turns = np.concatenate([side[1:] != side[:-1], [False]]) if len(group) else opens
        mark = np.where(last, ";", np.where(turns, "|", ",")).astype(object)
        text = (np.where(side == 0, self.a.decimal[np.where(side == 0, token, 0)], self.b.decimal[np.where(side == 1, token, 0)]) + mark).tolist()
        cut = np.searchsorted(piece, np.arange(len(new) + 1)).tolist()
        self.groups += ["".join(text[i:j])[:-1] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.pairs = np.concatenate([self.pairs, pair])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (tokens of A, of B, groups, links) and groups by text; then the distinct (text, pair) with how often each is linked."""
        if len(self.index) > KNOWN_PIECES or self.chars > KNOWN_CHARS:
            self.clear()
        parts = [CUT.split(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in self.index]
        if new:
            self.add(new)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        at = np.fromiter((self.index[w] for p in parts for w in p), np.int64, len(owner))
        run = np.zeros((len(at) + 1, 5), np.int64)
        np.cumsum(self.numbers[at], axis=0, out=run[1:])
        ends = np.cumsum([0] + [len(p) for p in parts])
        sums = run[ends[1:]] - run[ends[:-1]]
        good = sums[:, 4] == 0
        flat = at.tolist()
        groups = [";".join([self.groups[k] for k in flat[i:j]]) if g else "" for i, j, g in zip(ends[:-1].tolist(), ends[1:].tolist(), good.tolist(), strict=True)]
        kept = good[owner]
        key, times = np.unique(owner[kept] * len(self.groups) + at[kept], return_counts=True)
        doc, k = key // max(1, len(self.groups)), key % max(1, len(self.groups))
        many = self.first[k + 1] - self.first[k]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pair = self.pairs[np.repeat(self.first[k], many) + step]
        size = len(self.a.data) * len(self.b.data)
        both, back = np.unique(np.repeat(doc, many) * size + pair, return_inverse=True)
        weight = np.bincount(back, np.repeat(times, many), len(both)).astype(np.int64)
        return np.where(good[:, None], sums[:, :4], 0), groups, both // size, both % size, weight


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _block(number: int, ids: list, found: list) -> Iterator[pa.RecordBatch]:
    """The rows of a block: one a document, and one without doc_id that holds the block's pairs and in how many documents each is."""
    doc_id = pa.concat_arrays([pa.array(x, pa.int64()) for x in ids])
    n = len(doc_id)
    numbers, groups = np.concatenate([f[0] for f in found]), [g for f in found for g in f[1]]
    shift = np.cumsum([0] + [len(x) for x in ids])
    doc = np.concatenate([f[2] + s for f, s in zip(found, shift, strict=False)])
    pairs, at = np.unique(np.concatenate([f[3] for f in found]), return_inverse=True)
    times = np.concatenate([f[4] for f in found])
    whole = pa.array([number] * n, pa.int64())
    own = _lists(at.astype(np.int32), np.bincount(doc, minlength=n)), _lists(times.astype(np.int32), np.bincount(doc, minlength=n))
    none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for k in range(0, n, 500):
        yield pa.RecordBatch.from_arrays([x[k : k + 500] for x in (doc_id, *[pa.array(c) for c in numbers.T.copy()], pa.array(groups, pa.string()), whole, *own, *none)], names)
    empty = [pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.string()), pa.array([number], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays([*empty, pa.array([pairs], pa.list_(pa.int64())), pa.array([np.bincount(at, minlength=len(pairs)).astype(np.int32)], pa.list_(pa.int32()))], names)


def aligned(documents: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), block, and its pairs by their
    place in the block (at, times); per block one more row, with pairs and docs, where n_a is null.

    A text that is null, empty or not restored by both tokenizers has no tokens. Repeated rows are rows of their own.
    A task holds one block of texts at a time, and the pieces it remembers.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Pieces(byte_bpe, pieces), TaskContext.get().partitionId() << 32
        ids, found, held = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            for k in range(0, len(texts), 100):
                some = texts[k : k + 100].to_pylist()
                ids.append(batch.column(0)[k : k + 100].to_pylist())
                found.append(known.align(some))
                held += sum(len(t) for t in some if t)
                if held >= BLOCK_BYTES:
                    yield from _block(number, ids, found)
                    ids, found, held, number = [], [], 0, number + 1
        if ids:
            yield from _block(number, ids, found)

    return documents.select("doc_id", "text").mapInArrow(blocks, SCHEMA)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (n is the highest of its A id) of the block rows of aligned().

    The highest counts are one row an id of A: at most as many as A's vocabulary has, so they are broadcast.
    """
    counts = staged(rows.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.docs").cast("long")).alias("n")), "alignment-pairs")
    a = F.floor(F.col("pair") / b_size)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the documents of a block from the counts of its pairs."""
    n, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    n[known.place], best[known.place] = known.n, known.best
    size = np.array([0 if a is None else len(a) for a in docs["at"]], np.int64)
    full = [k for k, s in enumerate(size) if s]
    total = {c: np.zeros(len(docs), np.int64) for c in ("n_best", "count_sum")}
    if full:
        at, times = (np.concatenate([np.asarray(docs[c].iloc[k], np.int64) for k in full]) for c in ("at", "times"))
        cut = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        total["n_best"][full] = np.add.reduceat(times * best[at], cut)
        total["count_sum"][full] = np.add.reduceat(times * n[at], cut)
    return docs.drop(columns=["at", "times", "block"]).assign(**total)


def document_alignment(documents: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens).

    Rows that share a doc_id, or have none, count as documents of their own.
    """
    b_size = len(load(byte_bpe, pieces)[3].data)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.when(F.col("n_a") == 0, ""))
    rows = staged(aligned(documents, byte_bpe, pieces).withColumn("groups_sha256", digest).drop("groups"), "alignment")
    held = rows.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    back = held.join(pair_counts(rows, b_size), "pair").select(F.col("block").alias("of"), "place", "n", "best")
    docs = rows.where("n_a is not null").drop("pairs", "docs")
    fields = [f"{c} long" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + ["groups_sha256 string", "n_best long", "count_sum long"]
    scored = docs.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(_scored, ", ".join(fields))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
