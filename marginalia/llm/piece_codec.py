"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The words of a batch that the task hasn't met yet are concatenated and indexed by a suffix array; every piece of the
vocabulary is binary-searched for its range of occurrences; the occurrences, sorted by position, are the edges that
are relaxed: in each word the best-scored edge over two neighbouring symbols joins them, until none is left.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import batches, byte_batch, prefix_sums, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.iinfo(np.int32).max
SHORT = 64  # characters; longer words are relaxed one by one with a heap


@dataclass
class Pieces:
    """What encoding needs of a model: mark (U+2581) is written as a space throughout."""

    ids: np.ndarray  # of the pieces that text can match
    text: list[str]
    rank: np.ndarray  # 0 is best; equal scores have equal ranks
    byte: np.ndarray  # id of each byte's piece, -1 without byte fallback
    unknown: int
    out: list[bytes]  # what each id decodes to


def load(path: str = MODEL) -> Pieces:
    """The pieces of a BPE model whose normaliser changes nothing and adds a space in front; its size is the broadcast's bound."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    usable = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    text = [m.id_to_piece(i).replace("▁", " ") for i in usable]
    if any(len(t) > 31 for t in text):
        raise ValueError("a piece has more than 31 characters: keys of edges are place * 32 + length")
    score = np.array([m.get_score(i) for i in usable])
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
    byte = np.full(256, -1, np.int32)
    out = []
    for i in range(n):
        if m.is_byte(i):
            byte[int(m.id_to_piece(i)[3:5], 16)] = i
            out.append(bytes([int(m.id_to_piece(i)[3:5], 16)]))
        else:
            out.append(b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else m.id_to_piece(i).replace("▁", " ").encode())
    return Pieces(np.array(usable, np.int32), text, rank, byte, m.unk_id(), out)


def suffix_array(rank: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of rank (symbols from 1, bits wide) sorted by their next depth symbols, their sorted first keys, and the symbols in a key.

    Several symbols are packed in a key; ranks of keys are doubled until they cover depth.
    """
    per = min(depth, 63 // bits)
    padded = np.concatenate((rank, np.zeros(depth, rank.dtype)))
    first = np.zeros(len(rank), np.int64)
    for k in range(per):
        first = first << bits | padded[k : k + len(rank)]
    key, have = first, per
    while have < depth:
        name = np.unique(key, return_inverse=True)[1]
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - have)] = name[have:] + 1
        key, have = name * (len(rank) + 2) + after, have * 2
    order = np.argsort(key, kind="stable")
    return order, first[order], per


class Encoder:
    """Encodes texts of one task; remembers at most memory words, so that its size is bounded."""

    def __init__(self, pieces: Pieces, memory: int = 300_000):
        self.p, self.memory = pieces, memory
        self.depth = max(map(len, pieces.text))
        self.size = np.array([len(t) for t in pieces.text])
        self.codes = np.zeros((len(pieces.text), self.depth), np.int64)
        for i, t in enumerate(pieces.text):
            self.codes[i, : len(t)] = [ord(c) for c in t]
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words
        self.row = np.zeros(0, np.int64)  # where their tokens are
        self.tokens, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys position * 32 + length, sorted, and the piece of each occurrence in code."""
        symbols, rank = np.unique(code, return_inverse=True)
        bits = int(len(symbols) + 1).bit_length()  # one more than needed, so that no key overflows
        order, keys, per = suffix_array(rank + 1, bits, self.depth)
        at = np.searchsorted(symbols, self.codes).clip(max=len(symbols) - 1)
        body = np.arange(self.depth) < self.size[:, None]
        mine = np.where(body, at + 1, 0)
        short = np.minimum(self.size, per)
        low = np.zeros(len(self.size), np.int64)
        for k in range(per):
            low = low << bits | mine[:, k]
        known = ((symbols[at] == self.codes) | ~body).all(1)
        lo = np.searchsorted(keys, low)
        hi = np.searchsorted(keys, low + (np.int64(1) << (bits * (per - short)).astype(np.int64)))
        hi = np.where(known, hi, lo)
        long_ = np.flatnonzero((self.size > per) & (lo < hi))  # the key has their beginning only
        padded = np.concatenate((rank + 1, np.zeros(self.depth, rank.dtype)))
        cols = np.arange(per, self.depth)

        def bound(low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
            low, high = low.copy(), high.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid, p = (low[open_] + high[open_]) // 2, long_[open_]
                seen = np.where(cols < self.size[p, None], padded[order[mid][:, None] + cols], 0)
                differs = seen != mine[p, per:]
                rows, j = np.arange(len(p)), differs.argmax(1)
                less = np.where(differs[rows, j], seen[rows, j] < mine[p, per:][rows, j], right)
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            return low

        if len(long_):
            start = bound(lo[long_], hi[long_], False)
            hi[long_] = bound(start, hi[long_], True)
            lo[long_] = start
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        at = order[np.repeat(lo, n) + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)]
        key = at * 32 + self.size[piece]
        by = np.argsort(key, kind="stable")
        return key[by], piece[by]

    def _relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words and where each word's begin."""
        code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size + 1) - size - 1
        # U+0000 inside a word mustn't look like the end of one
        ends = start + size
        body = np.ones(len(code), bool)
        body[ends] = False
        code = np.where(body, code + 1, 0)
        self_codes, self.codes = self.codes, np.where(self.codes > 0, self.codes + 1, 0)
        try:
            key, piece = self._edges(code)
        finally:
            self.codes = self_codes

        def look(pos: np.ndarray, length: np.ndarray) -> np.ndarray:
            want = pos * 32 + length
            at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            return np.where((length <= self.depth) & (key[at] == want), piece[at], -1) if len(key) else np.full(len(pos), -1)

        rank = np.append(self.p.rank, NONE)  # of piece -1: none
        length = np.ones(len(code), np.int64)  # of the symbol that starts here, 0 inside one
        length[ends] = 0
        for width in (4, 8, 16, 32, SHORT):
            rows = np.flatnonzero((size <= width) & (size > (width // 2 if width > 4 else 1)))
            if len(rows):
                self._short(start[rows], size[rows], width, look, rank, length)
        for w in np.flatnonzero(size > SHORT):
            self._long(int(start[w]), int(size[w]), look, rank, length)
        pos = np.flatnonzero(length)
        got = look(pos, length[pos])
        ids = np.where(got >= 0, self.p.ids[got], -1)
        owner = np.searchsorted(start, pos, "right") - 1
        count = np.ones(len(pos), np.int64)
        lost = np.flatnonzero(ids < 0)
        spelled = [[self.p.unknown] if (self.p.byte < 0).any() else self.p.byte[list(chr(code[pos[i]] - 1).encode("utf-8", "surrogatepass"))] for i in lost]
        count[lost] = [len(s) for s in spelled]
        tokens = np.repeat(ids, count).astype(np.int32)
        if len(lost):
            tokens[tokens < 0] = np.concatenate(spelled)
        total = np.bincount(owner, count, len(words)).astype(np.int64)
        return tokens, np.concatenate(([0], np.cumsum(total)))

    @staticmethod
    def _short(start, size, width, look, rank, length) -> None:
        cols = np.arange(width)
        there = cols < size[:, None]
        sym = there.astype(np.int64)  # length of the symbol that starts at a place
        before = np.broadcast_to(cols - 1, there.shape).copy()  # start of the symbol in front
        best = np.full(there.shape, NONE, np.int32)
        r, c = np.nonzero(cols < size[:, None] - 1)
        best[r, c] = rank[look(start[r] + c, np.full(len(r), 2))]
        live = np.arange(len(size))
        while len(live):
            at = best[live].argmin(1)  # the leftmost of equals
            ok = best[live, at] < NONE
            live, at = live[ok], at[ok]
            if not len(live):
                break
            gone = at + sym[live, at]
            sym[live, at] += sym[live, gone]
            sym[live, gone] = 0
            best[live, gone] = NONE
            nxt = at + sym[live, at]
            has = nxt < size[live]
            before[live[has], nxt[has]] = at[has]
            joined = np.where(has, sym[live, at] + sym[live, np.minimum(nxt, width - 1)], 32 * 32)
            best[live, at] = np.where(has, rank[look(start[live] + at, np.minimum(joined, 31))], NONE)
            prev = before[live, at]
            has = prev >= 0
            lp, pp = live[has], prev[has]
            best[lp, pp] = rank[look(start[lp] + pp, np.minimum(sym[lp, pp] + sym[lp, at[has]], 31))]
        r, c = np.nonzero(there)
        length[start[r] + c] = sym[r, c]

    def _long(self, start, size, look, rank, length) -> None:
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        sym = [1] * size
        one = [int(x) for x in rank[look(start + np.arange(size - 1), np.full(size - 1, 2))]]
        heap = [(r, i, i + 1, 2) for i, r in enumerate(one) if r < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, j, total = heapq.heappop(heap)
            if not sym[i] or j >= size or after[i] != j or not sym[j] or sym[i] + sym[j] != total:
                continue
            sym[i], sym[j] = total, 0
            after[i] = k = after[j]
            if k < size:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < size and sym[a] + sym[b] <= self.depth:
                    r = int(rank[look(np.array([start + a]), np.array([sym[a] + sym[b]]))][0])
                    if r < NONE:
                        heapq.heappush(heap, (r, a, b, sym[a] + sym[b]))
        length[start : start + size] = sym

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts and where each text's begin (n + 1). Null and empty texts have none."""
        import pyarrow.compute as pc

        texts = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
        full = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        raw, off = byte_batch(pc.binary_join_element_wise(pc.if_else(pa.array(full), " ", ""), texts, ""))
        space = raw == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[off[:-1][full]] = True
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(raw))
        h = span_hashes(prefix_sums(raw), first, last)
        uniq, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.memory:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, uniq), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != uniq) if len(self.known) else np.arange(len(uniq))
        if len(new):
            data = raw.tobytes()
            words = [data[first[i] : last[i]].decode("utf-8", "surrogatepass") for i in index[new]]
            tokens, begin = self._relax(words)
            known, row = np.concatenate((self.known, uniq[new])), np.concatenate((self.row, len(self.begin) - 1 + np.arange(len(new))))
            self.tokens, self.begin = np.concatenate((self.tokens, tokens)), np.concatenate((self.begin, self.begin[-1] + begin[1:]))
            order = np.argsort(known)
            self.known, self.row = known[order], row[order]
        row = self.row[np.searchsorted(self.known, uniq)][inverse]
        n = self.begin[row + 1] - self.begin[row]
        out = self.tokens[np.repeat(self.begin[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate(([0], np.cumsum(n)))
        return out, ends[np.searchsorted(first, off)]


def encode(df: DataFrame, pieces: Pieces, text: str = "text", to: str = "ids") -> DataFrame:
    """df with column to (replaced if there): the token ids of the text, whole; null and empty texts have none."""
    kept = df.select(*[c for c in df.columns if c != to])
    names, shared = kept.columns, df.sparkSession.sparkContext.broadcast(pieces)
    place = names.index(text)

    def of(it):
        enc = Encoder(shared.value)
        for b in batches(it):
            tokens, begin = enc.encode(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(tokens))], [*names, to])

    return kept.mapInArrow(of, T.StructType([*kept.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with column to (replaced if there): the text of token ids. Null ids give null; bytes that aren't UTF-8 become U+FFFD."""
    kept = df.select(*[c for c in df.columns if c != to])
    names, shared = kept.columns, df.sparkSession.sparkContext.broadcast(pieces)
    place = names.index(ids)

    def of(it):
        out = shared.value.out
        size = np.array([len(x) for x in out])
        data, at = np.frombuffer(b"".join(out), np.uint8), np.cumsum(size) - size
        for b in it:
            for low in range(0, b.num_rows, 250):
                part = b.slice(low, 250)
                lists = part.column(place)
                n = np.array(lists.value_lengths().fill_null(0))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                s = size[flat]
                chars = data[np.repeat(at[flat] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))]
                ends = np.concatenate(([0], np.cumsum(s)))[np.concatenate(([0], np.cumsum(n)))]
                whole = chars.tobytes()
                texts = [whole[i + (whole[i : i + 1] == b" ") : j].decode("utf-8", "replace") if ok else None for i, j, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, to])

    return kept.mapInArrow(of, T.StructType([*kept.schema.fields, T.StructField(to, T.StringType())]))


def document_tokens(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, ids_hash and round_trip: the ids decode to the text (with U+2581 as a space)."""
    pieces = load(path)
    coded = decode(encode(documents.select("doc_id", "text"), pieces), pieces)
    same = F.col("decoded") == F.coalesce(F.replace("text", F.lit("▁"), F.lit(" ")), F.lit(""))
    return coded.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))
