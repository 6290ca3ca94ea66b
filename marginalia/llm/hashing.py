"""Vectorised word and character hashing of whole Arrow batches, used inside tasks."""

from __future__ import annotations

import numpy as np

BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)  # any odd base will do
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and extended between batches."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix64)."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (values[t] + 1) * BASE**t for t in [i, j), modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for arrays of bounds; it depends on the content alone."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def byte_batch(texts) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array as (bytes, n + 1 offsets from 0); null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def words_in(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes b with is_word[b] that don't cross texts, and the index of the first word of each text (n + 1)."""
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[:-1] = is_word[raw]
    first = np.flatnonzero(np.diff(np.concatenate(([np.int8(0)], inside))) == 1)
    last = np.flatnonzero(np.diff(inside) == -1) + 1 if len(raw) else first
    cuts = offsets[1:-1]  # a word that crosses a text's end is two
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts - 1] == 1)]
    if len(cuts):
        first, last = np.sort(np.concatenate((first, cuts))), np.sort(np.concatenate((last, cuts)))
    return first, last, np.searchsorted(first, offsets)


def batches(pieces, limit: int = 1 << 19):
    """Arrow record batches cut so that a slice has about limit bytes of its first string column, a longer row being alone."""
    for b in pieces:
        if not b.num_rows:
            continue
        col = next(c for c in b.columns if str(c.type) in ("string", "large_string"))
        size = _cumulative(col)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield b.slice(at, min(to, b.num_rows) - at)
            at = min(to, b.num_rows)


def _cumulative(col) -> np.ndarray:
    import pyarrow.compute as pc

    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))))
