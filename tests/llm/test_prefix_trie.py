"""The trie against a plain version, with paths over many bands, ties, nulls and hot beginnings."""

import hashlib
import random
import zlib

import pytest

from marginalia.llm import prefix_trie
from marginalia.llm.prefix_trie import conversation_trie, end_hashes

KIND = "conv_id long, turn long, role string, text string, x string, depth string"


def plain(rows):
    """One dict entry a node, from the definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + own[c][h:]
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
            saved[k[:d]] = saved.get(k[:d], 0) + (len(members) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted(
        (m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in nodes.items()
    ) if nodes else []


def check(spark, rows):
    got = conversation_trie(spark.createDataFrame([(*r, "x", "d") for r in rows], KIND))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain(rows), key=str)


def test_deep_and_shared(spark):
    """Paths over three levels of bands, copies, long common beginnings, and turns that differ in role alone."""
    random.seed(3)
    rows = []
    for c in [*range(0, 60, 5), 61, 62, 63]:
        for t in range(600 if c in (10, 20, 61) else 21 if c % 2 else 9):
            same = t < 40 or c in (10, 61)
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {t}" if same else f"{c} {t} {random.random()}"))
    check(spark, rows)


def test_small_conversations(spark):
    random.seed(4)
    rows = [(c, t, random.choice(["user", "assistant"]), random.choice(["a", "bé", ""])) for c in range(-7, 120) for t in range(random.randrange(1, 9))]
    check(spark, rows)


def test_odd_rows(spark):
    long_ = "the quick brown fox " * 20000
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, "a", "z"), (1, 2, "user", long_), (1, 2, "user", long_), (6, 0, "user", long_), (9007199254740993, 0, None, "q"), (3, 5, "user", None), (3, -1, "user", "neg")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(c, 0, "user", "same") for c in range(3)])


def test_blocks(spark, monkeypatch):
    """A conversation over several blocks of the scan gets the same nodes."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    check(spark, [(c, t, "u", f"{t % 7}") for c in (5, 10, 15) for t in range(90)])


@pytest.mark.parametrize("n", [1, 5000, 9001])
def test_end_hashes(spark, n):
    """Ids of more than one chunk, in numeric order."""
    ids = [k * 3 - 50 for k in range(n)]
    got = end_hashes(spark.createDataFrame([(i, 7, 8) for i in ids], "conv_id long, x long, y long")).collect()
    assert [(r.x, r.y, r.ends_sha256) for r in got] == [(7, 8, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
