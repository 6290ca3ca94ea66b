"""Alignments against a plain version that encodes whole texts with the libraries."""

import hashlib
import os
import random

import numpy as np
import pytest

from marginalia.llm import token_alignment as ta
from marginalia.llm.token_alignment import BYTE_BPE, PIECES, coalesced, document_alignment

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no tokenizers")
SF = "/root/testdata/sf0.001"


def plain(rows):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of (doc_id, text), from the definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES), ta.byte_letters()
    a.encode_special_tokens = True
    docs = []
    for doc_id, text in rows:
        ids = ([], []) if not text else (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        data = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if any(b"".join(d) != (" " + (text or "")).encode() for d in data):
            ids, data = ([], []), [[], []]
        ends = [np.cumsum([len(x) for x in d]).tolist() for d in data]
        place = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
        cuts = sorted(place[0].keys() & place[1].keys())
        groups, at = [], [0, 0]
        for cut in cuts:
            group = []
            for k in (0, 1):
                n = place[k][cut]
                group.append(ids[k][at[k] : n])
                at[k] = n
            groups.append(group)
        docs.append((doc_id, groups))
    counts = {}
    for _, groups in docs:
        for p in {(x, y) for g in groups for x in g[0] for y in g[1]}:
            counts[p] = counts.get(p, 0) + 1
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


ODD = [
    "plain words here", "", None, " leading", "trailing ", "two  spaces   three", "\n\nnew\n lines \n", "tab\there", "naïve café 東京都 😀😀", "a<|endoftext|>b <s> </s> <unk>", "▁under ▁ score", "x▁y", "it's we'll I'd 'quoted'",
    "nbsp and　wide line", "\x1c\x1d sep \x85 nel", "\x00 nul \x00", "é" * 300, "a" * 5000, "12345 67,890.12", "—dash–dash", "\r\n dos\r\nlines", "مرحبا بالعالم", " ", "  ", "\n", "a \n b", "end​ zero ﻿ bom", "é combining",
]


def check(spark, rows):
    got = document_alignment(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, groups string, block long"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain(rows), key=str)


def test_odd_texts(spark):
    check(spark, list(enumerate(ODD)))
    random.seed(5)
    letters = " \n\t a'bZé1.▁東<|>"
    check(spark, [(k, "".join(random.choice(letters) for _ in range(random.randrange(60)))) for k in range(300)])


def test_repeated_rows_and_no_rows(spark):
    check(spark, [(1, "the same text"), (1, "the same text"), (None, "the same text"), (2, None)])
    check(spark, [])


def test_given_documents_in_blocks(spark, monkeypatch):
    """Blocks of a few documents and a memory of a few pieces give the same numbers."""
    monkeypatch.setattr(ta, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(ta, "KNOWN_PIECES", 500)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows)


def test_very_long_text(spark):
    random.seed(6)
    text = " ".join(random.choice(["alpha", "Béta", "gamma-delta", "12", "x"]) for _ in range(60_000))
    check(spark, [(1, text), (2, text[:5000])])


def test_coalesced():
    """Groups break where a start reaches the running maximum, whatever the overlaps inside."""
    a, b = [(0, 3), (3, 6), (6, 7), (7, 9)], [(0, 2), (2, 5), (5, 6), (6, 9)]
    both = np.array(a + b)
    order, group = coalesced(both[:, 0], both[:, 1], np.array([0] * 4 + [1] * 4))
    assert group.tolist() == [0] * 5 + [1] * 3 and order.tolist() == [0, 1, 4, 5, 6, 2, 3, 7]
