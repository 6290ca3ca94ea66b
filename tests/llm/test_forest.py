"""The forest's cuts and key blocks of any length."""

import warnings

import numpy as np

from marginalia.llm import secret_forest
from marginalia.llm.secret_forest import Forest


def leaves(node):
    return [node] if isinstance(node, float) else leaves(node[2]) + leaves(node[3])


def test_cuts_between_neighbouring_numbers():
    """Values one double apart part a node without an empty side; every leaf and score is finite."""
    rng = np.random.default_rng(1)
    low = rng.random((400, 4))
    x = np.concatenate([low, np.nextafter(low, 2), low[:, ::-1]])
    y = (np.arange(len(x)) % 3 == 0).astype(int)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        forest = Forest(x, y)
    assert all(np.isfinite(leaves(t)).all() for t in forest.trees) and np.isfinite(forest.probability(rng.random((500, 4)))).all()


def test_flat_lexicon_and_empty_windows():
    """What an empty table gives: no leaf is undefined, ties in all features keep a share of both labels."""
    lex = secret_forest.Lexicon(np.zeros(16, np.uint64), np.log(np.full((26, 26), 1 / 26)))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        forest = Forest(*secret_forest.labelled([("", None)] * 1000, lex))
    x, y = secret_forest.labelled([("", None)] * 2000, lex, seed=5)
    scores = forest.probability(x)
    assert np.isfinite(scores).all() and (scores[y == 1] >= 0.5).mean() > 0.85
    same = Forest(np.ones((40, 3)), np.arange(40) % 2)
    assert 0.2 < same.probability(np.ones((1, 3)))[0] < 0.8


def test_key_blocks_of_any_length():
    lex = secret_forest.Lexicon(np.zeros(16, np.uint64), np.log(np.full((26, 26), 1 / 26)))
    for n in (20, 13_000, 400_000):
        block = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(["MIIEow9Xk2" * 6] * (n // 61 + 1)) + "\n-----END RSA PRIVATE KEY-----"
        found = secret_forest.findings(f"before {block} after", None, lex)
        assert [(f.start, f.end) for f in found] == [(7, 7 + len(block))]
    open_ = "-----BEGIN RSA PRIVATE KEY-----\n" * 3000  # never ended: linear
    assert secret_forest.findings(open_, None, lex) is not None
