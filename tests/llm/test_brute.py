"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bloom_langid, jump_shards, license_scan, parity_join, piece_codec, pq_neardup, secret_forest, string_kernel, suffix_dedup
from marginalia.llm.common import held_out
from marginalia.llm.induced_sort import suffix_blocks

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_induced_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60))).astype(np.uint8)
        order, value = np.concatenate(list(suffix_blocks(t, 12, budget=int(rng.integers(1, 50)))), 1)
        order, value = order[order < len(t)].tolist(), value[order < len(t)].tolist()
        b = t.tobytes()
        assert sorted(order) == list(range(len(b))) and [b[i : i + 12] for i in order] == sorted(b[i : i + 12] for i in order)
        shared = lambda x, y: len(os.path.commonprefix([b[x : x + 12], b[y : y + 12]]))
        assert value == [0] + [shared(x, y) for x, y in zip(order, order[1:], strict=False)]


def removed(docs, n):
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = [True] * n
            seen.add(b[p : p + n])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_is_exact(spark):
    rnd = random.Random(3)
    words = ["ab", "ba", "é", "xyz", "aaaaaaa", "q"]
    parts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(8)]
    docs = [(i, "".join(rnd.choice(parts)[rnd.randrange(30) :] for _ in range(rnd.randrange(1, 5)))) for i in range(60)]
    docs += [(100, "a" * 700), (101, "ab" * 300), (102, "a" * 99)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == removed(docs, 100)


def test_a_passage_of_very_many_documents_is_not_sorted_whole(spark, monkeypatch):
    rnd = random.Random(6)
    some = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage, docs = some(400), []
    for i in range(300):
        docs.append((i, some(rnd.randrange(60, 140)) + passage + some(rnd.randrange(60, 140))))
    docs += [docs[7], (300, docs[8][1][:250]), (301, docs[9][1][30:])]
    sizes, whole = [], suffix_dedup._sorted_repeats

    def watched(parts, *more):
        sizes.extend(r["n"] for r in parts.groupBy("key").agg(F.sum(F.length("part")).alias("n")).collect())
        return whole(parts, *more)

    monkeypatch.setattr(suffix_dedup, "_sorted_repeats", watched)
    dealt, found = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string"), 100, 10_000)
    got = suffix_dedup._apply(dealt.join(found, "doc_id", "left").select("doc_id", "text", "places"), 100).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == removed(set(docs), 100) and len(got) == 303
    assert max(sizes, default=0) <= 10_000


def test_keys_are_shuffled_once_for_their_nodes(spark, monkeypatch):
    plans, whole = [], parity_join._shared_blocks

    def watched(held):
        plans.append(held._jdf.queryExecution().optimizedPlan().toString())
        return whole(held)

    monkeypatch.setattr(parity_join, "_shared_blocks", watched)
    parity_join.similar_groups(spark.createDataFrame([(i, f"a b c d e f g h{i % 3}") for i in range(9)], "doc_id long, text string"), 3, 0.5)
    assert len(plans) == 1 and "Join" not in plans[0]


def test_jaccard_groups_are_exact(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(60)}" for _ in range(rnd.choice((6, 40, 150)))] for _ in range(12)]
    docs = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 1, 1, 2, 6))):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(200)}"
        docs.append((i, " ".join(w)))
    for width, num, den in ((3, 9, 10), (5, 4, 5)):
        sets = {i: {tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for i, t in docs}
        root = {i: i for i in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = parity_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), width, num / den).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jump_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64)
    before = jump_shards.jump(keys, 16)
    for n in range(17, 20):
        after = jump_shards.jump(keys, n)
        moved = after != before
        assert (after[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.01
        before = after

    def plain(key, n):  # the published algorithm, one key at a time
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    assert [plain(int(k), 16) for k in keys[:300]] == jump_shards.jump(keys[:300], 16).tolist()


def test_pieces_equal_the_library():
    import sentencepiece

    lib, enc = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL), piece_codec.Encoder(piece_codec.load(), memory=50)
    texts = ["  Hello   world\n\tñ 😀 ▁x <s> </s>", "", None, " ", "x" * 300 + " yz", "\0a\0 b", "日本語テキスト" * 30, "   ", "http://aa.bb/ccc?ddd=eeee#" * 10, "def f(x):\n        return x"]
    for _ in range(2):
        tokens, begin = enc.encode(pa.array(texts, pa.string()))
        assert [tokens[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == lib.encode([t or "" for t in texts])


def test_quantised_links_reach_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + rng.normal(size=(25, 32)) * s for c, s in zip(centres, np.linspace(0.05, 0.5, 40), strict=True)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in pq_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64, chunk=128).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()


@needs_data
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = bloom_langid.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()


def test_toxic_words_are_found_disguised():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["the", "er", "on", "ti", "sha", "wo", "re", "lin"]) for _ in range(rnd.randrange(1, 4)))
    bad = ["idiot", "stupid", "moron"]
    texts, toxic = [], []
    for k in range(240):
        w = [word() for _ in range(30)]
        if k % 3 == 0:
            w[rnd.randrange(30)] = rnd.choice(bad)
        texts.append(" ".join(w))
        toxic.append(k % 3 == 0)
    model = string_kernel.fit(texts, np.array(toxic))

    def score(t):
        raw, at, _ = string_kernel.fold([t])
        return model.probability(model.margins(raw, at)).max()

    assert all(score(t) >= 0.7 for t in ("an idiot on", "i.d.i.o.t", "s t u p i d", "1d10t", "m0ron"))
    assert all(score(t) < 0.7 for t in ("there on shati", "the er", "wolin"))


def kernel(a, b):
    """The subsequence kernel of two coded words, by all places of three characters."""
    def features(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + string_kernel.SPAN)):
                    out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + string_kernel.DECAY ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_equals_brute_force():
    raw, at, _ = string_kernel.fold(["stupid s.t.u.p.i.d stxupxid banananana mississippi ab an internationalisation"])
    words = [tuple(raw[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    keys = np.unique(np.concatenate([key for _, key, _ in string_kernel.subsequences(raw, at)]))
    basis = np.zeros((len(words), len(keys)), np.float32)
    for wd, key, w in string_kernel.subsequences(raw, at):
        np.add.at(basis, (wd, np.searchsorted(keys, key)), w)
    want = np.array([[kernel(a, b) for b in words] for a in words])
    np.testing.assert_allclose(string_kernel.norms(raw, at) ** 2, np.maximum(want.diagonal(), 1e-9), rtol=1e-6)
    got = string_kernel._kernel(raw, at, keys, basis)
    np.testing.assert_allclose(got, want / np.sqrt(np.maximum(want.diagonal(), 1e-9))[:, None], rtol=1e-4, atol=1e-6)
    assert words[0] == words[1] and got[0, 2] > 0.5 > got[0, 4]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_held_out(spark):
    """Of the held-out labelled documents of sf0.1; about a quarter of those labelled toxic hold no insult that the others have."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = string_kernel.document_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.6 and n.get((0, 1), 0) / n[0, 0] <= 0.01


def test_filters_equal_sets():
    rng = np.random.default_rng(9)
    members = {f"l{k}": rng.integers(0, 2**63, 500).astype(np.uint64) for k in range(70)}
    filters = bloom_langid.BloomFilters(members, "l0")
    asked = np.concatenate([members["l3"][:100], members["l69"][:100], rng.integers(0, 2**63, 2000).astype(np.uint64)])
    mask = filters.languages(asked)
    for k, lang in enumerate(filters.langs):
        has = mask[k // 64] >> mask.dtype.type(k % 64) & mask.dtype.type(1) == 1
        assert has[np.isin(asked, members[lang])].all() and has[~np.isin(asked, members[lang])].mean() < 0.01
    score = filters.scores(asked, np.repeat([0, 1, 2], [100, 100, 2000]), 3)
    assert filters.langs[score[0].argmax()] == "l3" and filters.langs[score[1].argmax()] == "l69" and abs(score[0].max() - 100) < 1 and score[2].max() < 20


@pytest.mark.parametrize("width", [8, 64, 384])
def test_links_of_vectors_of_any_width(spark, width):
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(60, width))
    x = np.concatenate([c + rng.normal(size=(12, width)) * s for c, s in zip(centres, np.linspace(0.05, 0.6, 60), strict=True)])
    x[7], x[19] = x[6] * 2, x[18]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            break
        root = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_neardup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    links, found = near.sum(1) - 1, np.array([got[i][0] for i in range(len(x))])
    assert links.sum() > 500 and (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert np.mean([got[i][1] == root[i] for i in range(len(x))]) >= 0.9


def test_large_sets_are_joined_exactly(spark):
    rnd = random.Random(8)
    base = [[f"w{rnd.randrange(100_000)}" for _ in range(n)] for n in (2000, 3000, 5000)]
    docs, at = [], 0
    for w in base:
        for share in (0, 0.01, 0.02, 0.04, 0.05, 0.2):
            v = list(w)
            for _ in range(int(len(v) * share)):
                v[rnd.randrange(len(v))] = f"x{rnd.randrange(100_000)}"
            docs.append((at, " ".join(v)))
            at += 1
    for width, num, den in ((3, 9, 10), (5, 4, 5)):
        sets = {i: {tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for i, t in docs}
        root = {i: i for i in sets}
        for _ in range(4):
            for a in sets:
                for b in sets:
                    if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        got = parity_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), width, num / den).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == root and len(set(root.values())) < len(root)


def test_findings_held_out():
    """Findings of kinds and places drawn anew: few false ones, most secrets."""
    lex = secret_forest.Lexicon(np.zeros(16, np.uint64), np.log(np.full((26, 26), 1 / 26)))
    rnd = random.Random(1)
    place = lambda: " ".join("".join(rnd.choice("abcdefghiklmnorstu") for _ in range(rnd.randrange(3, 9))) for _ in range(40))
    x, y = secret_forest.labelled([(place(), None) for _ in range(1500)], lex)
    forest = secret_forest.Forest(x, y)
    x, y = secret_forest.labelled([(place(), "src/a.py") for _ in range(600)], lex, seed=99)
    said = forest.probability(x) >= 0.5
    assert (said & (y == 1)).sum() / said.sum() >= 0.93 and said[y == 1].mean() >= 0.93


@needs_data
def test_secrets_and_licences_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r["n_secrets"] for r in secret_forest.document_secrets(docs).collect()}
    planted = {i: sum(t.count(x) for x in ('token = "', "password=", "AKIA")) for i, t in texts.items()}
    assert found == planted
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {i: ",".join(sorted({n for line, n in lines.items() if line in t})) for i, t in texts.items()}
    assert {r["doc_id"]: r["licenses"] for r in license_scan.document_licenses(docs).collect()} == want


def test_held_out_follows_the_checksum(spark):
    got = spark.range(300).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_keys_are_shuffled_in_turns(spark, monkeypatch):
    """No turn has most of the sets or of the keys that several sets have, and none is lost: what is shuffled at once stays a part."""
    made, whole = [], parity_join.staged

    def watched(df, label):
        out = whole(df, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(parity_join, "staged", watched)
    texts = [" ".join(f"w{i % 40}_{k}" for k in range(60)) + f" x{i}" for i in range(200)]
    got = parity_join.similar_groups(spark.createDataFrame([*enumerate(texts), (500, texts[3])], "doc_id long, text string"), 3, 4 / 5)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 40 for i in range(200)} | {500: 3}
    for label, total in (("parity-first", 200), ("parity-shared", None)):
        rows = [n for name, n in made if name == label]
        assert len(rows) == parity_join.TURNS and max(rows) < 0.5 * sum(rows) and sum(rows) in (total or sum(rows),)
