"""The standard rules, the fold against a loop, and rules that see what others left."""

import re

import pytest

from marginalia.operators import rewriting

DOCS = "doc_id long, text string, hits string"


def apply(spark, texts, rules=None):
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], DOCS)
    docs = docs.withColumn("profile", rewriting.profile_of(docs.text))
    return rewriting.rewritten(docs, rewriting.rules_table(spark, rules if rules is not None else rewriting.standard_rules()))


def test_standard_rules(spark):
    texts = [
        "A welldefined statespace and a STATESPACE; dis tribution of Xi and \\(Xi\\) with sigma", "ARMA(p,q) and Xt = φ Xt-1 + εt, also Xt in an arima model", "importance sampling: ϕˆ N_SNIS, with ESS N, wi and Ep? over O(1/√N)",
        "kriging of x in R, R d", None, "", "no rule here", "an open \\( mark with Xi", "\\sigma stays",
    ]
    got = {r.doc_id: r for r in apply(spark, texts).collect()}
    assert got[0].text == "A well-defined state-space and a state-space; distribution of \\(X_i\\) and \\(Xi\\) with \\sigma"
    assert {(h.rule, h.hits) for h in got[0].hits} == {("glued_welldefined", 1), ("glued_statespace", 2), ("distribution", 1), ("indexed_Xi", 1), ("letter_sigma", 1)}
    assert got[1].text == "\\(\\operatorname{ARMA}(p,q)\\) and \\(X_t=\\phi X_{t-1}+\\varepsilon_t\\), also \\(X_t\\) in an arima model" and got[1].profile == "time_series"
    assert got[2].text == "importance sampling: \\(\\hat{\\phi}^{N}_{\\mathrm{SNIS}}\\), with \\(\\mathrm{ESS}_N\\), \\(w_i\\) and \\(\\mathbb{E}_{p^\\star}\\) over \\(O(1/\\sqrt N)\\)"
    assert got[3].text == "kriging of \\(x\\in\\mathbb{R}\\), \\mathbb{R}^d" and got[3].profile == "spatial_statistics"
    assert [(got[k].text, got[k].hits) for k in (4, 5, 6)] == [(None, []), ("", []), ("no rule here", [])]
    assert got[7].text == "an open \\( mark with \\(X_i\\)" and got[8].text == "\\sigma stays"


def test_fold_equals_loop(spark):
    rules = [(0, "a", None, "a+", "b", False), (1, "b", None, "bb", "<$0>", False), (2, "c", "generic", r"<(b)b>", "$1", True), (3, "d", "time_series", "b", "X", False), (4, "e", None, "(?m)^x", "y", True)]
    texts = ["aab baab bb", "xa\nxb", "arima aa bb", "\\(bb\\) abb", "x" * 5000 + "aa" * 2000]
    got = {r.doc_id: r for r in apply(spark, texts, rules).collect()}
    for k, t in enumerate(texts):
        profile = "time_series" if "arima" in t else "generic"
        hits = {}
        for _, name, of, pattern, new, outside in rules:
            if of in (None, profile):
                new = re.sub(r"\$(\d)", r"\\g<\1>", new)
                parts = re.findall(rewriting.MATH, t) if outside else [t]
                n = 0
                for j, p in enumerate(parts):
                    if not (outside and p.startswith("\\(") and p.endswith("\\)")):
                        parts[j], m = re.subn(pattern, new, p)
                        n += m
                t = "".join(parts)
                hits.update({name: n} if n else {})
        assert (got[k].text, {h.rule: h.hits for h in got[k].hits}) == (t, hits)
    assert sorted((r.doc_id, r.rule) for r in rewriting.rule_hits(apply(spark, texts[:1], rules)).collect()) == [(0, "a"), (0, "b"), (0, "c")]


def test_no_rows_and_too_many_rules(spark):
    assert apply(spark, []).collect() == [] and apply(spark, ["a"], []).first().text == "a"
    with pytest.raises(ValueError):
        rewriting.rules_table(spark, [(k, "r", None, "a", "b", False) for k in range(501)])
