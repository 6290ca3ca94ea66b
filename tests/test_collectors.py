"""Nine types of raw candidates on own pages, and the folds against plain loops."""

import random
import re

from marginalia.operators import collectors

LINES = "doc_id long, page int, line_index int, line string"
PAGE = """Definition 2.1 A random field is a family of random vectors.
It is indexed by a set.
Theorem 2.2 (Kolmogorov) Let X be consistent.
Hence a field exists with the given law.
Proof. We have X = Y by the lemma.
Therefore the claim follows for all of them.
Lemma 2.3 Without any proof of it
observe that a = b
hence b = c
thus the claim holds = d
Algorithm 3.1 Draw a sample of the proposal
and weigh it by the density of the target.
Example 4.1 Take a fair coin
and toss it twice.
Solution. There are four outcomes
of which one has two heads.
it is a quarter
Exercise 4.2. Show the same for a die thrown twice
Example 4.3 has no solution at all here
Remark on it. We define the mean as usual in what follows.
Throughout this chapter all of the variables are real.
E[X] = mu where the model is known
= sum of x p(x)
plain words follow here
Worked example of a longer kind
1234 = 5678 + 91011 - 12
Question 7. Is it really so
Solution. Yes it is"""


def table(spark, *pages):
    rows = [(0, p, k, t) for p, page in enumerate(pages, 1) for k, t in enumerate(page.split("\n"))]
    return spark.createDataFrame(rows, LINES)


def test_nine_types(spark):
    got = collectors.raw_candidates(table(spark, PAGE)).collect()
    by = {}
    for r in got:
        by.setdefault((r.type, r.reason), []).append(r)
    assert {k: sorted(r.first_line for r in v) for k, v in by.items()} == {
        ("definition", "definition_labelled_block"): [0], ("theorem", "theorem_like_labelled_block"): [2, 6], ("proof", "block_starting_with_proof_or_example_marker"): [4], ("worked_example", "block_starting_with_proof_or_example_marker"): [12, 18, 24],
        ("proof", "theorem_or_lemma_then_proof_block"): [2], ("proof", "theorem_or_lemma_then_reasoning_chain"): [6], ("method_template", "algorithm_block"): [10], ("worked_example", "example_or_exercise_then_solution"): [26], ("exercise", "exercise_problem_question_stem_block"): [17, 26],
        ("formula", "formula_like_printed_line"): [4, 7, 21, 25], ("concept", "informal_definition_or_recall_line"): [19, 20],
    }
    pair = by["worked_example", "example_or_exercise_then_solution"][0]
    assert pair.last_line == 27 and pair.text == "Question 7. Is it really so\nSolution. Yes it is"  # the pair of line 12 is the block of its example already
    assert {r.first_line: r.last_line for r in collectors.example_solutions(table(spark, PAGE)).collect()} == {12: 16, 26: 27}
    formulas = {r.first_line: (r.last_line, r.formula_kind, r.confidence, r.cleanup) for r in by["formula", "formula_like_printed_line"]}
    assert formulas == {4: (4, "raw_equation", 0.55, "ok"), 7: (9, "raw_equation", 0.78, "ok"), 21: (22, "raw_equation", 0.78, "ok"), 25: (25, "broken_math", 0.55, "needs_review")}
    assert collectors.raw_candidates(table(spark, PAGE).limit(0)).collect() == []


def plain_runs(lines):
    out, k = [], 0
    hit = lambda t: re.search(r"[=^_]", t)
    while k < len(lines):
        t = lines[k].strip()
        if not 8 <= len(t) <= 500 or not hit(t) or t[0] in "=≤≥<>":
            k += 1
            continue
        end = k + 1
        while end < len(lines) and end < k + 8:
            u = lines[end].strip()
            if not u or not (hit(u) or u[0] in "=+-") or len(u) > 500:
                break
            end += 1
        out.append((k, end - 1, "\n".join(x.strip() for x in lines[k:end])))
        k = end
    return out


def test_formula_runs(spark):
    random.seed(5)
    pages = ["\n".join(random.choice(["", "words of it", "a long = line", "= short", "+ more", "x_1", "another^2 line", " - y"]) for _ in range(60)) for _ in range(20)] + ["\n".join(["a long = line"] * 30), "= " + "x" * 600]
    got = {}
    for r in collectors.formula_runs(table(spark, *pages), "[=^_]").collect():
        got.setdefault(r.page, []).append((r.first_line, r.last_line, r.text))
    assert {p: sorted(v) for p, v in got.items()} == {p: plain_runs(t.split("\n")) for p, t in enumerate(pages, 1) if plain_runs(t.split("\n"))}


def plain_pairs(lines):
    out, i = [], 0
    on = lambda p, t: re.search(p, t)
    while i < len(lines):
        if not on(collectors.EXAMPLE, lines[i]):
            i += 1
            continue
        sol = -1
        for j in range(i + 1, min(len(lines), i + 40)):
            if on(collectors.NO_PAIR, lines[j]) or on(collectors.EXAMPLE, lines[j]):
                break
            if on(collectors.SOLUTION, lines[j]):
                sol = j
                break
        if sol < 0:
            i += 1
            continue
        end = i
        for k in range(i, min(len(lines), sol + 50)):
            if k > sol + 2 and on(collectors.BOUNDARY, lines[k]):
                break
            end = k
        out.append((i, end))
        i = end + 1
    return out


def test_example_solutions(spark):
    random.seed(6)
    choice = ["words", "words", "words", "Example 1 one", "Question 2", "Solution: so", "Theorem of it", "Proof.", "3 Heading here", "more = words", "Chapter 2"]
    pages = ["\n".join(random.choice(choice) for _ in range(120)) for _ in range(25)] + ["Example 1\n" + "w\n" * 39 + "Solution", "Example 1\n" + "w\n" * 37 + "Solution\n" + "w\n" * 80]
    got = {}
    for r in collectors.example_solutions(table(spark, *pages)).collect():
        got.setdefault(r.page, []).append((r.first_line, r.last_line))
    assert {p: sorted(v) for p, v in got.items()} == {p: plain_pairs(t.split("\n")) for p, t in enumerate(pages, 1) if plain_pairs(t.split("\n"))}
