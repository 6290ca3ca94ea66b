"""Each reason to reject a line, in order."""

from marginalia.operators import formulas

CASES = {
    "length": "a = b", "no_sign": "a plain line of words", "no_second_sign": "the log of it all", "continuation": "= x^2 + y^2 here", "run_of_dots": "M = ........ of it", "many_dots": "M = a .. b .. c .. d", "numbers_only": "M = 0.5 1, 2", "row_of_decimals": "x = y 0.1 0.2 0.3 z",
    "matrix_row": "Xt = 1 2 3", "step": "2: for n = 1 to N", "sparse": "we take it that x = y holds for all of the words in this line which go on and on here", "rather_sparse": "it is so that x = y holds for all a b c d e", "prose": "this holds for any of the x = y", "reference": "A b cc dd ee ff gg, then hh ii jj K = z",
}


def test_reasons(spark):
    good = ["Var(X) = E[X^2] - E[X]^2", "p_n = p_{n-1} M", "\\sum_{j} M_{ij} = n", "dX/dt = - grad V(X)"]
    rows = [(k, t) for k, t in enumerate([*CASES.values(), *good, "", "   "])]
    got = {r.id: r.rejection for r in formulas.judged_lines(spark.createDataFrame(rows, "id long, line string")).collect()}
    want = {k: name for k, name in enumerate(CASES)} | {len(CASES) + k: None for k in range(len(good))}
    want[list(CASES).index("matrix_row")] = "numbers_only"  # what follows its sign is numbers: the earlier reason holds
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)
