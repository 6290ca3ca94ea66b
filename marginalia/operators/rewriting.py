"""Ordered rewrite rules on texts, chosen by subject profile, with the hits of each rule in each document.

Rules are rows of a table of bounded size that goes to every task; a fold over them changes a text and carries
its hits, so that the plan is the same whatever the number of rules. A rule may spare what is inline mathematics already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that extraction glues together, and what they are.
GLUED = [
    ("selfnormalised", "self-normalised"), ("selfnormalized", "self-normalized"), ("welldefined", "well-defined"), ("acceptreject", "accept-reject"), ("logdomain", "log-domain"),
    ("logtrick", "log-trick"), ("statespace", "state-space"), ("samplingbased", "sampling-based"), ("priorlikelihood", "prior-likelihood"),
]
#: Words that extraction breaks apart.
BROKEN = [("multi_word", r"(?i)\bmulti\s*variate\b", "multivariate"), ("distribution", r"(?i)\bdis\s*tribution\b", "distribution"), ("semi_word", r"(?i)\bsemi\s*variogram\b", "semi-variogram"), ("gaussian", r"(?i)\bGaus\s*sian\b", "Gaussian")]
#: Variables with an index that stand without a mark for it, and named letters, outside inline mathematics.
INDEXED = ["Xi", "Xj", "Xt", "Xs", "X1", "Xn", "t1", "tn", "x1", "xn"]
LETTERS = ["mu", "rho", "sigma", "gamma"]
SPACES = [(r"\bR\s+d\b", r"\mathbb{R}^d"), (r"\bR\s+n\b", r"\mathbb{R}^n"), (r"\bt\s+in\s+T\b", r"\(t\in T\)"), (r"(?i)\bx\s+in\s+R\b", r"\(x\in\mathbb{R}\)")]
#: Subject profiles by their words, first match wins, and the rules of two of them.
PROFILES = [
    ("monte_carlo_sampling", r"\b(monte carlo|mcmc|markov chain monte|metropolis|gibbs|importance sampling|self[-\s]?normalised|self[-\s]?normalized|proposal distribution|importance weights?|snis|mc estimator|is estimator)\b"),
    ("time_series", r"\b(arima|arma|ar\(|ma\(|autocovariance|autocorrelation|periodogram|spectral density|ljung-box|stationarity)\b"),
    ("spatial_statistics", r"\b(semivariogram|kriging|spatial|random field|covariance function)\b"), ("financial_math", r"\b(option|portfolio|volatility|black-scholes|martingale)\b"),
]
TIME_SERIES = [
    (r"(?i)\bcov\{Xt,\s*Xt\+ω\}", r"\(\operatorname{cov}(X_t,X_{t+\omega})\)"), (r"\bE\{Xt\}", r"\(\mathbb{E}\{X_t\}\)"), (r"(?i)\bvar\{Xt\}", r"\(\operatorname{var}(X_t)\)"), (r"\bXt\s*=\s*φ\s*Xt-1\s*\+\s*εt", r"\(X_t=\phi X_{t-1}+\varepsilon_t\)"),
    (r"\bΦ\(B\)\s*Xt\s*=\s*Θ\(B\)\s*εt", r"\(\Phi(B)X_t=\Theta(B)\varepsilon_t\)"), (r"\bMA\(q\)", r"\(\operatorname{MA}(q)\)"), (r"\bAR\(p\)", r"\(\operatorname{AR}(p)\)"), (r"\bARMA\(p,q\)", r"\(\operatorname{ARMA}(p,q)\)"), (r"\bARIMA\(p,d,q\)", r"\(\operatorname{ARIMA}(p,d,q)\)"),
]
MONTE_CARLO = [
    (r"ϕˆ\s*_?\s*N\s*_\s*\{?\s*(MC|IS|SNIS)\s*\}?", r"\(\hat{\phi}^{N}_{\mathrm{$1}}\)"), (r"(?i)\bESS\s*_?\s*N\b", r"\(\mathrm{ESS}_N\)"), (r"\bEp\?", r"\(\mathbb{E}_{p^\star}\)"), (r"\bEq\b", r"\(\mathbb{E}_q\)"), (r"(?i)\bvarp\?", r"\(\operatorname{Var}_{p^\star}\)"),
    (r"(?i)\bvarq\b", r"\(\operatorname{var}_q\)"), (r"\bwi\b", r"\(w_i\)"), (r"\bWi\b", r"\(W_i\)"), (r"\bN\s+i\s*=\s*1\b", r"\(\sum_{i=1}^N\)"), (r"\bO\s*\(\s*1\s*/\s*√\s*N\s*\)", r"\(O(1/\sqrt N)\)"),
]
MOST_RULES = 500
MATH = r"(?s)\\\(.*?\\\)|(?:(?!\\\().)+|."  # inline mathematics, what lies between, and an opening mark without an end

RULES = "position int, rule string, profile string, pattern string, replacement string, outside boolean"


def standard_rules() -> list[tuple[int, str, str | None, str, str, bool]]:
    """position, name, profile (None: every text), pattern, replacement ($1: a group), and whether inline mathematics is spared."""
    literal = lambda t: t.replace("\\", r"\\")
    rows = [(f"glued_{a}", None, rf"(?i)\b{a}\b", b, False) for a, b in GLUED] + [(n, None, p, r, False) for n, p, r in BROKEN]
    rows += [(f"indexed_{v}", None, rf"\b{v}\b", literal(rf"\({v[0]}_{v[1]}\)"), True) for v in INDEXED] + [(f"letter_{v}", None, rf"(?i)(?<!\\)\b{v}\b", literal(rf"\{v}"), True) for v in LETTERS]
    rows += [(f"space_{k}", None, p, literal(r), True) for k, (p, r) in enumerate(SPACES)]
    rows += [(f"{profile}_{k}", profile, p, literal(r), True) for profile, rules in (("time_series", TIME_SERIES), ("monte_carlo_sampling", MONTE_CARLO)) for k, (p, r) in enumerate(rules)]
    first = [r for r in rows if r[1]]  # a profile's rules see the variables as extracted
    return [(k, *r) for k, r in enumerate([*rows[: len(GLUED) + len(BROKEN)], *first, *[r for r in rows[len(GLUED) + len(BROKEN) :] if not r[1]]])]


def profile_of(text: Column, profiles: list[tuple[str, str]] = PROFILES) -> Column:
    """The first profile whose words the text has, else generic."""
    low = F.lower(text)
    out = F.when(low.rlike(profiles[0][1]), profiles[0][0])
    for name, pattern in profiles[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("generic")


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """rules as a table (RULES); more than MOST_RULES are an error, as they go to every task."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return spark.createDataFrame(rules, RULES)


def rewritten(documents: DataFrame, rules: DataFrame, text: str = "text", profile: str = "profile") -> DataFrame:
    """documents with text rewritten and hits: an array of (rule, hits) of those that had any.

    rules (RULES, at most MOST_RULES) with documents' profile, or none, are applied in order, each to what the one before left. A
    null text stays null without hits. Columns named hits are replaced.
    """
    row = F.struct("position", "rule", "profile", "pattern", "replacement", "outside")
    table = rules.agg(F.array_sort(F.collect_list(row)).alias("_rules"), F.count("*").alias("_n")).select(F.when(F.col("_n") <= MOST_RULES, F.col("_rules")).otherwise(F.raise_error(F.lit(f"more than {MOST_RULES} rules"))).alias("_rules"))
    # the rules of a document go through an explode, so that they are chosen once for each
    mine = F.filter("_rules", lambda r: r["profile"].isNull() | (r["profile"] == F.col(profile)))
    ready = documents.drop("hits").crossJoin(F.broadcast(table)).withColumn("_mine", F.explode_outer(F.array(mine))).drop("_rules")
    empty = F.array().cast("array<struct<rule: string, hits: int>>")

    def step(acc, r):
        parts = F.regexp_extract_all(acc["text"], F.lit(MATH), F.lit(0))
        math = lambda p: p.startswith(F.lit("\\(")) & p.endswith(F.lit("\\)"))
        spared = F.array_join(F.transform(parts, lambda p: F.when(math(p), p).otherwise(F.regexp_replace(p, r["pattern"], r["replacement"]))), "")
        among = F.aggregate(F.transform(parts, lambda p: F.when(math(p), F.lit(0)).otherwise(F.regexp_count(p, r["pattern"]))), F.lit(0), lambda a, b: a + b)
        hits = F.when(r["outside"], among).otherwise(F.regexp_count(acc["text"], r["pattern"]))
        new = F.when(hits == 0, acc["text"]).when(r["outside"], spared).otherwise(F.regexp_replace(acc["text"], r["pattern"], r["replacement"]))
        return F.struct(new.alias("text"), F.when(hits > 0, F.concat(acc["hits"], F.array(F.struct(r["rule"].alias("rule"), hits.alias("hits"))))).otherwise(acc["hits"]).alias("hits"))

    folded = F.when(F.col(text).isNotNull(), F.aggregate("_mine", F.struct(F.col(text).alias("text"), empty.alias("hits")), step))
    # and so does the result, which two columns use
    out = ready.withColumn("_f", F.explode_outer(F.array(folded)))
    return out.select(*[F.col("_f.text").alias(text) if c == text else F.col(c) for c in documents.columns if c != "hits"], F.coalesce(F.col("_f.hits"), empty).alias("hits"))


def rule_hits(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, rule, hits of rewritten documents."""
    return documents.select(key, F.explode_outer("hits").alias("h")).where("h is not null").select(key, "h.rule", F.col("h.hits").cast("long").alias("hits"))
