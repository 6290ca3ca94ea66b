"""Which lines are formulas, and why the others aren't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X

#: Signs of formulas; a line has one of either list.
FIRST = (
    r"(?i)[=∑∫∇∂κτφγ′″√⟨〉→⇒⇔≤≥×]|\\sum|\\int|\\propto|∝|\\\(|\$|\\frac|\\mathbb\{P\}|\\mathbb\{E\}|\\partial|\\nabla|\\times|\\langle|\\argmin|\\sup|\\inf|M\^|p\^\*|p_n|p\?\(|K\(|\bsum\b|\bmin\b|\blog\b|\bexp\b|\balpha\b|q\(|\bmod\b|\bPhi\b|\bN\(|\bGamma\b|\bUnif\b|\bPois\b|\bint\b|\bE\{|\bE\[|\bVar\b|\bcov\b|\bdet\b|\\mathrm\{tr\}|\\operatorname\{tr\}|d\s*/\s*d\s*t|/\s*d\s*t"
)
SECOND = (
    r"(?i)[=]|\\sum|\\int|∑|∫|∝|∇|∂|κ|τ|φ|→|⇒|⇔|≤|≥|×|\\\\propto|conditional|\\mathbb\{P\}|\\mathbb\{E\}|M_\{|M\^|p_n|p\^\*|p\?\(|K\(|q\(|\bP\(|\br\(x|\bMij\b|\bx_\{|u_n|F_X|lambda|Sigma|sqrt|∏|prop(?:ortional)?|Bayes|det|tr|⟨|〉|\|\s*\|"
)
#: Shapes of lines that aren't formulas, and the signs that speak for long ones.
CONTINUED, DOTS, DECIMALS = r"^[=≤≥<>+\-]", r"\.{4,}", r"(?:^|\s)[0-9]+\.[0-9]+(?:\s+[0-9]+\.[0-9]+){2,}"
MATRIX_ROW, STEP, PROSE = r"^[A-Za-z][\w−-]*\s*=\s*[0-9]+(\s+[0-9]+(\.[0-9]+)?){2,}$", r"^[0-9]+\s*:\s+", r"^[A-Z]?[a-z]+(?:\s+[a-z]+){5,}"
FIVE_WORDS, KNOWN = r"[A-Za-z]{2,}\s+[A-Za-z]{2,}\s+[A-Za-z]{2,}\s+[A-Za-z]{2,}\s+[A-Za-z]{2,}", r"(?i)\b(p\?\(|p\^\*|∫|∝|F_X|Sigma|det\s*J|mod\b)"
DENSE, SPANS = "[=∑∫∝<>≥≤_^|∇∂κτφ′″]", "[=∑∫∝<>≥≤_^|]"


def rejection(line: Column) -> Column:
    """Why a trimmed line isn't a formula, the first reason in a fixed order; null if it is one."""
    n, words = F.length(line), X.count_of(line, r"\S+")
    density = X.count_of(line, DENSE) / F.greatest(F.lit(1), words)
    after = F.regexp_extract(line, r"(?s)^[^=]*=(.*)$", 1)
    reasons = [
        ("length", ~n.between(6, 500)), ("no_sign", ~line.rlike(FIRST)), ("no_second_sign", ~line.rlike(SECOND)), ("continuation", line.rlike(CONTINUED)), ("run_of_dots", line.rlike(DOTS)), ("many_dots", X.count_of(line, r"\.{2,}") >= 3),
        ("numbers_only", (after != "") & (F.length(F.regexp_replace(after, r"[\s.0-9·,]", "")) == 0)), ("row_of_decimals", line.rlike(DECIMALS)), ("matrix_row", line.rlike(MATRIX_ROW)), ("step", line.rlike(STEP)),
        ("sparse", (words > 18) & (density < 0.12)), ("rather_sparse", (words > 14) & (density < 0.18) & ~line.rlike(KNOWN)), ("prose", F.length(F.regexp_extract(line, PROSE, 0)) / F.greatest(n, F.lit(1)) > 0.55), ("reference", line.rlike(FIVE_WORDS) & (words > 10) & (X.count_of(line, SPANS) < 2)),
    ]
    return F.nullif(X.first_match([(name, F.coalesce(c, F.lit(False))) for name, c in reasons], ""), F.lit(""))


def judged_lines(lines: DataFrame) -> DataFrame:
    """lines that aren't blank, trimmed, with rejection."""
    return lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("rejection", rejection(F.col("line")))
