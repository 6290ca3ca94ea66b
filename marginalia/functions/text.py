"""Scalar text expressions: columns in, columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles of study files with the weight of their evidence, in order of the role number.
ROLES = [("lecture_notes", 1), ("exam_guidance", 4), ("past_paper", 5), ("problem_sheet", 3), ("solution_sheet", 3), ("formula_sheet", 2), ("mark_scheme", 4), ("other", 1)]

#: Two words of four characters or more, a to z and hyphens, side by side. The class's characters are named one by one, as Java looks such a class up
#: in a table, but asks each range of a class of ranges; what can't match when given back is possessive.
WORD_PAIR = r"\b[a-z]{0}{{3,}}+\s++[a-z]{0}{{3,}}\b".format("[abcdefghijklmnopqrstuvwxyz-]")


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ascii_fold(c: Column) -> Column:
    """Every character beyond ASCII becomes |, so that word borders are ASCII's; lengths stay."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "|")


def sanitise(c: Column) -> Column:
    """Without control characters (line feed, carriage return and tab stay) and soft hyphens."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F­]", "")


def key_text(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def cap(c: Column, n: int) -> Column:
    """Text cut to n characters with three dots after it, if it is longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def repair(c: Column) -> Column:
    """Ligatures, dashes, words broken by a hyphen at a line's end, and runs of blank lines."""
    for old, new in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("[‐‑–—]", "-"), ("\r\n?", "\n"), (r"([a-z])-\n([a-z])", "$1$2"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, old, new)
    return c


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def layer(line: Column) -> Column:
    """blank, noise, handwritten or printed, by the shape of a line without white space at its ends."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    n = F.length(t)
    noise = t.rlike(r"(?i)\bfii+i+n\.?to\b|\bDopulation\b") | ((n <= 2) & t.rlike("^[A-Za-z0-9]$")) | t.rlike(r"^[A-Za-z]{1,3}\.{2,}") | ((n < 50) & (count_of(t, "[A-Za-z0-9]") / F.greatest(n, F.lit(1)) < 0.35) & t.rlike(r"[^\sA-Za-z0-9.,;=+\-()\[\]{}]"))
    chaos = (count_of(t, "[0-9]") >= 4) & (count_of(t, "[A-Za-z]") >= 4) & t.rlike("[0-9][A-Za-z][0-9]") & (n < 90)
    hand = (n >= 6) & (n <= 140) & (t.rlike("[!?.]{3,}") | (count_of(t, "[a-z][A-Z]") >= 3) | chaos | t.rlike(r"\S{36,}"))
    return F.when(n == 0, "blank").when(noise, "noise").when(hand, "handwritten").otherwise("printed")


def layer_confidence(kind: Column) -> Column:
    return F.when(kind == "printed", 0.88).when(kind == "handwritten", 0.52).when(kind == "noise", 0.35)


def quality_grade(chars: Column, warnings: Column | None = None, errors: Column | None = None) -> Column:
    """failed, low, medium or high by the number of characters, warnings and errors."""
    warned, wrong = (F.lit(0) if c is None else F.coalesce(c, F.lit(0)) for c in (warnings, errors))
    n = F.coalesce(chars, F.lit(0))
    return F.when((wrong > 0) | (n == 0), "failed").when((n < 250) | (warned >= 3), "low").when((n < 1500) | (warned >= 1), "medium").otherwise("high")


def page_quality(chars: Column, low: int = 80, medium: int = 300) -> Column:
    return F.when(chars < low, "low").when(chars < medium, "medium").otherwise("high")


def role_of_source(source: Column) -> Column:
    """The role of a source by its number: srcN has the role N mod 8; other names are 'other'."""
    number = F.regexp_extract(source, r"^src([0-9]+)$", 1)
    return F.coalesce(F.get(F.array(*[F.lit(r) for r, _ in ROLES]), F.pmod(number.try_cast("int"), F.lit(len(ROLES)))), F.lit("other"))


def role_weight(role: Column) -> Column:
    return reduce(lambda c, rw: c.when(role == rw[0], rw[1]), ROLES[1:], F.when(role == ROLES[0][0], ROLES[0][1])).otherwise(1)


#: Words of a file's name that tell its role, first match wins.
FILE_ROLES = [
    ("lecture_notes", r"\b(chapter|notes?|lecture|lectures?)\b"),
    ("exam_guidance", r"\b(format|guidance|syllabus)\b"),
    ("mark_scheme", r"\b(mark scheme|marking scheme|marks? scheme)\b"),
    ("past_paper", r"\b(past|paper|exam|mock)\b"),
    ("problem_sheet", r"\b(problem sheet|problems?|worksheet|exercise sheet|ps)\b"),
    ("solution_sheet", r"\b(solution|solutions|answers?|answer)\b"),
    ("formula_sheet", r"\b(formula sheet|formulae|formulas)\b"),
]


def role_of_name(name: Column) -> Column:
    n = F.regexp_replace(F.lower(name), "[_-]+", " ")
    return reduce(lambda c, rp: c.when(n.rlike(rp[1]), rp[0]), FILE_ROLES[1:], F.when(n.rlike(FILE_ROLES[0][1]), FILE_ROLES[0][0])).otherwise("other")


def half_up(c: Column) -> Column:
    """The nearest whole number, halves upwards, also below zero."""
    return F.floor(c + 0.5)


def role_counts(role: Column) -> Column:
    """An aggregate: a map of each role to its number of rows, roles without rows at 0."""
    return F.map_from_arrays(F.array(*[F.lit(r) for r, _ in ROLES]), F.array(*[F.count_if(role == r) for r, _ in ROLES]))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "-")


def token_set(c: Column, longer_than: int = 2) -> Column:
    """Distinct words of key_text with more than so many characters."""
    return F.array_distinct(F.filter(F.split(key_text(c), " "), lambda w: F.length(w) > longer_than))


def first_match(rules: list[tuple[str, Column]], other: str) -> Column:
    """The name of the first rule that holds: one when-chain."""
    out = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(holds, name)
    return out.otherwise(other)
