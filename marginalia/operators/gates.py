"""Gates: ordered rules decide on every row and say why; nothing disappears unexplained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(rows: DataFrame, rules: list[tuple[Column, str, str]], decision: str = "keep", reason: str = "passed") -> DataFrame:
    """rows with decision, reason of the first rule (holds, decision, reason) and reasons: those of all that hold."""
    d, r = F.lit(decision), F.lit(reason)
    for holds, then, why in reversed(rules):
        d, r = F.when(holds, then).otherwise(d), F.when(holds, why).otherwise(r)
    return rows.withColumns({"decision": d, "reason": r, "reasons": F.array_compact(F.array(*[F.when(holds, why) for holds, _, why in rules]))})


def report(gated: DataFrame, *by: str) -> DataFrame:
    """Rows and shares of decisions and reasons."""
    counts = gated.groupBy(*by, "decision", "reason").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()), 6))  # a row for each decision and reason


def acceptance(pack: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """test, passed: a one-row table's booleans as rows."""
    named = pack.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()])
    return named.select(F.expr(f"stack({len(tests)}, " + ", ".join(f"'{n}', `{n}`" for n in tests) + ") as (test, passed)"))


def adaptive_least(pages: Column) -> Column:
    """How many items a pack of so many pages should have."""
    return F.when(pages < 15, 8).when(pages <= 50, 15).otherwise(25)


def verdict(tests: DataFrame, critical: tuple[str, ...], relaxed: float = 0.7) -> DataFrame:
    """level: strict if all passed, relaxed if the critical ones and enough of the others did, else failed."""
    ok = F.bool_and(F.col("passed") | ~F.col("test").isin(*critical))
    return tests.agg(F.when(F.bool_and("passed"), "strict").when(ok & (F.avg(F.col("passed").cast("int")) >= relaxed), "relaxed").otherwise("failed").alias("level"))


def health(stages: DataFrame) -> DataFrame:
    """healthy, failed: all stages(stage, passed, position) passed; else the names of those that didn't, in order."""
    bad = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("position", "stage")))), lambda s: s["stage"]), ",")
    return stages.agg(F.every("passed").alias("healthy"), bad.alias("failed"))
