"""Items: status tabs, filters, categories, membership, practice and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pack categories by the first type that matches.
CATEGORIES = [("mustKnowDefinitions", "definition"), ("coreTheorems", "theorem"), ("proofsToKnow", "proof"), ("keyFormulas", "formula")]


def tab_counts(items: DataFrame) -> DataFrame:
    """One row (checking: those that need review or are of low quality): how many items each status tab has; a missing decision means keep, deleted ones are only in their tab."""
    d, live = F.coalesce("decision", F.lit("keep")), ~F.coalesce("deleted", F.lit(False))
    asked, low = d.isin("review", "needs_review"), F.coalesce(F.col("grade") == "low", F.lit(False))
    tabs = {"kept": live & (d == "keep"), "checking": live & (asked | low), "needs_review": live & asked, "rejected": live & (d == "reject"), "low_quality": live & low, "deleted": ~live}
    return items.agg(*[F.count_if(c).alias(n) for n, c in tabs.items()])


def matching(items: DataFrame, search: str | None = None, equals: dict[str, str] | None = None, contains: dict[str, str] | None = None, any_tag: str | None = None) -> DataFrame:
    """Items whose text holds search (any case) and whose columns equal or contain the given values."""
    tests = [F.contains(F.lower("text"), F.lit(search.lower()))] if search else []
    tests += [F.col(c) == v for c, v in (equals or {}).items()]
    tests += [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (contains or {}).items()]
    tests += [F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(any_tag.lower())))] if any_tag else []
    return items.where(reduce(Column.__and__, tests)) if tests else items


def category(kind: Column) -> Column:
    return reduce(lambda c, n: c.when(kind == n[1], n[0]), CATEGORIES[1:], F.when(kind == CATEGORIES[0][1], CATEGORIES[0][0])).otherwise("other")


def memberships(items: DataFrame, lists: dict[str, Column], key: str = "item_id") -> DataFrame:
    """key, category: a row for each list that an item is in; lists may overlap."""
    return items.select(key, F.explode_outer(F.array_compact(F.array(*[F.when(c, n) for n, c in lists.items()]))).alias("category")).where("category is not null")


def top_by_signal(candidates: DataFrame, group: str, score: Column, order: str, most: int = 90) -> DataFrame:
    """The most best-scored candidates of each group, with their rank; ties: first in order."""
    w = Window.partitionBy(group).orderBy(F.desc("signal"), order)
    return candidates.withColumn("signal", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def round_robin(slots: DataFrame, choices: DataFrame) -> DataFrame:
    """slots(slot from 0) joined with choices(position from 0) in turn."""
    n = choices.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    return slots.crossJoin(F.broadcast(n)).withColumn("position", F.pmod("slot", "_n")).drop("_n").join(choices, "position")  # one row


def repeated_prompts(items: DataFrame, prompt: Column, least: int = 2) -> DataFrame:
    return items.groupBy(prompt.alias("prompt")).agg(F.count("*").alias("items"), F.min("item_id").alias("first_item")).where(F.col("items") >= least)


def merged_unique(parts: list[DataFrame], key: Column, order: list[str]) -> DataFrame:
    """The union of parts, one row for each key: the first in order."""
    every = reduce(DataFrame.unionByName, parts).withColumn("_key", key)
    return every.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_k = 1").drop("_key", "_k")


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do: an anti-join on the completed table."""
    return work.join(done.select(*keys), keys, "left_anti")


def job_progress(log: DataFrame) -> DataFrame:
    """job_id, stage, status, percent, completed, failed of a log(job_id, ts, stage, chunk, chunks, failed)."""
    #: Percent at the start of a stage.
    at = {"extracting_text": 5, "chunking": 22, "merging": 86, "exporting": 92, "completed": 100}
    last = log.groupBy("job_id").agg(F.max_by("stage", "ts").alias("stage"), F.max("chunk").alias("chunk"), F.max("chunks").alias("chunks"), F.count_if(F.col("failed")).alias("failed"), F.count_if(~F.col("failed") & F.col("chunk").isNotNull()).alias("completed"))
    share = F.floor(25 + 59 * F.coalesce(F.try_divide("chunk", "chunks"), F.lit(0)))
    percent = reduce(lambda c, s: c.when(F.col("stage") == s[0], s[1]), list(at.items())[1:], F.when(F.col("stage") == "extracting_text", 5)).otherwise(share).cast("int")
    return last.select("job_id", "stage", F.when(F.col("stage") == "completed", "completed").when(F.col("failed") > 0, "partial").otherwise("running").alias("status"), percent.alias("percent"), "completed", "failed")


def with_changes(items: DataFrame, log: DataFrame, key: str = "item_id") -> DataFrame:
    """items after a log(item_id, ts, change, title, text) of upsert, delete, restore, reject and purge: the last of each kind of change by time.

    An upsert sets title and text where it has them and adds items that weren't there; purged items are gone.
    """
    last = lambda *kinds: F.max(F.when(F.col("change").isin(*kinds), F.struct("ts", "change", "title", "text")))
    by = log.groupBy(key).agg(last("upsert").alias("u"), last("delete", "restore", "purge").alias("d"), last("reject", "upsert").alias("r"))
    both = items.join(by, key, "full")
    title, text = F.coalesce("u.title", "title"), F.coalesce("u.text", "text")
    gone, rejected = F.col("d.change") == "delete", F.col("r.change") == "reject"
    kept = both.where(~F.coalesce(F.col("d.change") == "purge", F.lit(False)))
    return kept.withColumns({"title": title, "text": text, "deleted": F.coalesce(gone, "deleted", F.lit(False)), "decision": F.when(rejected, "reject").otherwise(F.coalesce("decision", F.lit("keep")))}).drop("u", "d", "r")


#: Warnings that an item must be repaired for before it is reviewed.
REPAIRS = r"Over-merged|Source location is missing|Question prompt|Title is unusually long|unrelated section|multiple major label"


def reviewable(items: DataFrame, needs_review: bool = False, medium: bool = False, category_: str | None = None) -> DataFrame:
    """Items that may be reviewed: decided, of high priority unless medium, of the category, worth a card, short, required, and without a repair to do."""
    d = F.coalesce("decision", F.lit("keep"))
    rules = [~F.coalesce("deleted", F.lit(False)), d != "reject", F.coalesce(F.col("standalone_value") != "low", F.lit(True)), F.length("answer") <= 1800, F.coalesce(F.col("importance") != "not_required", F.lit(True)), F.col("extraction_warning").isNull(), ~F.coalesce(F.exists("warnings", lambda w: w.rlike(REPAIRS)), F.lit(False))]
    rules += [] if needs_review else [d == "keep"]
    rules += [] if medium else [F.coalesce(F.col("priority_label").isin("very_high", "high"), F.lit(False)) | (F.coalesce("priority_score", F.lit(0)) >= 70)]
    rules += [F.col("category") == category_] if category_ else []
    return items.where(reduce(Column.__and__, rules))


def error_code(code: Column, message: Column, stage: Column, chunk: Column) -> Column:
    """The code of a failed job's error, by its own code, its message, its stage and whether a chunk failed."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(code.isin("JOB_CANCELLED", "TEXT_EXTRACTION_FAILED"), code).when(low.rlike("rate|quota"), "OPENAI_RATE_LIMIT").when(low.rlike("timeout|timed out"), "OPENAI_TIMEOUT").when(stage == "merging_chunks", "MERGE_FAILED").when(chunk.isNotNull(), "CHUNK_FAILED").otherwise("PDF_PARSE_FAILED")


def open_jobs(status: DataFrame, most: int = 10) -> DataFrame:
    """job_id of the first most jobs by id that are neither completed nor cancelled."""
    return status.where(~F.col("status").isin("completed", "cancelled")).select("job_id").distinct().orderBy("job_id").limit(most)


def kept_status(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunks(job_id, chunk_id) with the status that known(job_id, chunk_id, status) has for them, pending for the others."""
    return chunks.join(known.select("job_id", "chunk_id", "status"), ["job_id", "chunk_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def drill(topics: DataFrame, count: int = 4, most: int = 6) -> DataFrame:
    """n, topic, question: count questions that take the first most topics(title, position, importance) not of high importance in turn."""
    weak = topics.where(F.coalesce(F.col("importance") != "high", F.lit(True))).orderBy("position").limit(most)
    listed = weak.agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("t"))  # at most most titles
    each = listed.where(F.size("t") > 0).select("t", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("n"))
    topic = F.col("t")[F.pmod(F.col("n"), F.size("t"))]["title"]
    return each.select("n", topic.alias("topic"), F.concat(F.lit("Drill: explain "), topic, F.lit(" as if teaching a friend — include one pitfall.")).alias("question"))
