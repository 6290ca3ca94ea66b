"""Deletes and clears projects in tables that are partitioned by project_id.

A partition goes by one rename into a folder that readers ignore, and is deleted from there; a table of one row a project
is rewritten beside itself and swapped in. Either can be broken off at any point: the next call puts the table right first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each way of clearing takes.
DEBUG = ("candidates",)
PARSED = ("parsed_documents", "parsed_pages", "candidates")
UPLOADED = ("files", *PARSED)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _moved(spark: SparkSession, source: str, target: str) -> None:
    (a, fs), (b, _) = _path(spark, source), _path(spark, target)
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be renamed to {target}")


def recover(spark: SparkSession, path: str) -> None:
    """Finishes or undoes a swap that broke off: the table is the whole new one if the old one was already aside, else the old one."""
    (own, fs), (new, _), (old, _) = _path(spark, path), _path(spark, f"{path}.next"), _path(spark, f"{path}.old")
    whole = fs.exists(_path(spark, f"{path}.next/_SUCCESS")[0])
    if not fs.exists(own) and fs.exists(old):
        _moved(spark, f"{path}.next" if whole else f"{path}.old", path)
    fs.delete(new, True)
    fs.delete(old, True)


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """The table at path with change applied: written whole beside it, then swapped in by two renames."""
    recover(spark, path)
    change(spark.read.parquet(path)).write.parquet(f"{path}.next")
    _moved(spark, path, f"{path}.old")
    _moved(spark, f"{path}.next", path)
    recover(spark, path)
    spark.catalog.refreshByPath(path)


def remove(spark: SparkSession, root: str, table: str, project: str) -> None:
    """Takes a project's rows out of root/table; other projects' files aren't touched. A table or project that isn't there is none."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project)
    part, fs = _path(spark, f"{root}/{table}/project_id={name}")
    removed, _ = _path(spark, f"{root}/{table}/_removed")
    if fs.exists(part):
        fs.mkdirs(removed)
        _moved(spark, part.toString(), f"{removed.toString()}/{uuid.uuid4().hex}")
    fs.delete(removed, True)  # with what a call that broke off left
    spark.catalog.refreshByPath(f"{root}/{table}")


def clear(spark: SparkSession, root: str, project: str, tables: tuple[str, ...]) -> None:
    """Clears a project's rows of tables: DEBUG, PARSED (its cards stay) or UPLOADED (its cards stay, and root/projects has no active files for it any more)."""
    for table in tables:
        remove(spark, root, table, project)
    if "files" in tables:
        none = F.when(F.col("project_id") == project, F.array().cast("array<string>")).otherwise(F.col("active_file_ids"))
        rewrite(spark, f"{root}/projects", lambda rows: rows.withColumn("active_file_ids", none))


def delete_project(spark: SparkSession, root: str, project: str, tables: tuple[str, ...]) -> None:
    """Deletes a project: its rows of all tables, last of all its row of root/projects, so that a broken call can be repeated."""
    for table in tables:
        remove(spark, root, table, project)
    rewrite(spark, f"{root}/projects", lambda rows: rows.where(~F.col("project_id").eqNullSafe(project)))
