"""Deleting and clearing projects, broken off at any point, and the debug document."""

import glob
import hashlib
import json
import os

import pytest

from marginalia.sources import files, projects


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path)
    for table in ("files", "parsed_documents", "parsed_pages", "candidates", "cards"):
        spark.createDataFrame([(k, p) for p in ("a", "b/ c=1", "d") for k in range(3)], "v int, project_id string").write.partitionBy("project_id").parquet(f"{path}/{table}")
    spark.createDataFrame([("a", ["f1"]), ("b/ c=1", ["f2", "f3"]), ("d", None)], "project_id string, active_file_ids array<string>").write.parquet(f"{path}/projects")
    return path


def counts(spark, root):
    return {t: {r.project_id: r["count"] for r in spark.read.parquet(f"{root}/{t}").groupBy("project_id").count().collect()} for t in ("files", "parsed_documents", "candidates", "cards", "projects")}


def digests(root, project):
    return {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{root}/*/project_id={project}/*.parquet")}


def test_clear_and_delete(spark, root):
    before = digests(root, "d")
    projects.clear(spark, root, "a", projects.PARSED)
    got = counts(spark, root)
    assert "a" not in got["parsed_documents"] and "a" not in got["candidates"] and got["files"]["a"] == got["cards"]["a"] == 3
    projects.clear(spark, root, "b/ c=1", projects.UPLOADED)
    got = counts(spark, root)
    assert "b/ c=1" not in got["files"] and got["cards"]["b/ c=1"] == 3
    assert {r.project_id: r.active_file_ids for r in spark.read.parquet(f"{root}/projects").collect()} == {"a": ["f1"], "b/ c=1": [], "d": None}
    projects.delete_project(spark, root, "a", ("files", "parsed_documents", "parsed_pages", "candidates", "cards", "never_written"))
    got = counts(spark, root)
    assert all("a" not in t for t in got.values()) and got["cards"] == {"b/ c=1": 3, "d": 3}
    assert digests(root, "d") == before and len(before) >= 5  # other projects' files are byte-equal
    projects.delete_project(spark, root, "a", ("files", "cards"))  # again: nothing to do
    assert counts(spark, root) == got


@pytest.mark.parametrize("at", range(1, 5))
def test_broken_off(spark, root, monkeypatch, at):
    """The n-th rename fails; a second call finishes the work and the table was never without rows that stay."""
    real, calls = projects._moved, []

    def failing(s, a, b):
        calls.append(a)
        if len(calls) == at:
            raise OSError("lost")
        real(s, a, b)

    monkeypatch.setattr(projects, "_moved", failing)
    with pytest.raises(OSError):
        projects.delete_project(spark, root, "a", ("files", "cards"))
    monkeypatch.setattr(projects, "_moved", real)
    projects.recover(spark, f"{root}/projects")
    assert {"b/ c=1", "d"} <= {r.project_id for r in spark.read.parquet(f"{root}/projects").collect()}
    projects.delete_project(spark, root, "a", ("files", "cards"))
    got = counts(spark, root)
    assert "a" not in got["files"] and "a" not in got["cards"] and set(got["projects"]) == {"b/ c=1", "d"} and not os.path.exists(f"{root}/projects.old") and not os.path.exists(f"{root}/projects.next")


def test_written_but_not_swapped(spark, root):
    """A whole new table beside the old one, or an unfinished one: the old one counts."""
    spark.createDataFrame([("z", None)], "project_id string, active_file_ids array<string>").write.parquet(f"{root}/projects.next")
    projects.recover(spark, f"{root}/projects")
    assert spark.read.parquet(f"{root}/projects").count() == 3
    os.rename(f"{root}/projects", f"{root}/projects.old")
    os.makedirs(f"{root}/projects.next")  # without a mark of success
    projects.recover(spark, f"{root}/projects")
    assert spark.read.parquet(f"{root}/projects").count() == 3


def test_debug_documents(spark):
    jobs = spark.createDataFrame([("j1", "fast", ("a.pdf", "lecture_notes")), ("j2", "standard", ("b.pdf", "other"))], "job_id string, mode string, file struct<name: string, role: string>")
    chunks = spark.createDataFrame([("j1", "c2", 5, 8, 100, 25), ("j1", "c1", 1, 4, 90, 23)], "job_id string, chunk_id string, first_page int, last_page int, chars int, tokens int")
    headings = spark.createDataFrame([("j1", "c1", 2, "B"), ("j1", "c1", 1, "A")], "job_id string, chunk_id string, position int, heading string")
    items = spark.createDataFrame([("j1", "kept", "definition"), ("j1", "kept", "proof"), ("j1", "rejected", "proof")], "job_id string, status string, kind string")
    warnings = spark.createDataFrame([("j2", "w2"), ("j2", "w1")], "job_id string, warning string")
    got = {r.job_id: json.loads(r.json) for r in files.debug_documents(jobs, chunks, items, warnings, headings).collect()}
    assert got["j1"] == {
        "jobId": "j1", "mode": "fast", "file": {"name": "a.pdf", "role": "lecture_notes"}, "warnings": [],
        "chunkStats": [{"chunkId": "c1", "pages": [1, 4], "chars": 90, "estimatedTokens": 23, "headings": ["A", "B"]}, {"chunkId": "c2", "pages": [5, 8], "chars": 100, "estimatedTokens": 25, "headings": []}],
        "resultCounts": {"items": 2, "needsReviewItems": 0, "rejectedItems": 1, "definitions": 1, "formulas": 0, "proofs": 1, "methods": 0},
    }
    assert got["j2"] == {"jobId": "j2", "mode": "standard", "file": {"name": "b.pdf", "role": "other"}, "chunkStats": [], "warnings": ["w1", "w2"]}
