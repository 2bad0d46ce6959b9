"""Researches, groups, work selection and table checks on small fixtures."""

import pytest
from pyspark.sql import functions as F

from cartolith.operators import registry


def test_rules_and_notes():
    assert registry.checked_rules({"a": [" x ", "x", ""], "b": ["y"]}) == {"a": ["x"], "b": ["y"]}
    for bad in ({"a": ["x"], "b": ["x"]}, {"a": ["x" * 201]}, {"a": map(str, range(101))}):
        with pytest.raises(ValueError):
            registry.checked_rules(bad)
    assert registry.checked_note(" n ") == "n" and registry.safe_id("a-1") and not registry.safe_id("a/b")
    with pytest.raises(ValueError):
        registry.checked_note("  ")


def test_researches(spark):
    rows = spark.createDataFrame([("b", "active"), ("a", "active"), ("c", "archived")], "research_id string, lifecycle_status string")
    docs = spark.createDataFrame([("b", 1), ("b", 2)], "research_id string, patent_id long")
    got = lambda s: [(r["research_id"], r["documents"]) for r in registry.list_researches(rows, docs, s).collect()]
    assert got("active") == [("a", 0), ("b", 2)] and got("archived") == [("c", 0)] and len(got("all")) == 3
    assert registry.set_archived(rows, "a", True).where("lifecycle_status = 'archived'").count() == 2


def test_groups_and_references(spark):
    orgs = spark.createDataFrame([("1", "beta"), ("2", "Alpha")], "organization_id string, name string")
    groups = spark.createDataFrame([("g", [("2", "other"), ("3", "alpha2")])], "group_id string, members array<struct<organization_id:string,name:string>>")
    assert [r["name"] for r in registry.organization_registry(orgs, groups).collect()] == ["Alpha", "alpha2", "beta"]
    cases = spark.createDataFrame([(["1", "2"],), (["1", "1"],), (["1", "9"],)], "m array<string>")
    assert [r[0] for r in cases.select(registry.group_problem(F.col("m"), F.array(F.lit("1"), F.lit("2")))).collect()] == [None, "too_few_members", "unknown_member"]
    names = spark.createDataFrame([("a.PDF",), ("a.txt",), ("x/a.pdf",), ("x\\a.pdf",), (None,)], "n string")
    assert [r[0] for r in names.select(registry.reference_problem(F.col("n"))).collect()] == [None, "not_pdf", "not_a_plain_name", "not_a_plain_name", "not_pdf"]


def test_work(spark):
    docs = spark.createDataFrame([(1, "pending", None), (2, "ready", None), (3, "pending", "manual_review_required"), (4, "pending", None)], "patent_id long, analysis_state string, skip_reason string")
    done = spark.createDataFrame([(4,)], "patent_id long")
    ids = lambda df: sorted(r["patent_id"] for r in df.collect())
    assert ids(registry.open_work(docs, done, ["patent_id"])) == [1] and ids(registry.open_work(docs, done, ["patent_id"], True)) == [1, 2]
    rows = spark.createDataFrame([("t", 1, 5), ("t", 2, 3), ("technology_summary", 1, 5), ("technology_summary", 2, 3)], "task string, doc_id long, characters int")
    assert {(r["task"], r["doc_id"]) for r in registry.work_order(rows).where("turn = 1").collect()} == {("t", 2), ("technology_summary", 1)}
    arts = spark.createDataFrame([(1, "score"), (1, "text")], "patent_id long, artifact_type string")
    flags = {r["patent_id"]: (r["score"], r["text"]) for r in registry.stage_flags(docs, arts, ["score", "text"]).collect()}
    assert flags[1] == (True, True) and flags[2] == (False, False)
