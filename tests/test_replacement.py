"""Replacing a research's documents: random edits against a rebuild, versions, and search by postings."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith.operators import facets, replacement
from cartolith.operators.model import DocumentFilter
from cartolith.sources.snapshots import Conflict

COLUMNS = "patent_id long, position long, title string, applicant string, tags_text string, year int, organization_ids array<string>"
ORGS = [f"o{i}" for i in range(9)]
TEXTS = ["Sensor-100% Unit", "SENSOR unit", "制御装置", "制御", "a_b", "a\\b", "aXb", "été", "ab", "", None, "sensor_100"]


def document(rng, i, position):
    return (i, position, rng.choice(TEXTS), rng.choice(TEXTS), rng.choice(TEXTS), rng.choice([None, 1999, 2000]), rng.choice([None, [], rng.sample(ORGS, 2), [ORGS[0], ORGS[0], None]]))


def state(research):
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    rows = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=key)
    return (
        rows(research.documents(), *research.columns),
        rows(research.snapshot.read("bridge"), "patent_id", "organization_id"),
        rows(research.organizations(), "organization_id", "name", "document_count"),
        rows(research.snapshot.read("postings"), "patent_id", "gram"),
    )


def test_edits_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replacement, "GRAM_FOLDERS", 2)
    rng = random.Random(1)
    research = replacement.Research(spark, f"file://{tmp_path}/s", "r", COLUMNS, buckets=3)
    rows = {i: document(rng, i, i) for i in range(25)}
    for step in range(4):
        for _ in range(step * 3):
            i = rng.randrange(30)
            if rng.random() < 0.4:
                rows.pop(i, None)
            else:
                rows[i] = document(rng, i, rng.choice([i, 7]))
        if step == 3:
            rows = {}
        incoming = spark.createDataFrame(list(rows.values()), COLUMNS)
        named = spark.createDataFrame([(o, o.upper() + str(step // 2)) for o in ORGS[: 5 + step]] + [(None, "x")], "organization_id string, name string")
        before = {r["patent_id"]: tuple(r) for r in research.documents().collect()}
        got = {r["patent_id"]: r["change"] for r in research.replace(incoming, named, {"step": step}).collect()}
        after = {r["patent_id"]: tuple(r) for r in incoming.collect()}
        want = {i: "added" if i not in before else "removed" if i not in after else "changed" for i in before | after if before.get(i) != after.get(i)}
        assert got == want and research.snapshot.about == {"research_id": "r", "step": step}
        if step == 0:
            continue
        fresh = replacement.Research(spark, f"file://{tmp_path}/fresh{step}", "r", COLUMNS, buckets=1)
        fresh.replace(incoming, named)
        reread = replacement.Research(spark, f"file://{tmp_path}/s", "r", COLUMNS, buckets=3)
        assert state(reread) == state(fresh)
        counts = {r[0]: r[2] for r in state(reread)[2]}
        assert counts == {o: sum(o in (d[6] or []) for d in rows.values()) for o in ORGS[: 5 + step]}


def test_only_touched_buckets_are_written(spark, tmp_path):
    research = replacement.Research(spark, f"file://{tmp_path}/s", "r", COLUMNS)
    rows = [(i, i, f"title {i}", "a", "t", 2000, ["o1"]) for i in range(200)]
    orgs = spark.createDataFrame([("o1", "One"), ("o2", "Two")], "organization_id string, name string")
    research.replace(spark.createDataFrame(rows, COLUMNS), orgs)
    first = {n: dict(t) for n, t in research.snapshot.state["tables"].items()}
    assert research.replace(spark.createDataFrame(rows, COLUMNS), orgs).count() == 0
    assert research.snapshot.state["tables"] == first and research.snapshot.number == 2
    rows[3] = (3, 3, "another", "a", "t", 2000, ["o1", "o2"])
    assert [tuple(r) for r in research.replace(spark.createDataFrame(rows, COLUMNS), orgs).collect()] == [(3, "changed")]
    now = research.snapshot.state["tables"]
    for name in ("documents", "bridge", "postings"):
        assert sum(now[name][b] != first[name].get(b) for b in now[name]) == 1
    assert {r["organization_id"]: r["document_count"] for r in research.organizations().collect()} == {"o1": 200, "o2": 1}
    reader = replacement.Research(spark, f"file://{tmp_path}/s", "r", COLUMNS)
    research.replace(spark.createDataFrame(rows[:10], COLUMNS), orgs)
    assert reader.documents().count() == 200  # its version stays whole
    with pytest.raises(Conflict):
        reader.replace(spark.createDataFrame(rows[:5], COLUMNS), orgs)
    assert replacement.researches(spark, f"file://{tmp_path}/s", ["r", "none"]).select("research_id", "version").collect() == [("r", 4)]
    top = facets.organization_top(DocumentFilter(research_id="r").apply(research.tables()), research.tables())
    assert top.count() == 2


def test_repeated_and_null_ids(spark, tmp_path):
    research = replacement.Research(spark, f"file://{tmp_path}/s", "r", COLUMNS)
    rows = [(1, 5, "late", None, None, None, None), (1, 2, "first", None, None, None, None), (1, None, "nowhere", None, None, None, None), (None, 0, "no id", None, None, None, ["o"])]
    research.replace(spark.createDataFrame([(*r, "more") for r in rows], COLUMNS + ", name string"), spark.createDataFrame([], "organization_id string, name string"))
    assert [r["title"] for r in research.documents().collect()] == ["first"] and research.organizations().count() == 0


def test_postings_find_what_like_finds(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    research = replacement.Research(spark, f"file://{tmp_path}/s", "r", COLUMNS, buckets=2)
    rows = [document(rng, i, i) for i in range(150)]
    research.replace(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], "organization_id string, name string"))
    where = DocumentFilter(research_id="r")
    for needle in (" SENSOR ", "sor%nit", "r_100", "制御装置", "制御", "a\\b", "%", "", "été"):
        want = {r["patent_id"] for r in DocumentFilter(research_id="r", query=needle).apply(research.tables()).collect()} if needle else {r[0] for r in rows}
        for most in (10_000, 3) if needle == " SENSOR " else (10_000,):
            monkeypatch.setattr(replacement, "NAMED_MOST", most)
            assert {r["patent_id"] for r in research.find(needle).collect()} == want, needle
    assert where.apply(research.tables()).count() == 150
    monkeypatch.setattr(replacement, "NAMED_MOST", 10_000)
    research.replace(spark.createDataFrame([(i, i, f"item {i} of the list", "", "", 2000, None) for i in range(500)], COLUMNS), spark.createDataFrame([], "organization_id string, name string"))
    found = research.find("item 77 of")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r["patent_id"] for r in found.collect()] == [77] and "PushedFilters" in plan and "patent_id = 77" in plan.replace("EqualTo(patent_id,77)", "patent_id = 77") and len(found.inputFiles()) == 1
    posted = research.candidates("item 77 of")
    assert "PartitionFilters: [_g" in posted._jdf.queryExecution().executedPlan().toString() or "_g" in posted._jdf.queryExecution().executedPlan().toString()
    assert posted.where(F.col("patent_id") == 77).count() == 1
