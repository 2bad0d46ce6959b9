"""Files of a research, extraction decisions, and what is checked before a run."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cartolith.operators import checks
from cartolith.sources import research_files


def test_configurations_and_company_texts(spark, tmp_path):
    def put(path, value):
        p = tmp_path / "researches" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")

    put("a/research.json", {"name": "名", "description": "d", "company_technology": " from config "})
    put("b/research.json", {"company_technology": "hidden"})
    put("b/company_tech.txt", "\n from file \n two \n")
    put("c/company_tech.txt", "only text")
    put("d/research.json", "{")
    put("e/research.json", {"name": "E"})
    put("e/company_tech.txt", " \n")
    put("a/pipeline/P1/research.json", {"name": "not a research"})
    put("f/other.json", "{}")
    got = {r["research_id"]: r for r in research_files.read_researches(spark, f"file://{tmp_path}/researches").collect()}
    assert {k: (r["name"], r["description"], r["company_technology"], r["problem"]) for k, r in got.items()} == {
        "a": ("名", "d", "from config", None),
        "b": ("b", "", "from file \n two", None),
        "c": ("c", "", "only text", None),
        "d": ("d", "", "", "config_not_json"),
        "e": ("E", "", "", "company_text_empty"),
    }
    assert json.loads(got["c"]["config"]) == {"name": "c", "description": ""}


def test_pool_and_extraction(spark):
    files = spark.createDataFrame([("特開2020-123456.pdf",), ("特開2020-123456.PDF",), ("note.txt",), ("特開2020-123456.pdf",)], "pdf string")
    got = research_files.pool_names(files).collect()
    assert [r["pdfs"] for r in got] == [["特開2020-123456.PDF", "特開2020-123456.pdf"]]
    pool = spark.createDataFrame([("a.pdf", 1, 10), ("b.pdf", 2, 20)], "pdf string, modified long, length long")
    mark = lambda df: research_files.pool_signature(df).first()["signature"]
    assert mark(pool) == mark(pool.orderBy(F.desc("pdf"))) != mark(pool.withColumn("length", F.lit(1))) and research_files.pool_signature(pool.limit(0)).first()["files"] == 0
    wanted = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", "z"), ("5", "w"), ("6", None)], "path string, sha256 string")
    cache = spark.createDataFrame([("y", "y", True, True), ("z", "other", True, True), ("w", "w", True, False), ("w", "w", None, True)], "sha256 string, pdf_sha256 string, has_text boolean, has_pages boolean")
    decided = lambda policy: {r["path"]: r["cache_decision"] for r in research_files.extraction_decisions(wanted, cache, policy).collect()}
    assert decided("verify_original") == {"1": "created", "2": "reused", "3": "reused", "4": "created", "5": "created", "6": "created"}
    assert decided("reextract") == {"1": "created", "2": "reused", "3": "created", "4": "created", "5": "created", "6": "created"}
    with pytest.raises(ValueError):
        decided("whatever")
    pages = spark.createDataFrame([(1, 1, "a" * 400), (1, 2, " "), (1, 3, "b" * 200), (2, 1, "short"), (2, 2, None)], "doc_id long, page int, text string")
    out = {r["doc_id"]: r for r in research_files.extraction_manifests(pages).collect()}
    assert (out[1]["pages"], out[1]["nonempty_pages"], out[1]["skip_reason"], out[2]["nonempty_pages"]) == (3, 2, None, 1) and out[2]["skip_reason"] and out[1]["text_sha256"] == hashlib.sha256(out[1]["text"].encode()).hexdigest()


def test_ids_stages_and_versions(spark):
    values = ["a-b_c.d", "-a", "", None, "a/b", "a\n", "org_0123456789abcdef", "org_0123", "group_0123456789abcdef", "patent_list_20240101000000.csv"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    held = {f: {r["v"] for r in df.where(checks.is_id(F.col("v"), f)).collect()} for f in checks.ID_FORMS}
    assert held == {"safe_id": {values[0], *values[6:]}, "organization": {values[6]}, "group": {values[8]}, "patent_list": {values[9]}}
    assert checks.checked_stages(["finalize", "extract"]) == ["finalize", "extract"]
    with pytest.raises(ValueError, match="a, b"):
        checks.checked_stages(["b", "extract", "a"])
    runs = spark.createDataFrame([("r1", ["extract"]), ("r2", ["x", "extract", "b"]), ("r3", None)], "run_id string, stages array<string>")
    assert [tuple(r) for r in checks.unknown_stages(runs).collect()] == [("r2", ["b", "x"])]
    assert spark.range(1).select(checks.registry_version("s", None)).first()[0] == hashlib.sha256(b"s|none").hexdigest()[:12]


def test_analyses(spark):
    good = {"similarity": 1, "concept_level": 5, "tech_summary": "t", "problem_summary": "p", "reasoning": "r" * 4000, "tech_cluster": "c", "problem_cluster": "d"}
    cases = [
        (json.dumps(good), None), ("{", "not_json"), (None, "not_json"), ("[1]", "not_an_object"), ("3", "not_an_object"), (json.dumps(good | {"more": 1}), "keys"), (json.dumps({k: v for k, v in good.items() if k != "reasoning"}), "keys"),
        (json.dumps(good | {"similarity": True}), "similarity"), (json.dumps(good | {"similarity": 6}), "similarity"), (json.dumps(good | {"concept_level": "3"}), "concept_level"), (json.dumps(good | {"concept_level": 2.5}), "concept_level"),
        (json.dumps(good | {"tech_summary": " 　"}), "tech_summary"), (json.dumps(good | {"reasoning": "r" * 4001}), "reasoning"), (json.dumps(good | {"problem_cluster": None}), "problem_cluster"), (json.dumps(good | {"tech_cluster": 3}), "tech_cluster"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, v string")
    assert {r["i"]: r["p"] for r in df.select("i", checks.analysis_problem(F.col("v")).alias("p")).collect()} == {i: p for i, (_, p) in enumerate(cases)}


def test_preflight(spark):
    documents = spark.createDataFrame([(i, i, f"{i}.pdf", i != 5, "skipped" if i == 4 else "pending") for i in range(6)], "patent_id long, position long, pdf string, pdf_available boolean, analysis_state string")
    structures = spark.createDataFrame([(0, 2, True, 1), (1, 1, True, 1), (2, 2, True, 0), (4, 2, True, 1), (9, 2, True, 1)], "patent_id long, schema_version int, valid boolean, claims int")
    assert {r["patent_id"]: r["state"] for r in checks.structure_states(documents, structures).collect()} == {0: "valid", 1: "invalid", 2: "invalid", 3: "missing", 4: "skipped"}
    shape = {"type": "object", "required": ["x"]}
    full = dict.fromkeys(checks.PROMPTED, "p"), dict.fromkeys(checks.PROMPTED, shape), checks.MODELS, ("a", "b")
    one = documents.where("patent_id IN (0, 4, 5)")
    report = checks.preflight(one, structures, *full)
    assert report.where("not ok").count() == 0 and report.count() == 6
    ready = checks.readiness(report, one).first()
    assert ready["ready"] and ready["selection_fingerprint"] == hashlib.sha256(b"0.pdf\n4.pdf\n5.pdf\n").hexdigest()[:12]
    bad = {r["check"]: (r["ok"], r["detail"]) for r in checks.preflight(documents.limit(0), structures, {}, {}, None, ("a", "a")).collect()}
    assert not any(ok for ok, _ in bad.values()) and bad["model-server"][1] == "no answer" and bad["claim-structure"][1] == "valid 0/0, missing 0, invalid 0, skipped 0"
