"""Cited ids and claims against the input, and the repair of answers."""

import json

from pyspark.sql import functions as F

from cartolith.functions import text as T
from cartolith.operators import evidence, references, structure

PAGE = "【特許請求の範囲】\n【請求項１】\nセンサと、制御部とを備える装置。\n【請求項２】\n請求項１に記載の装置。\n【発明の詳細な説明】\n【課題を解決するための手段】\n【0001】制御部が信号を処理する。\n【0002】従来の方法では温度の変動を抑制することが困難であった。"


def fixture(spark):
    pages = spark.createDataFrame([(1, 1, PAGE)], "doc_id long, page int, text string")
    paragraphs, claims = structure.structured_paragraphs(pages), structure.structured_claims(pages)
    return paragraphs, claims, references.allowed_ids(evidence.evidence_packs(paragraphs, claims, "制御部が信号を処理する"))


def test_references_and_their_sources(spark):
    paragraphs, claims, allowed = fixture(spark)
    held = {r["task"]: r["allowed"] for r in allowed.collect()}
    assert held["similarity"] == held["concept_level"] == ["C1-E1", "C1-E2"]
    assert held["technology_summary"][:2] == ["C1-E1", "C1-E2"] and all(i.startswith("P0001-N") for i in held["technology_summary"][2:]) and len(held["technology_summary"]) > 2
    paragraph = held["technology_summary"][2]
    cases = [
        ("similarity", [" [C1-E2 input] ", "C1-E1", "C1-E2", ""], ["C1-E2", "C1-E1"], [], None),
        ("concept_level", ["C1-E1", paragraph], ["C1-E1"], [paragraph], references.UNKNOWN),
        ("technology_summary", ["C1-E1", paragraph, "C9-E9", "what"], ["C1-E1", paragraph], ["C9-E9", "what"], references.UNKNOWN),
        ("problem_summary", ["  "], [], [], references.EMPTY),
        ("other", ["C1-E1"], [], ["C1-E1"], references.UNKNOWN),
    ]
    rows = spark.createDataFrame([(1, t, c) for t, c, *_ in cases] + [(1, "none", None), (1, "null", [None])], "doc_id long, task string, cited array<string>")
    got = {r["task"]: r for r in references.checked_references(rows, allowed).collect()}
    for task, _, verified, rejected, reason in cases:
        r = got[task]
        assert (r["verified_ids"], r["rejected_ids"], r["reason"], r["verified"]) == (verified, rejected, reason, reason is None)
    assert got["none"]["reason"] == got["null"]["reason"] == references.NOT_A_LIST
    checked = references.checked_references(rows.where("task = 'technology_summary'"), allowed)
    sources = references.verified_sources(checked, references.source_rows(paragraphs, claims)).orderBy("nth").collect()
    assert [(s["id"], s["source_type"], s["claim_number"], s["page"]) for s in sources] == [("C1-E1", "element", 1, None), (paragraph, "paragraph", None, 1)]
    assert all(s["sha256"] for s in sources)


def test_claims_are_bound_by_an_integer(spark):
    _, claims, _ = fixture(spark)
    rows = spark.createDataFrame([(1, v) for v in ("1", "2", "9", "true", '"1"', "1.0", None)] + [(2, "1")], "doc_id long, reported string")
    got = {(r["doc_id"], r["reported"]): r for r in references.checked_claims(rows, claims).collect()}
    text = "センサと、制御部とを備える装置。"
    assert got[1, "1"]["verified"] and got[1, "1"]["claim_text"] == text and got[1, "1"]["claim_sha256"] == T.digest(text)
    assert {got[1, v]["reason"] for v in ("true", '"1"', "1.0", None)} == {"claim_number_not_integer"}
    assert {got[1, "2"]["reason"], got[1, "9"]["reason"], got[2, "1"]["reason"]} == {"claim_number_not_in_scoring_input"} and len(got) == 8
    late = claims.withColumn("type", F.lit("dependent"))
    assert [r["verified"] for r in references.checked_claims(rows.where("reported in ('1', '2') and doc_id = 1"), late).orderBy("reported").collect()] == [True, False]


def test_one_repair(spark):
    _, _, allowed = fixture(spark)
    schema = {"type": "object", "required": ["evidence_ids"], "properties": {"evidence_ids": {"type": "array", "items": {"type": "string"}}}}
    inputs = spark.createDataFrame([(1, "similarity", "good"), (1, "concept_level", "mends"), (1, "problem_summary", "stays"), (1, "technology_summary", "breaks")], "doc_id long, task string, prompt string")

    def call(task, prompt):
        head, _, told = prompt.partition("\n")
        if head == "breaks":
            raise ValueError("no answer")
        if head == "mends" and told:
            note = json.loads(told)
            assert note["previous_ids"] == ["C7-E1"] and note["validation"] == "evidence_id_not_in_task_input"
            return {"evidence_ids": note["allowed_ids"][:1]}
        return {"evidence_ids": ["C1-E1"] if head == "good" else ["C7-E1"]}

    got = {r["task"]: r for r in references.grounded(inputs, allowed, call, schema).collect()}
    assert {t: (r["verified"], r["attempts"]) for t, r in got.items()} == {"similarity": (True, 1), "concept_level": (True, 2), "problem_summary": (False, 2), "technology_summary": (False, 2)}
    assert got["concept_level"]["verified_ids"] == ["C1-E1"] and got["problem_summary"]["rejected_ids"] == ["C7-E1"] and "no answer" in got["technology_summary"]["error"]
