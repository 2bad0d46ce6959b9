"""Canonical JSON, committed tables, and analysis tasks from input to committed answer."""

import datetime
import json
import pathlib
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions import canonical
from cartolith.operators import analysis, evidence, structure
from cartolith.sources.committed import CommittedTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import this module

ODD = 'é"\\\n\t\x01\x1f\x7f/😀</s>'


def plain(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_canonical_values_match_the_driver(spark):
    kind = "struct<z:string,a:array<struct<k:int,B:string>>,m:map<string,array<bigint>>,t:boolean,n:int,`é`:string>"
    values = [
        {"z": ODD, "a": [{"k": 1, "B": None}, None], "m": {"b": [1, None], "a": [], "Z": None, "😀": [2], "～": [3]}, "t": True, "n": None, "é": ""},
        {"z": None, "a": [], "m": {}, "t": False, "n": -5, "é": "x" * 5000},
        None,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = {r["i"]: r["c"] for r in df.select("i", canonical.of(F.col("v"), df.schema["v"].dataType).alias("c")).collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)}
    assert canonical.digest(values[0]) == df.where("i = 0").select(F.sha2(canonical.of(F.col("v"), df.schema["v"].dataType), 256)).first()[0]


def test_canonical_fractions_variants_and_text(spark):
    numbers = [0.1, 1.0, 1e16, 1e-5, 123456789.125, 5e-324, -0.0, 1e300, 2e23, None]
    df = spark.createDataFrame([(x, [x, 1.5], {"b": x}) for x in numbers], "x double, xs array<double>, m map<string,double>")
    kinds = {f.name: f.dataType for f in df.schema}
    for r, x in zip(df.select(*[canonical.of(F.col(c), k).alias(c) for c, k in kinds.items()]).collect(), numbers, strict=True):
        assert (r["x"], r["xs"], r["m"]) == (plain(x), plain([x, 1.5]), plain({"b": x}))
    texts = ['{"b": 1, "a": [1.50, {"y": null, "x": "\\u00e9"}]}', "[]", "3", "not json", None, '{"a":1,"a":2}', '"' + "q" * 9000 + '"']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(canonical.of_text(F.col("t"))).collect()]
    assert got == [None if t in (None, "not json") else plain(json.loads(t)) for t in texts]
    variants = rows.where("t like '{\"b%'").select(F.parse_json("t").alias("v"))
    assert variants.select(canonical.of(F.col("v"), T.VariantType())).first()[0] == plain({"a": [1.5, {"x": "é", "y": None}], "b": 1})
    with pytest.raises(TypeError):
        canonical.of(F.col("m"), T.MapType(T.DoubleType(), T.StringType()))
    assert spark.range(1).select(canonical.of(F.lit(datetime.date(2020, 1, 2)), T.DateType())).first()[0] == '"2020-01-02"'
    assert spark.range(1).select(canonical.joined({"b": F.lit("1"), "a": F.lit("[]")})).first()[0] == '{"a":[],"b":1}'


def test_commits_are_whole_and_made_once(spark, tmp_path):
    table = CommittedTable(spark, f"file://{tmp_path}/t", "k long, v string")
    assert table.read().count() == 0 and table.read().columns == ["k", "v", "commit_id"]
    assert table.append(spark.createDataFrame([(1, "a", 0)], "k long, v string, more int"), "one")
    assert not table.append(spark.createDataFrame([(2, "b")], "k long, v string"), "one")
    assert table.append(spark.createDataFrame([], "k long, v string"), "none.yet")
    # what a job that died has written, and a second writer's marker for one name
    spark.createDataFrame([(9, "lost")], "k long, v string").write.parquet(f"file://{tmp_path}/t/data/two~dead")
    spark.createDataFrame([(8, "late")], "k long, v string").write.parquet(f"file://{tmp_path}/t/data/one~zzz")
    pathlib.Path(f"{tmp_path}/t/commits/one@one~zzz").touch()
    assert table.append(spark.createDataFrame([(3, None)], "k long, v string"), "three")
    assert sorted(map(tuple, table.read().collect()), key=str) == [(1, "a", "one"), (3, None, "three")]
    assert [r["k"] for r in table.read(["three"]).collect()] == [3] and table.read([]).count() == 0
    for bad in ("", ".x", "a/b", "a@b", "a~b"):
        with pytest.raises(ValueError):
            table.append(table.read(), bad)


PAGE = "【特許請求の範囲】\n【請求項１】\nセンサと、制御部とを備える装置。\n【請求項２】\n請求項１に記載の装置。\n【発明の詳細な説明】\n【課題を解決するための手段】\n【0001】制御部が信号を処理する。\n【0002】従来の方法では温度の変動を抑制することが困難であった。\n【発明が解決しようとする課題】\n【0003】検査の精度が低いという問題がある。"
TEMPLATES = {t: f"Template of {t}." for t in analysis.ANSWERS}


BASE = []


def prepared(spark, docs=(1,), research="r", company="制御部が信号を処理する", pdf=None):
    """Tasks of documents that all are the page above."""
    if not BASE:
        pages = spark.createDataFrame([(1, 1, PAGE)], "doc_id long, page int, text string")
        paragraphs, claims = structure.structured_paragraphs(pages), structure.structured_claims(pages)
        packs = evidence.evidence_packs(paragraphs, claims, company)
        manifests = spark.createDataFrame([(1, "pdf1", "p1", "s", "c", "targeted")], "doc_id long, pdf_sha256 string, preprocessing_version string, structured_document_sha256 string, claim_structure_sha256 string, reading_policy string")
        BASE.extend(r.asDict() for r in analysis.prepared_tasks(packs, claims, manifests, research, company).collect())
    rows = [r | {"doc_id": d, "research_id": research, "company": company, "pdf_sha256": pdf or f"pdf{d}"} for d in docs for r in BASE]
    return spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in analysis.PREPARED.split(", ")) for r in rows], analysis.PREPARED)


def test_prepared_tasks(spark):
    got = {r["task"]: r for r in prepared(spark).collect()}
    assert set(got) == set(analysis.ANSWERS) and got["similarity"]["allowed"] == ["C1-E1", "C1-E2"] and got["similarity"]["claims"] == [1]
    assert got["problem_summary"]["allowed"] and all(i.startswith("P0001-N") for i in got["problem_summary"]["allowed"])
    assert got["technology_summary"]["allowed"] == sorted(got["technology_summary"]["allowed"]) and "C1-E1" in got["technology_summary"]["allowed"] and "センサ" in got["concept_level"]["text"]


def model(folder, answer, name="m", **more):
    """A model whose calls leave a file each; answer(task, prompt, schema, tokens) makes the answer."""

    def complete(prompt, schema, context, tokens):
        task = next(t for t in analysis.ANSWERS if f"Template of {t}." in prompt)
        (pathlib.Path(folder) / f"{task}-{uuid.uuid4().hex}").write_text(json.dumps({"prompt": prompt, "schema": schema, "context": context, "tokens": tokens}, ensure_ascii=False))
        got = answer(task, prompt, schema, tokens)
        return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)

    return analysis.Model(complete, {"model": name}, TEMPLATES, **more)


def calls(folder):
    out = [(p.name.split("-")[0], json.loads(p.read_text())) for p in sorted(pathlib.Path(folder).iterdir(), key=lambda p: p.stat().st_mtime_ns)]
    return out


def good(task, ids):
    a = analysis.ANSWERS[task]
    return ({a.value: 4, "reason": "構成が一致する", "claim_number": 1} if a.level else {a.value: " summary "}) | {a.ids: ids}


def right(task, prompt, schema, tokens):
    return good(task, schema["properties"][analysis.ANSWERS[task].ids]["items"]["enum"][:1])


def test_a_wrong_citation_is_asked_for_once_more(spark, tmp_path):
    def answer(task, prompt, schema, tokens):
        return good(task, ["C9-E9"]) if "Rejected evidence" not in prompt else right(task, prompt, schema, tokens)

    store = analysis.Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "calls").mkdir()
    got = analysis.run_tasks(prepared(spark), model(tmp_path / "calls", answer), store, "run", tasks=("similarity",)).collect()
    assert [(r["state"], r["verified"], len(r["attempts"]), r["fingerprint"]) for r in got] == [("repaired", True, 2, None)]
    assert json.loads(got[0]["response"])["evidence_element_ids"] == ["C1-E1"]
    first, second = got[0]["attempts"]
    assert (first["verified"], first["rejected_ids"], first["reason"]) == (False, ["C9-E9"], "evidence_id_not_in_task_input") and second["verified"]
    (_, one), (_, two) = calls(tmp_path / "calls")
    assert '{"allowed_evidence_ids": ["C1-E1", "C1-E2"], "allowed_claim_numbers": [1]}' in one["prompt"] and "Rejected evidence" not in one["prompt"]
    assert '"previous_ids":["C9-E9"]' in two["prompt"].replace('": ', '":') and one["schema"] == two["schema"]
    assert one["schema"]["properties"]["evidence_element_ids"]["items"]["enum"] == ["C1-E1", "C1-E2"] and one["schema"]["properties"]["claim_number"]["enum"] == [1]


def test_what_fails_twice_is_a_row_and_stays_open(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store = analysis.Store(spark, f"file://{tmp_path}/store")
    bad = model(tmp_path / "calls", lambda task, p, s, t: good(task, ["C9-E9"]) | ({"claim_number": 7} if analysis.ANSWERS[task].level else {}))
    got = analysis.run_tasks(prepared(spark), bad, store, "run", tasks=("concept_level",)).collect()
    assert [(r["state"], r["verified"], r["response"], len(r["attempts"])) for r in got] == [("failed", False, None, 2)]
    assert got[0]["attempts"][1]["claim_reason"] == "claim_number_not_in_scoring_input" and "evidence does not hold" in got[0]["error"]
    assert store.answers.read().count() == 0 and len(calls(tmp_path / "calls")) == 2
    rows = analysis.keyed(prepared(spark), bad, "normal").where("task = 'concept_level'")
    assert store.open_tasks(rows).count() == 1
    again = analysis.run_tasks(prepared(spark), model(tmp_path / "calls", right), store, "run", tasks=("concept_level",)).collect()
    assert [(r["state"], r["verified"]) for r in again] == [("generated", True)]
    assert analysis.assembled(store.current()).count() == 0


def test_answers_are_shared_by_what_decides_them(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store = analysis.Store(spark, f"file://{tmp_path}/store")
    one = model(tmp_path / "calls", right)
    inputs = prepared(spark, (1, 2), "first", pdf="same").unionByName(prepared(spark, (1,), "other", "別の技術", pdf="same"))
    got = analysis.run_tasks(inputs, one, store, "run")
    assert {(r["research_id"], r["doc_id"], r["task"]): r["state"] for r in got.collect()} == {(r, d, t): "generated" for r, d in (("first", 1), ("first", 2), ("other", 1)) for t in analysis.ANSWERS}
    # three documents of one content: shared tasks are asked for once, similarity for each document
    assert sorted(t for t, _ in calls(tmp_path / "calls")) == sorted(["similarity"] * 3 + list(analysis.SHARED))
    keys = store.answers.read().collect()
    assert len(keys) == 3 and all(canonical.digest(json.loads(r["key_material"])) == r["fingerprint"] and len(json.loads(r["key_material"])) == 12 for r in keys)
    analysis.run_tasks(inputs, one, store, "again")  # all is done
    third = analysis.run_tasks(prepared(spark, (5,), "third", pdf="same"), one, store, "third", tasks=analysis.SHARED)
    assert {r["state"] for r in third.where("research_id = 'third'").collect()} == {"cached"} and len(calls(tmp_path / "calls")) == 6
    analysis.run_tasks(prepared(spark, (6,), "fourth", pdf="same"), model(tmp_path / "calls", right, "other model"), store, "fourth", tasks=("concept_level",))
    assert len(calls(tmp_path / "calls")) == 7
    scores = {(r["research_id"], r["doc_id"]): r for r in analysis.assembled(store.current()).collect()}
    assert set(scores) == {("first", 1), ("first", 2), ("other", 1)}
    score = json.loads(scores["first", 1]["threat_score"])
    assert score["similarity"] == 4 and score["claim_traceability"] == {"similarity": 1, "concept_level": 1} and score["evidence_traceability"]["similarity"] == ["C1-E1"]
    assert json.loads(scores["first", 1]["summaries"]) == {"tech_summary": "summary", "problem_summary": "summary"}


def test_a_stored_answer_must_hold_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    one = model(tmp_path / "calls", right)
    rows = analysis.keyed(prepared(spark, range(1, 7)), one, "normal").where("task = 'problem_summary'").cache()
    marks = {r["doc_id"]: r["fingerprint"] for r in rows.collect()}
    held, now = rows.first()["allowed"][0], analysis.CACHE_VERSION
    fits = lambda ids, text="t": json.dumps({"problem_summary": text, "source_paragraph_ids": ids})
    cases = {1: (fits([held]), now), 2: (fits([held]), "old"), 3: (fits(["P0009-N0009"]), now), 4: (fits([held], " "), now), 5: ("{", now), 6: (None, now)}
    stored = [(marks[d], version, "problem_summary", "{}", response, datetime.datetime(2020, 1, 1)) for d, (response, version) in cases.items()]
    got = analysis.analyse(rows, one, spark.createDataFrame(stored, analysis.ANSWER_ROW))
    assert {r["doc_id"]: r["state"] for r in got.collect()} == {1: "cached"} | dict.fromkeys(range(2, 7), "generated") and len(calls(tmp_path / "calls")) == 5


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store, one = analysis.Store(spark, f"file://{tmp_path}/store"), model(tmp_path / "calls", right)
    inputs = prepared(spark, (1, 2, 3))
    analysis.run_tasks(inputs, one, store, "run", tasks=("similarity",), parts=2)  # and then the run ends
    assert len(calls(tmp_path / "calls")) == 3
    analysis.run_tasks(inputs, one, store, "run", tasks=("similarity", "concept_level"))
    assert [t for t, _ in calls(tmp_path / "calls")[3:]] == ["concept_level"] * 3
    # other input of one document: its task is stale, and only that is asked for
    changed = inputs.withColumn("company", F.when(F.col("doc_id") == 2, "another").otherwise(F.col("company")))
    analysis.run_tasks(changed, one, store, "run", tasks=("similarity", "concept_level"))
    assert [t for t, _ in calls(tmp_path / "calls")[6:]] == ["similarity"]
    # answers are committed before checkpoints: a run that ends between them asks for nothing again
    lost = analysis.Store(spark, f"file://{tmp_path}/store")
    lost.checkpoints = CommittedTable(spark, f"file://{tmp_path}/empty", analysis.CHECKPOINT)
    got = analysis.run_tasks(inputs, one, lost, "run", tasks=("concept_level",))
    assert len(calls(tmp_path / "calls")) == 7 and {r["state"] for r in got.collect()} == {"cached"}


def test_rescue_and_manual_review(spark, tmp_path):
    for name in ("first", "second"):
        (tmp_path / name).mkdir()
    store = analysis.Store(spark, f"file://{tmp_path}/store")
    broken = model(tmp_path / "first", lambda *a: "{")
    second = model(tmp_path / "second", lambda task, p, s, t: right(task, p, s, t) if task != "similarity" else "[]", "second")
    args = (prepared(spark), broken, store, "run", "normal", second, ("similarity", "problem_summary"))
    got = {r["task"]: r for r in analysis.run_tasks(*args).collect()}
    assert {t: r["state"] for t, r in got.items()} == {"similarity": "manual_review_required", "problem_summary": "rescued"}
    assert "failed after 3 attempts" in got["similarity"]["error"] and len(calls(tmp_path / "first")) == 6
    analysis.run_tasks(*args)
    assert len(calls(tmp_path / "first")) == 6 and len(calls(tmp_path / "second")) == 4


def test_caps_grow_and_prompts_have_a_limit(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def third(task, prompt, schema, tokens):
        if tokens < 768:
            raise analysis.Unfinished("length")
        return right(task, prompt, schema, tokens)

    inputs = prepared(spark).where("task = 'technology_summary'")
    one = model(tmp_path / "calls", third)
    rows = analysis.analyse(analysis.keyed(inputs, one, "normal"), one).collect()
    assert [r["state"] for r in rows] == ["generated"] and [c["tokens"] for _, c in calls(tmp_path / "calls")] == [384, 512, 768]
    assert ["cut off" in c["prompt"] for _, c in calls(tmp_path / "calls")] == [False, True, True]
    odd = inputs.withColumn("text", F.repeat(F.lit("x"), 30_000)).unionByName(inputs.withColumns({"allowed": F.array().cast("array<string>"), "doc_id": F.lit(2).cast("long")}))
    odd = odd.unionByName(inputs.withColumns({"task": F.lit("other"), "doc_id": F.lit(3).cast("long")})).unionByName(inputs.withColumns({c: F.lit(None).cast(inputs.schema[c].dataType) for c in inputs.columns if c != "task"}))
    got = {r["doc_id"]: (r["state"], r["error"]) for r in analysis.analyse(analysis.keyed(odd, one, "normal"), one).collect()}
    assert {s for s, _ in got.values()} == {"failed"} and "TooLong" in got[1][1] and "no ids to cite" in got[2][1] and "KeyError" in got[3][1] and None in got
    assert analysis.context_window("x" * 1000, 384) == 4096 and analysis.context_window("x" * 15_000, 768) == 16384
    assert analysis.analyse(analysis.keyed(inputs.limit(0), one, "normal"), one).count() == 0
