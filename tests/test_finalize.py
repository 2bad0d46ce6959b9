"""Clusters, names, axes and result rows on a small fixture."""

import json
import math

import pytest
from pyspark.sql import functions as F

from cartolith.operators import finalize, materials

AT = {1: 0.0, 2: 0.05, 3: 1.5, 4: 1.55, 5: 3.0, 6: 3.05}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [math.cos(a), math.sin(a), 0.0, 0.0]) for i, a in AT.items()], "patent_id long, vector array<float>")


def test_finalized(spark, rows):
    def names(task, prompt):
        told = json.loads(prompt)
        return {"name": " " if told["cluster_id"] == 2 else f" {told['kind']} {told['member_count']} {told['summaries'][0]['summary']} "}

    blobs = rows.select("patent_id", materials.encode_vector(F.col("vector")).alias("blob"))
    found = finalize.clusters_from_blobs(blobs, "patent_id", "blob", 3).cache()
    by = {r["patent_id"]: r["cluster"] for r in found.collect()}
    assert by[1] == by[2] and by[3] == by[4] and by[5] == by[6] and len(set(by.values())) == 3
    summaries = rows.select("patent_id", F.concat(F.lit("s"), "patent_id").alias("summary"))
    named = finalize.cluster_names(found, summaries, "patent_id", "technology", names)
    got = {r["cluster"]: (r["members"], r["name"], r["error"]) for r in named.collect()}
    assert got == {0: (2, "technology 2 s1", None), 1: (2, "technology 2 s3", None), 2: (2, None, "name is blank")}
    axis = finalize.axis(rows, found, "patent_id", "vector", [math.cos(3.0), math.sin(3.0), 0.0, 0.0]).orderBy("position").collect()
    assert [r["cluster"] for r in axis] == [by[5], by[3], by[1]] and axis[0]["proximity"] == 1.0 and axis[2]["proximity"] == 0.0
    plain = finalize.axis(rows, found, "patent_id", "vector").collect()
    assert len(plain) == 3 and all(r["proximity"] is None for r in plain)
    extra = rows.select("patent_id").unionByName(spark.createDataFrame([(9,)], "patent_id long"))
    done = {r["patent_id"]: r for r in finalize.result_rows(extra, dict.fromkeys(finalize.KINDS, found), dict.fromkeys(finalize.KINDS, named), "patent_id").collect()}
    assert len(done) == 7 and done[1]["tech_cluster"] == "technology 2 s1" and done[3]["problem_cluster_id"] == by[3] and done[9]["tech_cluster_id"] is None
    assert finalize.axis(rows.limit(0), found, "patent_id", "vector").count() == 0


def test_one_call(spark):
    at = {**AT, 7: 0.1}
    wide = lambda a, n: [math.cos(a), 0.0, 0.0, 0.0, math.sin(a)] + [0.0] * (n - 5)  # noqa: E731  folded to 256 slots, the two stay apart
    embeddings = spark.createDataFrame([(i, wide(a, 600), wide(-a, 8)) for i, a in at.items()] + [(8, wide(0, 600), None), (9, wide(0, 600), wide(0, 8))], "doc_id long, technology array<float>, problem array<float>")
    score = {"similarity": 3, "concept_level": 4, "similarity_reason": "一部", "concept_level_reason": "少", "claim_traceability": {"similarity": 1}, "evidence_traceability": {"similarity": ["C1-E1"]}}
    artifacts = spark.createDataFrame([(i, json.dumps(score, ensure_ascii=False), json.dumps({"tech_summary": f"t{i}", "problem_summary": f"p{i}"})) for i in (*at, 8)], "doc_id long, threat_score string, summaries string")

    def names(task, prompt):
        told = json.loads(prompt)
        return {"name": f"{told['kind']} {told['member_count']} {told['summaries'][0]['summary']}"}

    got = finalize.finalized(embeddings, artifacts, names, "run-1", k=3, reference={"technology": wide(3.0, 600), "problem": wide(0.0, 8)})
    done = {r["doc_id"]: r for r in got.results.collect()}
    assert set(done) == set(at) and done[1]["tech_cluster"] == "technology 3 t1" and done[3]["problem_cluster"] == "problem 2 p3"
    assert done[1]["reasoning"] == "類似度: 一部\n権利範囲の広さ: 少" and json.loads(done[1]["claim_traceability"]) == {"similarity": 1} and (done[1]["similarity"], done[1]["concept_level"]) == (3, 4)
    assert done[1]["tech_cluster_id"] == done[2]["tech_cluster_id"] == done[7]["tech_cluster_id"] == 0
    whole = got.map.first()
    assert whole["run_id"] == "run-1" and whole["technology_order"] == ["2", "1", "0"] and whole["problem_order"] == ["0", "1", "2"]
    assert whole["technology_clusters"]["2"]["relative_strength"] == 1.0 and whole["problem_clusters"]["0"]["name"] == "problem 3 p1"
    with pytest.raises(ValueError):
        finalize.finalized(embeddings, artifacts, lambda t, p: {"name": " "}, "run-3")
    none = finalize.finalized(embeddings.limit(0), artifacts, names, "run-4")
    assert none.results.count() == 0 and none.clusters.count() == 0 and none.map.first()["technology_order"] == []
    cells = spark.createDataFrame([(t, p, tn, pn, n) for t, tn, p, pn, n in (("0", "a", "0", "x", 2), ("1", None, "0", "x", 1), ("5", "new", "1", "y", 3), ("4", None, "1", "y", 1), (None, None, "1", "y", 9))], "tech string, problem string, tech_name string, problem_name string, count long")
    shown = finalize.map_axis(cells, "technology", got.clusters).orderBy("position").collect()
    assert [(r["id"], r["name"]) for r in shown] == [("1", "technology 2 t3"), ("0", "technology 3 t1"), ("4", "4"), ("5", "new")]
    assert [r["id"] for r in finalize.map_axis(cells, "technology", got.clusters, 2).orderBy("position").collect()] == ["0", "5"] and finalize.map_axis(cells, "problem", got.clusters).count() == 2


def test_many_clusters_are_ordered_by_merged_runs(spark, monkeypatch):
    monkeypatch.setattr("cartolith.operators.vectors.EXACT_MOST", 4)
    angle = {c: 0.02 * c for c in range(40)}
    rows = spark.createDataFrame([(c, [math.cos(a), math.sin(a)], c) for c, a in angle.items()], "doc_id long, vector array<double>, cluster int")
    order = [r["cluster"] for r in finalize.axis(rows.select("doc_id", "vector"), rows.select("doc_id", "cluster"), "doc_id", "vector").orderBy("position").collect()]
    assert sorted(order) == list(angle)
    steps = sum(abs(a - b) for a, b in zip(order, order[1:]))
    assert steps <= 2.5 * 39  # of random orders about 14 * 39
    alike = [(c, [1.0, 0.0], c) for c in range(9)]
    same = spark.createDataFrame(alike, rows.schema)
    assert finalize.axis(same.select("doc_id", "vector"), same.select("doc_id", "cluster"), "doc_id", "vector").count() == 9


def test_checks(rows):
    finalize.checked_kinds(rows, rows.orderBy(F.desc("patent_id")), "patent_id")
    with pytest.raises(ValueError):
        finalize.checked_kinds(rows, rows.where("patent_id > 1"), "patent_id")
    assert finalize.company_reference(" t ", "p", lambda t: [[float(len(x))] for x in t]) == {"technology": [1.0], "problem": [1.0]}
    for args in (("", "p", lambda t: [[1.0], [1.0]]), ("t", "p", lambda t: [[1.0], [1.0, 2.0]]), ("t", "p", lambda t: [[float("nan")], [1.0]])):
        with pytest.raises(ValueError):
            finalize.company_reference(*args)
