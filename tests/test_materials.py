"""Document assembly, page texts, logs and digests on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cartolith.operators import assembly, materials, trend
from cartolith.operators.model import DocumentFilter

ANALYSIS = "similarity int, concept_level int, tech_summary string, problem_summary string, reasoning string, tech_cluster string, problem_cluster string, tech_cluster_id string, problem_cluster_id string"
FULL, PART, NONE = (4, 5, "t", "p", "r", "T", "P", "1", "2"), (4, *[None] * 8), (None,) * 9


def given(pdf, subresearch=None, **more):
    names = [c.split()[0] for c in assembly.GIVEN.split(", ")]
    return tuple({"research_id": "r", "pdf": pdf, "position": 1, "subresearch": subresearch, **more}.get(n) for n in names)


def test_assembled_documents(spark):
    rows = spark.createDataFrame(
        [given("a.pdf", application_date="2019-1-2", year=2000), given("b.pdf", "old"), given("c.pdf"), given("d.pdf"), given("e.pdf", title="E", year=2001), given("f.pdf"), given("g.txt"), given("特開2001-1.pdf"), given("特開2001－1.pdf"), given("h.pdf", "old")], assembly.GIVEN
    )
    results = spark.createDataFrame([("r", "a", None, *FULL), ("r", "a", "old", *PART), ("r", "b", "old", *FULL), ("r", "c", "old", *FULL), ("r", "h", "other", *FULL)], f"research_id string, id string, subresearch string, {ANALYSIS}")
    stored = spark.createDataFrame([("r", "a", *NONE), ("r", "c", *PART), ("r", "d", *NONE)], f"research_id string, id string, {ANALYSIS}")
    skips = spark.createDataFrame([("r", "d", None, "by hand", "x"), ("r", "f", None, "by hand", "x")], "research_id string, id string, subresearch string, reason string, detail string")
    pool = spark.createDataFrame([(f"{c}.pdf",) for c in "abcdeh"] + [("a.pdf",)], "pdf string")
    got = {r["pdf"]: r for r in assembly.assembled_documents(rows, results, stored, skips, pool).collect()}
    assert len(got) == rows.count()
    state = {k: (v["analysis_state"], v["skip_reason"], v["problem"]) for k, v in got.items()}
    assert state["a.pdf"] == ("ready", None, None) and state["b.pdf"] == ("ready", None, None)
    assert state["c.pdf"] == ("invalid", None, None) and state["h.pdf"] == ("pending", None, None)  # another group's result is not theirs
    assert state["d.pdf"] == ("skipped", "by hand", None) and state["f.pdf"] == ("skipped", "pdf_not_found", None)
    assert state["g.txt"][2] == "not_pdf" and state["特開2001-1.pdf"][2] == state["特開2001－1.pdf"][2] == "duplicate"
    assert (got["a.pdf"]["year"], got["a.pdf"]["year_source"]) == (2019, "application_date")
    assert (got["e.pdf"]["year"], got["e.pdf"]["year_source"], got["e.pdf"]["title"], got["b.pdf"]["title"]) == (2001, "legacy", "E", "b")
    assert got["b.pdf"]["applicant"] == "未設定" and got["b.pdf"]["category"] == "未分類" and got["特開2001-1.pdf"]["status"] == "published"
    empty = assembly.assembled_documents(rows.limit(0), results, stored, skips, pool)
    assert empty.count() == 0


def test_results_count_by_their_fields(spark):
    full = {f: "x" for f in assembly.REQUIRED} | {"similarity": 3, "concept_level": 2}
    files = [("a", "{}"), ("b", '{"other": 1}'), ("c", json.dumps(full | {"reasoning": None})), ("d", json.dumps({"similarity": 1})), ("e", "{"), ("f", "[1]"), ("g", json.dumps(full | {"tech_summary": "new"})), ("g", json.dumps(full | {"tech_summary": "old"}))]
    made = spark.createDataFrame([("r", i, None, p, 10 - n) for n, (i, p) in enumerate(files)], "research_id string, id string, subresearch string, payload string, modified long")
    results = assembly.parsed_results(made)
    rows = spark.createDataFrame([given(f"{c}.pdf") for c in "abcdefgh"], assembly.GIVEN)
    stored = spark.createDataFrame([("r", "h", *FULL)], f"research_id string, id string, {ANALYSIS}")
    skips = spark.createDataFrame([], "research_id string, id string, subresearch string, reason string, detail string")
    pool = spark.createDataFrame([(f"{c}.pdf",) for c in "abcdefgh"], "pdf string")
    got = {r["pdf"][0]: r for r in assembly.assembled_documents(rows, results, stored, skips, pool).collect()}
    assert {k: v["analysis_state"] for k, v in got.items()} == {"a": "pending", "b": "invalid", "c": "ready", "d": "invalid", "e": "pending", "f": "pending", "g": "ready", "h": "ready"}
    assert {k for k, v in got.items() if v["problem"] == "result_not_json"} == {"e", "f"} and got["g"]["tech_summary"] == "new" and got["c"]["similarity"] == 3 and got["c"]["reasoning"] is None



def test_states(spark):
    docs = spark.createDataFrame([(1, "pending", None, None, "x"), (2, "ready", None, None, "y")], "id int, analysis_state string, skip_reason string, skip_detail string, title string")
    new = spark.createDataFrame([(1, "skipped", "short", "d"), (3, "ready", None, None)], "id int, analysis_state string, skip_reason string, skip_detail string")
    got = {r["id"]: tuple(r) for r in assembly.with_state(docs, new, ["id"]).collect()}
    assert got == {1: (1, "skipped", "short", "d", "x"), 2: (2, "ready", None, None, "y")}
    assert materials.point(docs, id=2).first()["title"] == "y" and materials.point(docs, id=9).count() == 0


def test_texts_and_extractions(spark):
    pages = spark.createDataFrame([(1, 2, "b" * 300), (1, 1, "a" * 300), (2, 1, "short"), (3, 1, None)], "doc_id long, page int, text string")
    texts = materials.document_texts(pages)
    got = {r["doc_id"]: r for r in texts.collect()}
    assert got[1]["text"] == "a" * 300 + "\n\n" + "b" * 300 and got[1]["skip_reason"] is None and got[1]["pages"] == 2
    assert got[2]["skip_reason"] == got[3]["skip_reason"] == materials.TOO_SHORT and got[3]["characters"] == 0
    index = materials.extraction_index(texts.withColumn("run", F.lit("x")), ["run"]).first()
    assert (index["documents"], index["pages"], index["characters"], index["skipped"]) == (3, 4, 607, 2)
    files = spark.createDataFrame([("b", bytearray(b"1")), ("a", bytearray(b"1")), ("c", bytearray(b"2"))], "path string, content binary")
    cache = spark.createDataFrame([(hashlib.sha256(b"2").hexdigest(),)], "sha256 string")
    assert [r["path"] for r in materials.missing_extractions(files, cache).collect()] == ["a"]


def test_digests(spark):
    rows = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a"), ("s", 1, None)], "research_id string, position int, pdf string")
    got = {r["research_id"]: (r["documents"], r["fingerprint"]) for r in materials.ordered_fingerprint(rows, "research_id", ["position"], "pdf").collect()}
    assert got == {"r": (2, hashlib.sha256(b"a\nb\n").hexdigest()), "s": (1, hashlib.sha256(b"\n").hexdigest())}
    assert materials.ordered_fingerprint(rows.limit(0), "research_id", ["position"], "pdf").count() == 0
    files = spark.createDataFrame([("r", "x", "1"), ("r", "y", None)], "g string, path string, sha256 string")
    sign = lambda f: materials.source_signature(f, "g").first()["signature"]
    assert sign(files) == sign(files.orderBy(F.desc("path"))) != sign(files.where("path = 'x'"))


def test_small_columns(spark):
    row = spark.range(1).select(
        materials.split_values(F.lit(" a,b\n、c ")).alias("s"), materials.percent(F.lit(1), F.lit(8)).alias("p"), materials.percent(F.lit(1), F.lit(0)).alias("z"),
        materials.encode_vector(F.array(F.lit(1.0), F.lit(-2.5))).alias("e"), materials.encode_vector(F.lit(None).cast("array<double>")).alias("n"),
    ).first()
    assert row["s"] == ["a", "b", "c"] and (row["p"], row["z"]) == (13, 0) and bytes(row["e"]).hex() == "0000803f000020c0" and row["n"] is None
    assert spark.sql("SELECT cast(null AS string) AS p").select(materials.score_problem(F.col("p")).alias("e")).first()["e"] == "not_json"


def test_cell_of():
    where = DocumentFilter(similarity=1, concept_level=2, tech_cluster_id="3", year_from=1999)
    assert trend.cell_of(where, "threat") == DocumentFilter(similarity=1, concept_level=2, year_from=1999)
    for kind in ("technology", "other"):
        with pytest.raises(ValueError):
            trend.cell_of(where, kind)
