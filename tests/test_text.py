"""Numbers, text structure, evidence and checks on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from cartolith.functions import numbers as N
from cartolith.functions import text as T
from cartolith.operators import evidence, grounding, lifecycle, structure, trend, vectors
from cartolith.sources import patent_list
from cartolith.streaming import ingest


def test_numbers(spark):
    rows = [("特開２０２４－００１２３４",), ("特開平10-1234",), ("特許第7654321号",), ("WO2021/012345",), (None,)]
    n = N.publication_number(F.col("v"))
    got = spark.createDataFrame(rows, "v string").select(n.alias("n")).select(N.match_key(F.col("n")).alias("k"), N.infer_year(F.col("n")).alias("y"), N.infer_status(F.col("n")).alias("s")).collect()
    assert [r["k"] for r in got] == ["JP_A:2024:1234", "JP_A_H:10:1234", "JP_B:7654321", "WO:2021:12345", None]
    assert [r["y"] for r in got] == [2024, 1998, None, 2021, None]
    assert [r["s"] for r in got][:4] == ["published", "published", "registered", "published"]


def test_applicants_and_dates(spark):
    df = spark.createDataFrame([("甲社；乙社\n甲社", "2024.01.02", "特開2024-1, WO2024-2", "2024.03.04")], "a string, d string, n string, p string")
    r = df.select(N.organizations(F.col("a")).alias("o"), N.application_year(F.col("d")).alias("y"), N.publications(F.col("n"), F.col("p")).alias("p")).first()
    assert [o["name"] for o in r["o"]] == ["甲社", "乙社"] and r["y"] == 2024
    assert [(p["number"], p["date"], p["kind"]) for p in r["p"]] == [("特開2024-1", "2024-03-04", "domestic"), ("WO2024-2", None, "wo")]


def test_claims():
    text = "【請求項１】\n入力部と、処理部とを備える装置。\n【請求項２】\n請求項１に記載の装置。\n【請求項３】\n請求項１から２のいずれかに記載の方法。\n【請求項１】\n別の装置。\n【発明の詳細な説明】\n説明。"
    found, check = T.claims(text)
    assert [c["number"] for c in found] == [1, 2, 3] and [c["depends_on"] for c in found] == [[], [1], [1, 2]]
    assert check["valid"] and check["ignored_headers"] == 1
    assert T.dependencies("前項に記載の装置", 4) == [3] and T.dependencies("先行する請求項に記載", 3) == [1, 2]
    assert [e["element_id"] for e in T.elements("入力部と、処理部と、出力部とを備える装置", 1)] == ["C1-E1", "C1-E2", "C1-E3"]
    assert T.validate_claims([])["errors"] == ["claims_not_found"]


def test_references_to_claims():
    cases = {
        "請求項1から3、5に記載の装置": [1, 2, 3, 5], "請求項２〜４のいずれか": [2, 3, 4], "請求項1又は請求項3に記載の": [1, 3], "請求項1、2の装置": [1],
        "請求項5-2に記載": [2, 3, 4, 5], "請求項3から請求項5の": [3, 4, 5], "請求項9に記載": [], "": [],
    }
    assert {t: T.dependencies(t, 7) for t in cases} == cases


def test_units_end_at_marks_and_brackets():
    page = "【発明の名称】\n制御装置\n構成は次の通り：\n入力部；\n出力部\n\n続き(1)\n【0001】本文\nである。"
    assert T.units(page) == ["【発明の名称】", "制御装置構成は次の通り：", "入力部；", "出力部", "続き(1)", "【0001】本文である。"]


def test_paragraphs(spark):
    pages = [(7, p, f"製品名\n{'【技術分野】' if p == 1 else ''}\n【000{p}】本発明は装置{p}に\n関する。\n同じ文である。\n頁の足") for p in (1, 2, 3)]
    pages += [(7, 4, ""), (7, 5, None), (8, 1, "図面において同一の部材に同一の符号を付す。"), (9, 1, None)]
    df = spark.createDataFrame(pages, "doc_id long, page int, text string")
    rows = structure.structured_paragraphs(df).orderBy("doc_id", "position").collect()
    found = [r for r in rows if r["doc_id"] == 7]
    assert "製品名" not in "".join(p["text"] for p in found)
    assert [p["paragraph_id"] for p in found] == ["P0001-N0001", "P0001-N0002", "P0002-N0001", "P0002-N0002", "P0003-N0001", "P0003-N0002"]
    assert found[0]["text"] == "本発明は装置1に関する。" and found[0]["paragraph_number"] == "0001" and {p["section"] for p in found} == {"technical_field"}
    assert found[0]["sha256"] == T.digest(found[0]["text"]) and found[0]["characters"] == len(found[0]["text"]) and found[0]["roles"] == ["component"]
    same = [p for p in found if p["text"] == "同じ文である。"]
    assert [p["duplicate_of"] for p in same] == [None, "P0001-N0002", "P0001-N0002"] and same[0]["roles"] == ["context"]
    assert [(r["boilerplate"], r["section"]) for r in rows if r["doc_id"] == 8] == [(True, "unclassified")]
    stats = {r["doc_id"]: r.asDict() for r in structure.structure_statistics(df).collect()}
    characters = sum(p["characters"] for p in found)
    assert stats[7] == {"doc_id": 7, "pages": 5, "removed_page_headers": 0, "removed_repeated": 6, "paragraphs": 6, "unique": 4, "duplicate": 2, "boilerplate": 0, "characters": characters}
    assert stats[9]["pages"] == 1 and stats[9]["paragraphs"] == 0 and stats[8]["boilerplate"] == 1
    assert T.chunks("a" * 2500 + "\n\n" + "b" * 10, 1000) == ["a" * 1000, "a" * 1000, "a" * 500 + "\n\n" + "b" * 10]


def test_runs_of_rows_and_lists(spark):
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate([1, 2, 3, 1, 2, 9, 1, 2, 3])], "g string, p long, n int")
    r = structure.longest_runs(rows, ["g"], "p", "n").first()
    assert (r["run_start"], r["run_length"]) == (0, 3) and T.longest_run([1, 2, 3, 1, 2, 9, 1, 2, 3]) == (0, 3)


def test_evidence_packs(spark):
    pages = spark.createDataFrame([(1, 1, "【請求項１】\n制御部を備える装置。\n【課題を解決するための手段】\n【0001】制御部が信号を処理する。\n【0002】制御部が信号を処理する！")], "doc_id long, page int, text string")
    packs = {r["task"]: r for r in evidence.evidence_packs(structure.structured_paragraphs(pages), structure.structured_claims(pages), "制御部が信号を処理").collect()}
    assert set(packs) == {"similarity", "concept_level", "problem_summary", "technology_summary"}
    assert "制御部" in packs["similarity"]["rendered_text"] and all(len(p["rendered_text"]) <= p["maximum"] for p in packs.values())
    assert packs["concept_level"]["rendered_text"].startswith("## 独立請求項\n【請求項1】\n[C1-E1 ") and packs["concept_level"]["sources"][0]["element_ids"] == ["C1-E1", "C1-E2", "C1-E3"]
    assert packs["problem_summary"]["rendered_text"] == "" and packs["similarity"]["near_duplicates"] == 1
    texts = spark.createDataFrame([(1, "予備の文。"), (2, "あ" * 7000 + "。" + "い" * 9000), (3, None)], "doc_id long, text string")
    more = {(r["doc_id"], r["task"]): r["rendered_text"] for r in evidence.evidence_packs(structure.structured_paragraphs(pages), structure.structured_claims(pages), "", texts).collect()}
    assert more[1, "problem_summary"] == "予備の文。" and more[2, "similarity"] == "あ" * 7000 + "。" and more[3, "concept_level"] == "" and len(more) == 12


def test_packing_passes_over_near_copies_and_long_blocks():
    row = lambda n, text, score, section="solution": {"paragraph_id": f"P0001-N{n:05d}", "position": n, "text": text, "score": score, "section": section, "block": f"[{n}]\n{text}"}
    one, two, three = "制御部が信号を処理して出力する装置である", "センサの測定値から温度を推定する方法である", "表示部に結果を示す"
    rows = [row(10_000, one, 5.0), row(9_999, two, 5.0), row(3, one + "。", 4.0), row(4, "長" * 300, 3.0), row(5, three, 2.0), row(6, "別の文", 1.0)]
    taken, near = evidence.chosen(rows, 200, {"solution": 3})
    assert [r["position"] for r in taken] == [9_999, 10_000, 5] and near == 1
    grams = [T.ngrams(t, 3) for t in (one, one + "。", "")]
    assert len(grams[0] & grams[1]) >= evidence.NEAR * len(grams[0] | grams[1]) and evidence.chosen([row(1, "", 1.0), row(2, "", 1.0)], 100, {})[1] == 0


def test_claims_are_cut_where_the_budget_ends():
    blocks = [(1, "a" * 30 + "。" + "b" * 30, ["C1-E1"]), (2, "[C2-E1 x] c", ["C2-E1"]), (3, "d" * 50, [])]
    got = list(evidence.shown_claims(blocks, 50))
    assert [t for t, _ in got] == ["a" * 30 + "。", "[C2-E1 x] c", "d" * 4] and [s["element_ids"] for _, s in got] == [[], ["C2-E1"], []]
    assert list(evidence.shown_claims(blocks, 0)) == []


def test_directions(spark):
    cases = {"unobserved": (0, 0, None, 0, 0), "undated": (3, 0, None, 0, 0), "sparse": (2, 2, 2001, 0, 2), "emerging": (5, 5, 2009, 5, 0), "growing": (15, 15, 2000, 8, 4), "declining": (12, 12, 2000, 2, 6), "stable": (12, 12, 2000, 5, 5)}
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "k string, total int, dated int, first int, recent int, previous int")
    label = trend.direction(F.col("total"), F.col("dated"), F.col("first"), F.lit(2010), F.col("recent"), F.col("previous"))
    assert all(r["k"] == r["d"] for r in df.select("k", label.alias("d")).collect())


def test_vectors():
    x = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99]])
    assert vectors.agglomerate(["a", "b", "c", "d"], x, 2) == {"a": 0, "b": 0, "c": 1, "d": 1}
    assert vectors.semantic_order(["a", "b", "c"], np.array([[1, 0], [0.7, 0.7], [0, 1]])) in (["a", "b", "c"], ["c", "b", "a"])
    many = np.random.default_rng(1).normal(size=(600, 8))
    keys = [str(i) for i in range(600)]
    assert vectors.mini_batch(keys, many, 7) == vectors.mini_batch(keys, many, 7)


def test_mini_batches_match_a_plain_loop():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 700)] + 0.3 * rng.normal(size=(700, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k, size = 12, 128
    centre = {c: u[i] for c, i in enumerate(sorted(np.random.default_rng(0).choice(700, k, replace=False)))}
    members = dict.fromkeys(centre, 0)
    for _ in range(8):
        for at in range(0, 700, size):
            of = [max(centre, key=lambda c: (v @ centre[c], -c)) for v in u[at : at + size]]
            for c in set(of):
                mine = [v for v, o in zip(u[at : at + size], of) if o == c]
                centre[c] = (members[c] * centre[c] + np.sum(mine, 0)) / (members[c] + len(mine))
                members[c] += len(mine)
            centre = {c: v / np.linalg.norm(v) for c, v in centre.items()}
    got = vectors.mini_batch([str(i) for i in range(700)], x, k)
    want = {str(i): max(centre, key=lambda c: (v @ centre[c], -c)) for i, v in enumerate(u)}
    assert sum(got[i] != want[i] for i in got) <= 3  # 32-bit sums


def test_model_boundary(spark):
    schema = {"type": "object", "required": ["score"], "properties": {"score": {"type": "integer", "minimum": 1, "maximum": 5}}, "additionalProperties": False}
    assert grounding.schema_error({"score": True}, schema) and grounding.schema_error({"score": 9}, schema) and not grounding.schema_error({"score": 3}, schema)
    inputs = spark.createDataFrame([(1, "t", "good"), (2, "t", "bad"), (3, "t", "x")], "doc_id long, task string, prompt string")
    out = grounding.generate(inputs, lambda t, p: {"score": 3 if p == "good" else 9}, schema)
    assert {r["doc_id"]: (r["error"], r["attempts"]) for r in out.collect()} == {1: (None, 1), 2: ("$.score: above maximum", 3), 3: ("$.score: above maximum", 3)}


def test_upserts_do_not_depend_on_the_order_of_rows(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, updated_at int")
    new = [(1, "x", 1), (1, "y", 3), (1, "z", 2), (3, "p", 1), (3, "q", 1)]
    runs = [sorted(map(tuple, lifecycle.put_artifacts(old, spark.createDataFrame(n, old.schema), ["k"]).collect())) for n in (new, new[::-1])]
    assert runs[0] == runs[1] and runs[0][:2] == [(1, "y", 3), (2, "b", 0)] and len(runs[0]) == 3


def test_ingestion_keeps_documents_that_a_file_does_not_hold(spark, tmp_path):
    schema = "research_id string, patent_id long, updated_at int, title string"
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"

    def take(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest.ingest_partitions(spark, source, schema, target, f"{tmp_path}/checkpoint").awaitTermination()
        return {(r["research_id"], r["patent_id"]): r["title"] for r in spark.read.schema(schema).parquet(target).collect()}

    assert take([("a", 1, 1, "one"), ("a", 2, 1, "two"), ("b", 1, 1, "other"), (None, 1, 1, "none")]) == {("a", 1): "one", ("a", 2): "two", ("b", 1): "other", (None, 1): "none"}
    assert take([("a", 2, 2, "newer"), ("a", 3, 1, "three"), ("a", 1, 0, "older"), (None, 2, 1, "none too")]) == {("a", 1): "one", ("a", 2): "newer", ("a", 3): "three", ("b", 1): "other", (None, 1): "none", (None, 2): "none too"}


def test_list_files(spark, tmp_path):
    from cartolith.functions.vocabulary import CSV_COLUMNS

    body = ",".join(CSV_COLUMNS) + "\r\n1,0.5,特願2024-1,2024.01.02,特開2024-1234,2024.03.04,,,甲社,①装置～,公開\r\n\r\n1,abc,,,a,,,,,,\r\n1,2,3,4,5,6,7,8,9,10,11,12\r\n"
    (tmp_path / "patent_list_20240102030405.csv").write_bytes(body.encode("cp932"))
    (tmp_path / "patent_list_20240102030406.csv").write_bytes(b"\x81")
    rows = patent_list.read_lists(spark, str(tmp_path))
    assert sorted(r["error"] or "" for r in rows.collect()) == ["", "", "encoding", "extra_cells"]
    assert {r["warning"] for r in patent_list.list_warnings(rows).collect()} == {"duplicate_no", "publication_date_count_mismatch", "invalid_ai_score"}
    docs = patent_list.documents_from_list(rows, "r").orderBy("position").collect()
    assert docs[0]["title"] == "①装置～" and docs[0]["year"] == 2024 and docs[1]["source_ai_score"] is None
