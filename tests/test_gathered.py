"""Documents reach Python by the batch, not by a call each, and only a slice of a batch is Python objects."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolith.functions import text as T
from cartolith.operators import evidence, structure

PAGES = [(i, 1, f"【請求項1】\n部品{i}を備える装置。\n【請求項2】\n請求項1に記載の装置。\n【技術分野】\n【0001】装置{i}に関する。") for i in range(200)] + [(7, 2, "【0002】方法に関する。"), (900, 1, None)]


def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id long, page int, text string")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_claims_are_read_without_a_call_for_each_document(spark):
    found = structure.structured_claims(pages(spark))
    assert "InPandas" not in plan(found)
    want = {i: [c["text"] for c in T.claims(t or "")[0]] for i, p, t in PAGES if p == 1}
    got = {}
    for r in found.orderBy("doc_id", "number").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: c for i, c in want.items() if c} and len(got) == 200


def test_pages_of_one_number_are_taken_in_the_order_of_their_texts(spark):
    rows = [(1, 1, "【請求項2】\n乙装置。"), (1, 1, "【請求項1】\n甲装置。")]
    for given in (rows, rows[::-1]):
        got = structure.structured_claims(spark.createDataFrame(given, "doc_id long, page int, text string").repartition(1)).orderBy("number").collect()
        assert [(r["number"], r["text"]) for r in got] == [(1, "甲装置。"), (2, "乙装置。")]


def test_packs_are_made_without_a_call_for_each_document(spark):
    texts = spark.createDataFrame([(901, "予備の文。"), (7, "x")], "doc_id long, text string")
    packs = evidence.evidence_packs(structure.structured_paragraphs(pages(spark)), structure.structured_claims(pages(spark)), "装置", texts)
    assert "InPandas" not in plan(packs)
    rows = {(r["doc_id"], r["task"]): r for r in packs.collect()}
    assert len(rows) == 201 * 4 and rows[901, "similarity"]["rendered_text"] == "予備の文。" and rows[7, "similarity"]["claim_sources"] == 1
    assert "[P0001-N0005 p.1 technical_field]\n装置5に関する。" in rows[5, "similarity"]["rendered_text"] and rows[5, "similarity"]["selected_sections"]["technical_field"] == 1


def test_a_slice_of_a_batch_is_objects_at_once(spark, tmp_path):
    """The builder is called slice by slice: a text's result is Arrow before those of later slices are made."""
    held = structure._sliced(lambda t: {"n": len(t)}, "struct<n:int>")
    got = spark.range(500).repartition(1).select("id", held(F.when(F.col("id") % 5 > 0, F.col("id").cast("string"))).alias("s")).collect()
    assert len(got) == 500 and all(r["s"]["n"] == (len(str(r["id"])) if r["id"] % 5 else 0) for r in got)


def test_pages_leave_python_by_the_slice(spark, monkeypatch):
    """A batch of pages comes back in parts, so what one holds in Python does not grow with Spark's batches."""
    given = []
    monkeypatch.setattr(structure, "cut", lambda df, name: given.append(df) or df)
    rows = structure._read(pages(spark).repartition(1))
    assert "MapInArrow" in plan(rows) and "ArrowEvalPython" not in plan(rows) and given == [rows]
    assert rows.count() == 202 and structure.AT_ONCE < 200


def test_near_texts_meet_in_blocks(spark, monkeypatch):
    """Blocks, tiles and slices of columns that cut through a class lose no pair and give none twice; nothing joins by trigram."""
    for name, size in (("BLOCK", 20), ("TILE", 7), ("COLUMNS", 5), ("RARE", 30)):
        monkeypatch.setattr(evidence, name, size)
    rng, texts = random.Random(3), []
    for n in (2, 9, 10, 40):
        words = ["".join(rng.choice("aeiost") for _ in range(4)) for _ in range(n)]
        texts += [" ".join(w if rng.random() > 0.04 else "q" + w for w in words) for _ in range(60)]
    grams = [T.ngrams(t, 3) for t in texts]
    first = {frozenset(g): i for i, g in reversed(list(enumerate(grams)))}
    own = sorted(first.values())
    want = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in own for j in own if i < j and len(grams[i] & grams[j]) >= 0.82 * len(grams[i] | grams[j])}
    want |= {(first[frozenset(g)], i): 1.0 for i, g in enumerate(grams) if first[frozenset(g)] != i}
    got = evidence.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert "FlatMapGroupsInArrow" in plan(got) and "cast(g#" not in plan(got)
    rows = got.collect()
    assert len(rows) == len(want) > 500 and {(r["a"], r["b"]): r["jaccard"] for r in rows} == pytest.approx(want)
    x = pa.array([[1, 2, 3], [], [7], [2, 3]], pa.list_(pa.int64()))
    assert np.array_equal(evidence.shared_counts(x, x.slice(2)), [[0, 2], [0, 0], [1, 0], [0, 2]])


def shuffled(spark, run):
    """Rows that the stages of `run` give to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        held = sc.statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {held.apply(i).stageId(): held.apply(i).shuffleWriteRecords() for i in range(held.size())}

    before = stages()
    run()
    return sum(v for k, v in stages().items() if k not in before)


def test_near_texts_are_not_shuffled_once_for_each_block(spark, monkeypatch):
    """Four times the texts of a size are four times the blocks, and give four times the rows to shuffles, not sixteen."""
    monkeypatch.setattr(evidence, "BLOCK", 25)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aeioustnrl") for _ in range(4)) for _ in range(60)) for _ in range(800)]
    given = [spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string") for n in (200, 800)]
    few, many = (shuffled(spark, lambda: evidence.near_duplicate_pairs(df, "doc_id", "text").write.format("noop").mode("overwrite").save()) for df in given)
    assert 0 < many < 6 * few


def test_sketches_bound_what_differs(spark):
    """Tiles of any sketch widths, and any number of words at once, give what sets give; a tile that is written is read as it was."""
    rng, texts = random.Random(6), [None, "ab", "𝒳𠀋𠀌", "ABC abc"]
    for n in (3, 30, 300):
        words = ["".join(rng.choice("aeiou𠀋") for _ in range(5)) for _ in range(n)]
        texts += [" ".join(w for w in words if rng.random() > 0.06) for _ in range(20)]
    grams = [T.ngrams(t or "", 3) for t in texts]
    assert [evidence.gram_text(t or "") for t in texts] == ["".join(sorted(g)) for g in grams]
    own = [i for i, g in enumerate(grams) if g]
    parts = [[i for i in own if low <= len(grams[i]) < high] for low, high in ((1, 40), (40, 200), (200, 9999))]
    tiles = [evidence.Tile.of(np.array(p), np.array([len(grams[i]) for i in p], np.int32), "".join(evidence.gram_text(texts[i]) for i in p)) for p in parts]
    assert len({t.bits.shape[1] for t in tiles}) == 3
    batch = pa.RecordBatch.from_pylist([{f"x_{k}": v for k, v in t.row().items()} for t in tiles])
    tiles = [evidence.Tile.read(batch, i, "x_") for i in range(3)]
    for least in (0.82, 0.3, 0.01):
        want = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in own for j in own if i < j and len(grams[i] & grams[j]) >= least * len(grams[i] | grams[j])}
        found = [r for a in range(3) for b in range(a, 3) for r in evidence.near_sets(tiles[a], tiles[b], least).to_pylist()]
        assert len(found) == len(want) > 100 and {(r["a"], r["b"]): r["jaccard"] for r in found} == pytest.approx(want)
    x, y = tiles[1], tiles[2]
    k, m = (v.ravel() for v in np.indices((len(x.ids), len(y.ids))))
    assert np.array_equal(evidence.counted(x, y, k, m), evidence.shared_counts(x.sets(), y.sets()).ravel())


def test_runs_sort_a_group_once(spark):
    from cartolith.plans import catalogue

    runs = catalogue.claim_run_islands(spark, "/root/testdata/sf0.001")
    runs.collect()
    p = runs._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in p.split("== Initial Plan ==")[0].splitlines() if " Sort [" in line]
    assert sum("l_orderkey" in line for line in sorts) == 1 and not any(" p#" in line for line in sorts)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from cartolith.operators import replacement

    monkeypatch.setattr(replacement, "FILE_ROWS", 20, raising=False)
    columns = "patent_id long, position long, title string, organization_ids array<string>"
    research = replacement.Research(spark, f"file://{tmp_path}/s", "r", columns, buckets=1)
    rows = [(i, i, f"item {i} of the list", [f"o{i % 3}"]) for i in range(300)]
    research.replace(spark.createDataFrame(rows, columns), spark.createDataFrame([(f"o{i}", "n") for i in range(3)], "organization_id string, name string"))
    assert len(research.documents().inputFiles()) > 3 and research.documents().count() == 300
    assert [r["document_count"] for r in research.organizations().collect()] == [100] * 3
    assert {r["patent_id"] for r in research.find("item 7").collect()} == {7, *range(70, 80)}
