"""Requests that change the small tables, carried out or refused."""

from cartolith.operators import mutations

G, O1, O2, O3 = "group_0123456789abcdef", "org_" + "1" * 16, "org_" + "2" * 16, "org_" + "3" * 16


def test_researches_are_created(spark):
    old = spark.createDataFrame([("r0", "R", "", "c", "archived", 1, 1)], "research_id string, name string, description string, company_technology string, lifecycle_status string, created_at long, updated_at long")
    asked = [
        (" r1 ", " One ", None, "tech", 3, 5), ("r1", "later", "", "tech", 3, 9), ("r0", "again", "", "tech", 3, 5), ("-x", "bad", "", "tech", 3, 5), ("r2", " ", "", "tech", 3, 5), ("r3", "n" * 121, "", "tech", 3, 5),
        ("r4", "n", "d" * 2001, "tech", 3, 5), ("r5", "n", "", " ", 3, 5), ("r6", "n", "", "tech", 0, 5), (None, "n", "", "tech", 3, 5), ("r7", "n", "", "tech", None, 5), ("r8", "n" * 120, "d" * 2000, "t" * 20000, 1, None),
    ]
    requests = spark.createDataFrame(asked, "research_id string, name string, description string, company_technology string, documents long, at long")
    table, refused = mutations.created_researches(old, requests)
    assert {r["research_id"]: (r["name"], r["lifecycle_status"], r["created_at"]) for r in table.collect()} == {"r0": ("R", "archived", 1), "r1": ("One", "active", 5), "r8": ("n" * 120, "active", None)}
    assert sorted((r["research_id"], r["problem"]) for r in refused.collect()) == [("", "id"), ("-x", "id"), ("r0", "exists"), ("r1", "exists"), ("r2", "name"), ("r3", "name"), ("r4", "description"), ("r5", "company_technology"), ("r6", "no_documents"), ("r7", "no_documents")]
    again, none = mutations.created_researches(old, requests.limit(0))
    assert again.count() == 1 and none.count() == 0


def test_groups_are_saved_and_deleted(spark):
    schema = "id string, name string, member_ids array<string>, members array<struct<id:string,name:string>>, note string, verified boolean, created_at long, updated_at long"
    other = G[:-1] + "0"
    old = spark.createDataFrame([(G, "old", [O1, O2], [(O1, "A"), (O2, "B")], "", True, 1, 1), (other, "gone", [O1, O2], [], "", False, 1, 1)], schema)
    asked = [
        ("save", G, " New ", None, [O1, O3, O1], [(O3, " C "), (O2, "not a member")], None, 7), ("save", G, "older", "", [O1, O2], None, True, 6), ("delete", other, None, None, None, None, None, 7), ("delete", G[:-1] + "9", None, None, None, None, None, 7),
        ("save", "group_x", "n", "", [O1, O2], None, None, 7), ("save", G[:-1] + "1", "", "", [O1, O2], None, None, 7), ("save", G[:-1] + "2", "n", "", [O1, O1], None, None, 7), ("save", G[:-1] + "3", "n", "", [O1, "org_x"], None, None, 7),
        ("save", G[:-1] + "4", "n", "x" * 2001, [O1, O2], None, None, 7), ("rename", G, "n", "", [O1, O2], None, None, 8), (None, G, "n", "", [O1, O2], None, None, 8),
    ]
    table, refused = mutations.saved_groups(old, spark.createDataFrame(asked, "action string, id string, name string, note string, member_ids array<string>, members array<struct<id:string,name:string>>, verified boolean, at long"))
    got = table.collect()
    assert [(r["id"], r["name"], r["member_ids"], [tuple(m) for m in r["members"]], r["verified"], r["created_at"], r["updated_at"]) for r in got] == [(G, "New", [O1, O3], [(O1, O1), (O3, "C")], False, 1, 7)]
    assert sorted(r["problem"] for r in refused.collect()) == ["action", "action", "id", "members", "members", "name", "not_found", "note"]


def test_notes_metadata_and_maps(spark):
    old = spark.createDataFrame([("r", 1, "a", "human", 1)], "research_id string, patent_id long, note string, source string, updated_at long")
    documents = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "research_id string, patent_id long")
    asked = [("r", 1, " b ", None, 3), ("r", 1, "older", "model", 2), ("r", 2, "x" * 20_000, "model", 1), ("r", 3, "x" * 20_001, "model", 1), ("r", 3, " ", None, 1), ("r", 3, "n", "robot", 1), ("r", 9, "n", None, 1), (None, 1, "n", None, 1)]
    table, refused = mutations.saved_interpretations(old, spark.createDataFrame(asked, "research_id string, patent_id long, note string, source string, at long"), documents)
    assert {(r["patent_id"], r["note"][:3], r["source"]) for r in table.collect()} == {(1, "b", "human"), (2, "xxx", "model")}
    assert sorted(r["problem"] for r in refused.collect()) == ["no_document", "no_document", "note", "note", "source"]
    kept = mutations.put_metadata(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", None, 1), (None, "x", 1)], "key string, value string, at long"))
    assert {tuple(r) for r in kept.collect()} == {("a", "1"), ("b", "4"), ("c", None)}
    researches = spark.createDataFrame([("r", "{}", 1), ("s", "{}", 1)], "research_id string, technology_map string, updated_at long")
    maps = spark.createDataFrame([("r", '{"x":1}', 5), ("r", "old", 4), ("none", "{}", 9)], "research_id string, technology_map string, at long")
    assert {tuple(r) for r in mutations.with_technology_maps(researches, maps).collect()} == {("r", '{"x":1}', 5), ("s", "{}", 1)}
