"""Lists that supersede each other, the audit stream, and files routed to sinks."""

import datetime
import json
import random


from cartolith.operators import list_history
from cartolith.sources import artifacts
from cartolith.streaming import audit

ROW = "research_id string, list_id string, listed_at timestamp, patent_id long, title string, year int, extra string"
T0 = datetime.datetime(2024, 1, 1)
CONTENT = ["title", "year"]


def day(n):
    return T0 + datetime.timedelta(days=n)


def plain_spans(rows):
    """Spans by walking through each research's lists."""
    out = set()
    for r in {x[0] for x in rows}:
        lists = sorted({(x[2], x[1]) for x in rows if x[0] == r})
        state = {}
        for at, name in lists:
            now = {}
            for x in sorted((x for x in rows if x[0] == r and (x[2], x[1]) == (at, name)), key=lambda x: (x[4] is not None, x[4] or "", x[5] is not None, x[5] or 0)):
                now.setdefault(x[3], (x[4], x[5]))
            for k in list(state):
                if now.get(k) != state[k][0]:
                    c, since, came = state.pop(k)
                    out.add((r, k, *c, since, at, came))
            for k, c in now.items():
                state.setdefault(k, (c, at, name))
        out |= {(r, k, *c, since, None, came) for k, (c, since, came) in state.items()}
    return out


def test_history_and_its_growth(spark):
    rng = random.Random(2)
    rows = [(r, f"l{n}", day(n), k, rng.choice(["a", "b", None]), rng.choice([1, None]), "x") for r in ("p", None) for n in range(5) for k in rng.sample(range(6), rng.randint(1, 5))]
    rows += [("p", "l2", day(2), 1, "b", 9, "repeat"), ("q", "only", day(1), 7, "z", 1, "x")]
    frame = lambda own: spark.createDataFrame(own, ROW)
    whole = list_history.history(frame(rows), CONTENT)
    assert set(map(tuple, whole.collect())) == plain_spans(rows) and whole.columns == ["research_id", "patent_id", *CONTENT, *list_history.SPAN]
    grown = list_history.history(frame([r for r in rows if r[2] <= day(1)]), CONTENT)
    for n in (2, 3, 4):
        step = spark.createDataFrame(grown.collect(), grown.schema)
        grown = list_history.superseded(step, frame([r for r in rows if r[2] == day(n)]), CONTENT)
    assert set(map(tuple, grown.collect())) == plain_spans(rows)
    late = list_history.superseded(grown, frame([("p", "old", day(0), 99, "late", 1, "x")]), CONTENT)
    assert set(map(tuple, late.collect())) == plain_spans(rows)
    for n in range(5):
        held = {(r["research_id"], r["patent_id"]) for r in list_history.as_of(whole, str(day(n))).collect()}
        assert held == {(r[0], r[3]) for r in rows if r[2] == day(n)} | ({("q", 7)} if n >= 1 else set())
    assert list_history.history(frame([("p", "l", None, 1, "a", 1, "x"), ("p", "l", day(0), None, "a", 1, "x")]), CONTENT).count() == 0
    assert list_history.superseded(whole.limit(0), frame(rows[:0]), CONTENT).count() == 0


def test_stale_results(spark):
    rows = [("p", "l0", day(0), k, "a", 1, "") for k in (1, 2, 3)] + [("p", "l1", day(2), 1, "a", 1, ""), ("p", "l1", day(2), 2, "b", 1, "")]
    spans = list_history.history(spark.createDataFrame(rows, ROW), CONTENT)
    results = spark.createDataFrame([("p", k, day(1)) for k in (1, 2, 3, 4)] + [("p", 2, day(3)), ("q", 1, day(1)), ("p", 1, None)], "research_id string, patent_id long, analysed_at timestamp")
    got = list_history.stale_results(results, spans)
    assert {(r["research_id"], r["patent_id"], r["analysed_at"]): r["stale"] for r in got.collect()} == {
        ("p", 1, day(1)): None, ("p", 2, day(1)): "changed", ("p", 3, day(1)): "removed", ("p", 4, day(1)): "unlisted", ("p", 2, day(3)): None, ("q", 1, day(1)): "unlisted", ("p", 1, None): "changed",
    }
    assert {tuple(r) for r in list_history.stale_researches(got).collect()} == {("p", 6, 4, True), ("q", 1, 1, True)}


def test_audit_stream_takes_a_key_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = audit.audit_log(spark, f"file://{tmp_path}/log")

    def put(name, lines):
        (tmp_path / "in" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps({"at": f"2024-01-0{x[0]}T00:00:00", "action": x[1], "idempotency_key": x[2]}) for x in lines))

    def run(checkpoint="checkpoint", horizon="1 day"):
        audit.append_stream(spark, f"file://{tmp_path}/in", log, f"file://{tmp_path}/{checkpoint}", horizon).awaitTermination()
        return sorted((r["action"], r["idempotency_key"] or "") for r in log.read().collect())

    put("1.json", [(3, "first", "a"), (2, "earlier", "a"), (1, "none", None), (1, "none", None), "not json", (4, "b", "b")])
    one = run()
    assert ("b", "b") in one and one.count(("none", "")) == 2 and sum(k == "a" for _, k in one) == 1 and len(one) == 4
    assert run() == one
    put("2.json", [(5, "again", "a"), (1, "old date", "c"), (6, "b again", "b")])
    two = run()
    assert two == sorted([*one, ("old date", "c")])
    # a lost checkpoint reads all files again: keyed rows stay single
    three = run("another")
    assert [x for x in three if x[1]] == [x for x in two if x[1]]
    assert audit.tail(log, 1).first()["idempotency_key"] == "b" and audit.tail(log, 0).count() == 1


def test_files_are_routed_once(spark, tmp_path):
    def put(path, value):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")

    put("r/pipeline/P1/embeddings.json", {"vectors": {"technology": [1.0, 2], "problem": [0.5, 1]}, "input_sha256": ["x"], "created_at": "now", "more": 1})
    put("r/pipeline/P2/embeddings.json", {"vectors": {"technology": [1.0]}})
    put("r/pipeline/P3/embeddings.json", {"vectors": {"technology": [1.0], "problem": ["a"]}})
    put("r/pipeline/P4/embeddings.json", "{")
    put("r/pipeline/P1/threat_score.json", json.dumps({"similarity": 3, "説明": "é"}, ensure_ascii=False, indent=2))
    put("r/pipeline/P1/attempts/run-7/error.json", {"e": 1})
    put("r/pipeline/日本 語/a+b%20.json", [1])
    put("r/subresearches/g/patents.json", "[]")
    put("r/subresearches/g/bad.json", "nope")
    put("r/other/ignored.json", {})
    put("r/pipeline/P1/note.txt", "x")
    put("notes/P1.json", {"note": "n", "source": "model"})
    put("notes/P2.json", {})
    put("notes/.P3.json", {"note": "hidden"})
    put("notes/-x.json", {"note": "no id"})
    got = artifacts.import_files(spark, f"file://{tmp_path}/r", "R", f"file://{tmp_path}/notes")
    vectors = got["vectors"].collect()
    assert [(r["patent_id"], r["technology"], r["problem"], r["dimensions"], r["input_sha256"], r["created_at"]) for r in vectors] == [("P1", [1.0, 2.0], [0.5, 1.0], 2, ["x"], "now")]
    assert {(r["patent_id"], r["artifact_type"], r["run_id"]) for r in got["artifacts"].collect()} == {("P1", "threat_score", ""), ("run-7", "error", "run-7"), ("_research", "a+b%20", ""), ("g", "patents", "")}
    assert json.loads(got["artifacts"].where("artifact_type = 'threat_score'").first()["payload"]) == {"similarity": 3, "説明": "é"}
    assert {(r["patent_id"], r["note"], r["source"]) for r in got["interpretations"].collect()} == {("P1", "n", "model"), ("P2", "", "human")}
    assert sorted((r["patent_id"], r["reason"]) for r in got["malformed"].collect()) == [("-x", "no id"), ("P2", "no two vectors of numbers"), ("P3", "no two vectors of numbers"), ("P4", "no JSON"), ("g", "no JSON")]
    assert sum(r["files"] for r in artifacts.sink_counts(got).collect()) == 12
    none = artifacts.import_files(spark, f"file://{tmp_path}/nowhere", "R")
    assert {r["sink"]: r["files"] for r in artifacts.sink_counts(none).collect()} == dict.fromkeys(artifacts.SINKS, 0)
