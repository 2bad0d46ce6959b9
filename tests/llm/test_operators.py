"""The training-data operators against brute force on small fixtures, and on awkward tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import exact_dedup, html_text, lm_score, mixing, near_dedup, neighbours, packing, quality, sharding, toxicity
from cartolith.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, kept string"
AWKWARD = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "ab"), (7, "ab"), (None, "null id"), (8, "x " * 30_000), (9, "Éa ñ ß 漢字 😀")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqr") + rng.choice("stuvwxyz") for _ in range(n)]


def test_exact(spark, docs, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.content_sort_groups(docs).collect()}
    assert {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (6, 6, 5, True), (4, 6, 5, False), (7, 6, 5, False), (None, None, 1, True)} <= got
    kept = exact_dedup.keep_one_of_equals(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    hot = spark.range(2000).select("id", F.lit("same").alias("text")).union(spark.range(2000, 2010).select("id", F.concat(F.lit("t"), F.col("id").cast("string"))))
    groups = exact_dedup.content_sort_groups(hot, "id")
    assert groups.where("kept").count() == 11 and groups.where("group_size = 2000 and keep_id = 0").count() == 2000
    assert exact_dedup.content_sort_groups(none).count() == 0


def test_near_matches_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randint(60, 200))
        texts.append(base)
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.random())
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.order_minhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = [near_dedup.kmers(near_dedup.Words()(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.alignment(grams[i], grams[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(rows))}


def test_alignment_minds_order():
    a = near_dedup.kmers(np.arange(100, dtype=np.uint64))
    assert near_dedup.alignment(a, a) == 1.0
    assert near_dedup.alignment(a, np.concatenate((a[48:], a[:48]))) == 0.0
    assert near_dedup.alignment(a[:0], a[:0]) == 1.0 and near_dedup.alignment(a, a[:40]) == 0.0


def test_near_awkward(docs, none):
    rows = near_dedup.order_minhash_classes(docs).collect()
    assert len(rows) == len(AWKWARD) and {r["doc_id"]: r["class_id"] for r in rows}[3] == 1
    assert near_dedup.order_minhash_classes(none).count() == 0


def test_mixing(spark, docs, none):
    rows = [(i, "w " * (1 + i % 5), ("en", "de")[i % 3 == 0], f"s{i % 7 % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, "doc_id", "text", {"source": F.col("source"), "lang": F.col("lang")}, damping=0.5, rounds=20)
    for d in ("source", "lang"):
        by = {r[d]: (r["a"], r["w"]) for r in out.groupBy(d).agg(F.sum("_mix.tokens").alias("a"), F.sum(F.col("_mix.tokens") * F.col("_mix.p")).alias("w")).collect()}
        goal, got = sum(a**0.5 for a, _ in by.values()), sum(w for _, w in by.values())
        assert all(abs(w / got - a**0.5 / goal) < 1e-3 for a, w in by.values())
    assert out.agg(F.max("_mix.p")).first()[0] == pytest.approx(1.0)
    clash = docs.select("*", F.lit(1).alias("_MIX"), F.lit("t").alias("topic"), F.lit(2).alias("_topic"), F.lit(3).alias("tokens"), F.lit(4).alias("d0"))
    for mixed in (mixing.mix_documents(clash), mixing.mix_documents(clash.where("false"))):
        assert mixed.columns == [*clash.columns, "_mix_"]
    mixed = mixing.mix_documents(clash).collect()
    assert len(mixed) == len(AWKWARD) and {(r["_MIX"], r["topic"], r["_topic"], r["tokens"], r["d0"]) for r in mixed} == {(1, "t", 2, 3, 4)}
    assert all(r["_mix_"]["kept"] and r["_mix_"]["p"] == 1.0 for r in mixed if r["_mix_"]["tokens"] == 0) and mixing.mix_documents(none).count() == 0
    assert mixing.mix_documents(docs, ["doc_id"]).columns == ["doc_id", "_mix"]


def test_topics_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 4)
    rng = random.Random(12)
    names = ["alpha", "Bravo", "charlie", "délta", "ÉCHOES", "foxtrot", "golfers", "hotel", "the", "in"]
    rows = [(i, " ".join(rng.choice(names[: 1 + rng.randrange(10)] if i % 3 else ["zz"]) for _ in range(rng.randint(0, 12))), ("en", "de", None)[i % 7 % 3]) for i in range(500)]
    rows += [(500, None, "en"), (501, "", "de")]
    held = {lang: Counter(w for _, t, g in rows if g == lang for w in {w.lower() for w in (t or "").split() if len(w) >= 5}) for lang in ("en", "de", None)}
    many = Counter(g for _, _, g in rows)
    words = {lang: sorted((w for w, n in own.items() if n * 4 <= many[lang]), key=lambda w: (-own[w], w))[:4] for lang, own in held.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang"]: r["words"] for r in mixing.topic_words(df, "text", "lang", 4).collect()} == words and sum(map(len, words.values())) >= 6
    for r in mixing.with_topic(df, topics=4).collect():
        own = Counter(w.lower() for w in (r["text"] or "").split())
        best = min((-own[w], k + 1) for k, w in enumerate(words[r["lang"]]))
        assert r["_topic"] == (best[1] if best[0] else None)


def test_raking_matches_a_plain_one(spark):
    rng = random.Random(6)
    cells = [(a, b, c, rng.choice([1, 3, 40, 4000])) for a in "xyz" for b in ("p", None) for c in range(5) if rng.random() < 0.8] + [("none", "p", 1, 0)]
    got = {tuple(r[:3]): r["fitted"] for r in mixing.rake(spark.createDataFrame(cells, "a string, b string, c int, tokens long"), ["a", "b", "c"], 0.5).collect()}
    fit, total = {k[:3]: float(k[3]) for k in cells}, sum(k[3] for k in cells)
    share = lambda d, of: {v: sum(n for k, n in of.items() if k[d] == v) for v in {k[d] for k in of}}
    goal = []
    for d in range(3):
        t = {v: n**0.5 for v, n in share(d, {k[:3]: k[3] for k in cells}).items()}
        goal.append({v: x * total / sum(t.values()) for v, x in t.items()})
    for _ in range(400):
        for d in range(3):
            now = share(d, fit)
            fit = {k: n * goal[d][k[d]] / now[k[d]] if now[k[d]] else 0.0 for k, n in fit.items()}
    for d in range(3):
        assert all(abs(n / total - goal[d][v] / total) < mixing.TOLERANCE for v, n in share(d, got).items())
    assert all(abs(got[k] - n) / total < 4 * mixing.TOLERANCE for k, n in fit.items())


def test_backoff_matches_brute_force(spark, docs, none):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "e"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = lambda ws, n: Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    split = [t.split() for t in texts]
    whole = {n: sum((grams(w, n) for w in split), Counter()) for n in (1, 2, 3)}
    total = sum(map(len, split))
    for k, ws in enumerate(split):
        seen = lambda g: whole[len(g)][g] - grams(ws, len(g))[g]  # noqa: B023, E731
        score = 0.0
        for i, w in enumerate(ws):
            for n in (3, 2, 1):
                g = tuple(ws[i - n + 1 : i + 1])
                if len(g) == n and i >= n - 1 and n > 1 and seen(g) and seen(g[:-1]):
                    score += np.log(seen(g) / seen(g[:-1]))
                    break
                if n == 1:
                    score += np.log(max(1, seen((w,))) / total)
                else:
                    score += np.log(lm_score.BACKOFF)
        assert got[k]["tokens"] == len(ws) and got[k]["log_score"] == pytest.approx(score)
    assert lm_score.score(docs).count() == len(AWKWARD) and lm_score.score(none).count() == 0


def test_neighbours(spark):
    x = np.random.default_rng(0).normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(4000, None, 0), (4001, [0.0] * 16, 0), (4002, [float("nan")] * 16, 0), (4003, [None] * 16, 0), (4004, x[100].tolist(), 0), (4100, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest_rows(df, df.where("vec_id % 100 = 0")).toPandas()
    assert not set(got["vec_id"]) & {4000, 4001, 4002, 4003} and 4000 not in set(got["query_id"])
    ids, full = np.array([*range(3000), 4004, 4100]), np.vstack([x, x[100], x[7]]).astype(float)
    hit = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((full - full[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit += len(set(best) & set(part["vec_id"])) / 10
        assert list(part.sort_values("rank")["vec_id"]) == list(part.sort_values(["score", "vec_id"])["vec_id"])
    assert hit / got["query_id"].nunique() >= 0.9
    assert neighbours.nearest_rows(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_repeated_rows_few_rows_and_other_dimensions(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (0, [9.0, 0.0], 0), (1, [1.5, 0.0], 0), (2, [1.0, 0.5], 0), (2, [1.0, 0.5], 0), (100, [1.0, 2.0, 3.0], 0), (101, [1.0, 2.0, 4.0], 0), (200, [1.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest_rows(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 2, 0.5), (100, 1, 101, 1.0)]


def test_shards(spark, docs, none):
    df = spark.createDataFrame([(i, f"a shared line that is long {i % 40}\nown text {i % 700}") for i in range(1000)] + [(5000 + i, "copy") for i in range(500)], "doc_id long, text string")
    got = sharding.shard(df).toPandas()
    assert len(got) == 1500 and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    pdf = df.toPandas().merge(got, on="doc_id")
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 8 == s for t, c, s in zip(pdf["text"], pdf["text_crc32"], pdf["size"]))
    linked = pdf[pdf.doc_id < 1000].assign(line=lambda d: d.text.str.split("\n").str[0]).groupby("line")["shard"].agg(lambda s: s.value_counts().iloc[0] / len(s)).mean()
    assert linked > 0.85  # a deal by hash would leave 1 / 24
    assert (pdf["label"] == pdf["shard"]).mean() > 0.5
    assert sharding.shard(docs).count() == len(AWKWARD) and sharding.shard(none).count() == 0


def test_quality(spark, docs, none, labels):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 40) if i % 4 else ["spam%%%" + rng.choice("abc") for _ in range(40)])) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 800, 3)], "doc_id long, quality int, toxic int")
    got = quality.resample(df, marks).toPandas().set_index("doc_id")
    good = got.index % 4 > 0
    assert got["selected"].sum() == round(800 * float(marks.agg(F.avg("quality")).first()[0])) and got[good]["selected"].mean() > 0.97 and got[~good]["selected"].mean() < 0.1
    assert quality.resample(docs, labels).where("selected").count() == len(AWKWARD) and quality.resample(none, labels).count() == 0
    double = marks.union(marks).union(spark.createDataFrame([(1, 0, 0), (1, 1, 0)], marks.schema))
    assert set(quality.resample(df, double).where("selected").toPandas()["doc_id"]) == set(quality.resample(df, marks.where("doc_id <> 1").union(spark.createDataFrame([(1, 0, 0)], marks.schema))).where("selected").toPandas()["doc_id"])
    keyed = spark.createDataFrame([(i, float(i % 97)) for i in range(5000)], "doc_id long, key double")
    want = {i for i, _ in sorted(((i, float(i % 97)) for i in range(5000)), key=lambda r: (-r[1], r[0]))[:1234]}
    assert {r["doc_id"] for r in quality.top_k(keyed, "key", 1234, "doc_id").where("_selected").collect()} == want
    same = spark.range(30_000).select((F.col("id") * 7 % 30_000).alias("doc_id"), F.lit(1.5).alias("key")).union(spark.createDataFrame([(None, 1.5), (9, None)], "doc_id long, key double"))
    got = {r["doc_id"] for r in quality.top_k(same, "key", 12_345, "doc_id").where("_selected").collect()}
    assert got == set(range(12_345)) and quality.top_k(same, "key", 10**6, "doc_id").where("_selected").count() == 30_001


def test_importance_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["bad", "ill", "poor", "fine"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "_id long, _text string")
    ratio = quality.model(df, spark.createDataFrame([(i,) for i in range(1, 60, 2)], "_id long"))
    features = quality.Features()
    raw, target = np.full(quality.BUCKETS, quality.SMOOTH), np.zeros(quality.BUCKETS)
    for i, t in rows:
        for b in features(t):
            raw[b] += 1
            target[b] += i % 2
    raw /= raw.sum()
    target = (target + quality.SMOOTH * quality.BUCKETS * raw) / (target.sum() + quality.SMOOTH * quality.BUCKETS)
    assert np.allclose(ratio, np.log(target / raw))
    got = {r["_id"]: r["_log"] for r in quality.log_weights(df, ratio).collect()}
    assert all(got[i] == pytest.approx(sum(ratio[b] for b in features(t)), abs=1e-9) for i, t in rows)


def test_segments_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 15))]
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        found = toxicity.segments(s)
        assert max((x for _, _, x in found), default=0) == max(0, best)
        assert all(sum(s[a:b]) == x > 0 for a, b, x in found) and all(p[1] <= q[0] for p, q in zip(found, found[1:]))


def test_toxicity(spark, docs, none, labels):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(1500):
        ws, bad = words(rng, rng.randint(5, 150)), i % 8 == 0
        for _ in range(3 * bad):
            ws.insert(rng.randrange(len(ws)), rng.choice(["vile", "nasty", "grimstem" + rng.choice("abcdef")]))
        rows.append((i, " ".join(ws)))
        marks.append((i, 1, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).join(lab, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).select("toxic", "_tox.score").toPandas()
    assert (got["toxic"] == (got["score"] >= 0.5)).mean() > 0.98 and got["score"].between(0, 1).all()
    clash = docs.select("*", F.lit(1).alias("_tox"), F.lit(2).alias("_tox_score"), F.lit(3).alias("_y"), F.lit(4).alias("_cal"), F.lit(5).alias("_ID"))
    out = toxicity.score(clash, toxicity.fit(clash, lab))
    assert out.columns == [*clash.columns, "_tox_"] and {(r["_tox"], r["_tox_score"]) for r in out.collect()} == {(1, 2)}
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == len(AWKWARD) and toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_packing_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["The", "Word,", "it's", "x1.", "é…", "<|endoftext|>", "a\tb", "\n", "日本。"]) for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").unionByName(docs.where("doc_id in (1, 2, 3, 9)").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    model, got = Tokenizer.from_file(tokenizer_path()), packing.pack(df, tokenizer_path()).toPandas()
    for r in df.collect():
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        part = got[got["doc_id"] == r["doc_id"]].sort_values("start")
        assert part["length"].sum() == len(ids) and (part["doc_tokens"] == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(part["start"], part["length"], part["ids_crc32"]))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert list(seq["offset"]) == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 2048
    assert packing.pack(none, tokenizer_path()).count() == 0 and packing.pack(docs, tokenizer_path()).select("doc_id").distinct().count() == 10


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First   paragraph<br>goes on with <b>bold</b> words.<p>Second.<script>var x="</p>";</script>
    <aside>Side</aside><form><input><button>Go</button>Sign up</form><div class="ad">Buy</div></article><div id="comments"><p>Nice post, thank you very much for all of it!</p></div><footer>&copy; 2024</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph goes on with bold words.\nSecond."
    assert html_text.main_text("") == "" and html_text.main_text("<p>only <i>text") == "only text" and html_text.main_text("plain") == "plain"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 60) + (["vile", "nasty", "foul"] if i % 10 == 0 else [])), "en", f"s{i % 3}", 1) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in range(50)] + [(2000 + i, rows[i][1] + " more", "en", "s0", 1) for i in range(51, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("vile" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {r[0] for r in rows if "vile" not in r[1]}
    assert kept[0] == clean
    assert kept[1] == {i for i in clean if i < 1000 or i >= 2000} and kept[2] == {i for i in clean if i < 1000}
    assert 0 < len(kept[3]) <= len(kept[2])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept[3]


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_near_short_texts_and_large_groups(spark):
    """Texts of few k-mers, where a sketch may differ at 4 of 5 k-mers in common, and a group whose members are not all like one text."""
    rng = random.Random(9)
    texts = []
    for n in (5, 6, 8, 9, 12, 20, 33, 44):
        for _ in range(6):
            base = words(rng, n)
            texts += [base, base + words(rng, 1), base[1:], words(rng, 1) + base + words(rng, 1)]
    base = words(rng, 150)
    for _ in range(150):
        copy = base[: rng.randint(110, 150)]
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.random())[2:]
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.order_minhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = [near_dedup.kmers(near_dedup.Words()(t)) for _, t in rows]
    want = components(len(rows), lambda i, j: near_dedup.alignment(grams[i], grams[j]) > 0)
    assert len(set(want)) > 40 and got == dict(enumerate(want))


def test_near_rows_are_told_apart_by_id_and_text(spark):
    rng = random.Random(10)
    a, b, c = words(rng, 80), words(rng, 80), words(rng, 80)
    rows = [(1, a), (2, [*a, "more"]), (2, b), (3, c), (3, c), (None, [*c, "more"]), (None, words(rng, 50)), (4, None), (5, [])]
    df = spark.createDataFrame([(i, None if t is None else " ".join(t), 7, "x") for i, t in rows], "doc_id long, text string, class_id int, th string")
    got = near_dedup.order_minhash_classes(df).collect()
    assert len(got) == len(rows) and [r["class_id"] for r in got if r["doc_id"] == 1] == [1] and sorted(r["class_id"] for r in got if r["doc_id"] == 2) == [1, 2]
    kept = near_dedup.keep_one_of_class(df)
    assert kept.columns == df.columns
    want = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (3, " ".join(c)), (4, None), (None, " ".join(rows[6][1]))]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
