"""Sort-count resampling, product codes and reply trees: against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import chat_format, codebooks, target_sampling

DOCS = "doc_id long, text string, score string, n_features int, id int"


def plain_resample(docs, target, percent=10, least=20, size=10_000, longest=1):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % size
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, n, fs in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + size) / ((s[b] + 1) * (all_t + size)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (3, 50, 2)])
def test_resample_matches_brute_force(spark, monkeypatch, longest, percent, least):
    monkeypatch.setattr(target_sampling, "SLICE", 64)  # the workers take it from the module, so a slice is a line or so only in this process
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Ab", "ba", "é漢", "x1", "Zz-y", "q" * 90]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "no id " * 20), (5, rows[5][1]), (5, rows[5][1]), (203, "long word " * 40_000)]
    target = ["ab x1 x1", None, "é漢 q"]
    got = target_sampling.resample(
        spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], DOCS), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, least_words=least, longest=longest
    )
    assert Counter(map(tuple, got.collect())) == plain_resample(rows, target, percent, least, longest=longest)


def test_word_slices_never_cut_a_word(monkeypatch):
    monkeypatch.setattr(target_sampling, "SLICE", 16)
    for text in ("one Two  three" * 9, "x" * 100 + " y", "é" * 40 + "," + "ü" * 3, ""):
        raw = text.encode()
        want = re.findall(rb"[0-9a-z\x80-\xff]+", raw.lower())
        assert [w for s in target_sampling.word_slices(raw) for w in s] == want
    words, got = target_sampling._stream(("ab cd ef " * 20).encode(), target_sampling.Hashed(10_000), 3)
    assert words == 60 and len(got) == 60 + 59 + 58


def test_resample_of_nothing(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([("a",)], "text string")
    assert target_sampling.resample(none, target).count() == 0
    one = spark.createDataFrame([(1, "a b", "s", 1, 2)], DOCS)
    got = target_sampling.resample(one, target.limit(0), percent=100, least_words=1).first()
    assert got["n_features"] == 2 and got["rank"] == 1


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(r[2], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(part(r[2], p), books[p][e]), e)) for p in range(parts)] for r in kept]  # noqa: B023
        if k == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part(r[2], p) for r, c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    errors = [sum(far(part(r[2], p), books[p][c[p]]) for p in range(parts)) for r, c in zip(kept, codes, strict=True)]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[1]] += e
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return Counter((r[0], "".join(f"{c:02x}" for c in cs), e, by_label[r[1]]) for r, cs, e in zip(kept, codes, errors, strict=True)), hashlib.sha256(flat.encode()).hexdigest()


def test_codes_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, None]), [rng.choice([-1.5, 0.25, 0.26, 3.0, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(300)]
    rows += [(300, 1, None), (301, 1, [1.0] * 7 + [None]), (302, 1, [float("nan")] * 8), (303, None, [float("-inf")] * 8), (None, 7, [0.5] * 8), (4, 0, rows[4][2]), (4, 1, [9.0] * 8)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, _v int")
    for rounds in (0, 1, 2, 4):
        got, books = codebooks.coded(df, parts=4, entries=10, rounds=rounds)
        seen = codebooks.with_label_error(got).select("vec_id", "code", "error", "label_error")
        want, digest = plain_codes(rows, 4, 10, rounds)
        assert Counter(map(tuple, seen.collect())) == want and codebooks.digest(books) == digest


def test_codes_of_few_large_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    got, books = codebooks.coded(spark.createDataFrame([], schema))
    assert got.count() == 0 and codebooks.with_label_error(got).count() == 0 and codebooks.digest(books) == hashlib.sha256(b"").hexdigest()
    few = spark.createDataFrame([(1, [float(i) for i in range(16)], None), (2, [2.0] * 16, None)], schema)
    got, books = codebooks.coded(few)
    assert books.shape == (16, 2, 1) and {r["label_error"] for r in codebooks.with_label_error(got).collect()} == {0}
    with pytest.raises(ValueError):
        codebooks.coded(spark.createDataFrame([(1, [1e30] * 16, 1)], schema))
    with pytest.raises(ValueError):
        codebooks.coded(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], schema))
    big = np.full((3, 16), 1 << 25, np.int64)
    assert codebooks.assigned(big, big[:2].reshape(2, 16, 1).transpose(1, 0, 2))[1].tolist() == [0, 0, 0]


def test_only_changed_parts_are_sent():
    vectors = np.arange(24).reshape(6, 4)
    old = np.zeros((6, 2), np.uint8)
    new = old.copy()
    new[3, 1] = 1
    assert codebooks.changes(vectors, old, new, 3) == [{"part": 1, "entry": 0, "n": -1, "sums": [-14, -15]}, {"part": 1, "entry": 1, "n": 1, "sums": [14, 15]}]
    assert codebooks.changes(vectors, new, new, 3) == []


def plain_paths(rows, branches):
    """Root-to-leaf paths by recursion over one row for each id."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {}
        for r in sorted((r for r in rows if r[0] == conv and r[1] is not None), key=lambda r: (-(r[5] or 0.0), r[3] or "", hashlib.md5((r[4] or "").encode()).hexdigest(), r[2] is None, r[2] or 0)):
            own.setdefault(r[1], r)
        up = {i: r[2] if r[2] in own and r[2] != i else None for i, r in own.items()}
        paths = []
        for leaf in set(own) - {u for u in up.values() if u is not None}:
            path = [leaf]
            while up[path[-1]] is not None and len(path) <= len(own):
                path.append(up[path[-1]])
            if len(path) <= len(own):
                paths.append(path[::-1])
        paths.sort(key=lambda p: (-sum(own[i][5] or 0.0 for i in p) / len(p), -len(p), p[-1]))
        for k, p in enumerate(paths[:branches]):
            out[conv, k + 1] = [(own[i][3] or "", own[i][4] or "") for i in p]
    return out


MESSAGES = "conv long, id long, parent long, role string, text string, score double, up string, row int"


@pytest.mark.parametrize("branches", [1, 3, 100])
def test_paths_match_brute_force(spark, branches):
    rng = random.Random(branches)
    rows = []
    for conv in [*range(6), None]:
        for i in range(rng.choice([1, 5, 40])):
            rows.append((conv, i, rng.choice([None, i - 1, rng.randrange(i)]) if i else None, rng.choice(["user", "assistant", None]), rng.choice(["t", None, f"x{i}"]), rng.choice([None, 0.5, 1.0, -2.0])))
    rows += [(20, 1, 2, "user", "circle", 1.0), (20, 2, 1, "user", "circle", 1.0), (20, 3, 2, "user", "below", 1.0), (21, 1, 1, "user", "own parent", 1.0), (22, 1, 99, "user", "no parent", 1.0)]
    rows += [(23, 1, None, "user", "first", 0.0), (23, 1, None, "user", "better", 2.0), (23, None, 1, "user", "no id", 1.0), (24, 1, None, None, None, None)]
    got = defaultdict(list)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], MESSAGES)
    for r in chat_format.reply_paths(df, branches).orderBy("conv", "path", "position").collect():
        got[r["conv"], r["path"]].append((r["role"], r["text"]))
    assert dict(got) == plain_paths(rows, branches)


def test_long_chain_takes_few_joins(spark):
    turns = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    paths = chat_format.reply_paths(chat_format.chained(turns))
    assert [r["text"] for r in paths.orderBy("position").collect()] == [f"t{i}" for i in range(700)]


def test_chats_round_trip(spark):
    rng = random.Random(1)
    bits = [*chat_format.CONTROL, "\\", "<", "[", "\n", "\\n", "|im_end|>", "/s>", "<\\/s>", "[\\\\INST]", "é😀", " ", "<|im_end|>\n", "$1", "n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\n", "<s>\\\\", "", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) or None) for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(50, 0, "assistant", "long <s> " * 20_000), (None, None, "assistant", "x"), (51, 1, "user", "b"), (51, 1, "user", "a"), (51, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, chat string")
    chats = chat_format.formatted(chat_format.reply_paths(chat_format.chained(df)))
    seen = {r["conv"]: r for r in chat_format.read_back(chats).collect()}
    assert len(seen) == len({r[0] for r in rows})
    for conv, r in seen.items():
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is None, x[1], x[2] or "", x[3] or ""))]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert list(r["trained"]) == [t for role, t in own if role == "assistant"]
        inside = [p.split("\n", 1)[1] for p in r["chat"].split("<|im_end|>\n")[:-1]]
        assert not any(c in text for text in inside for c in chat_format.CONTROL)
    assert chat_format.formatted(chat_format.reply_paths(chat_format.chained(df.limit(0)))).count() == 0
