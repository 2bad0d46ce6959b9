"""The training-data operators over whole texts and tables: what a prefix, a cap or a wrapper would hide."""

import random
import zlib

import numpy as np
import pytest

from cartolith.llm import html_text, neighbours, toxicity


def test_html_wrappers_do_not_hide_the_article():
    say = lambda n, w: "<p>" + f"The {w} was told in many words by those who had seen it. " * n + "</p>"
    body = f"<nav><a href=/>Home</a></nav><article><div class='post-header'><h1>Head line</h1></div>{say(6, 'story')}<div class='ad'>Buy</div></article><footer>End</footer>"
    want = html_text.main_text(f"<body>{body}</body>")
    assert want.startswith("Head line\nThe story") and "Buy" not in want and "Home" not in want
    for wrap in ("<div class='layout has-sidebar'>{}</div>", "<div id='page' class='with-nav'>{}</div>", "<form action=/>{}</form>", "<div class='no-comments'><form>{}</form></div>"):
        assert html_text.main_text("<body>" + wrap.format(body) + "</body>") == want, wrap
    plain = html_text.main_text(f"<body><div class='has-sidebar'><div>{say(8, 'tale')}</div></div><div class='sidebar'>Side words</div></body>")
    assert plain.startswith("The tale") and "Side" not in plain
    notes = f"<div id='comments'><article>{say(9, 'reply')}</article></div>"
    assert html_text.main_text(f"<body>{body}{notes}</body>") == want
    assert html_text.main_text(f"<body><form>{body}{notes}</form></body>") == want
    main = html_text.main_text(f"<body><div class='related-layout'><main>{say(6, 'story')}</main></div></body>")
    assert main.startswith("The story")


def test_html_keeps_sibling_articles():
    one, two = (" ".join(f"{w}{i} is a word of this text" for i in range(n)) for w, n in (("a", 60), ("b", 40)))
    got = html_text.main_text(f"<body><div><article><p>{one}</p></article><article><p>{two}</p></article></div><footer>End</footer></body>")
    assert got == f"{one}\n{two}"


def test_toxicity_is_fitted_on_all_segments_of_a_text(spark, monkeypatch):
    rng = random.Random(6)
    plain = lambda n: [rng.choice("aeiou") + rng.choice("klmn") + rng.choice("stvw") for _ in range(n)]
    docs = [(i, " ".join(plain(60) + ["foul"] * (1 if bad else 0)), int(bad)) for i in range(300) for bad in [i % 3 == 0 and zlib.crc32(str(i).encode()) % 5 != 4]]
    many, run = [w for _ in range(250) for w in ["foul", *plain(9)]], ["foul"] * 60
    late, early = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 4][:2]
    docs += [(late, " ".join(many + plain(300) + run), 1), (early, " ".join(run + plain(300) + many), 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    seen = {}
    plot = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda t, y: seen.update(t=t[y > 0]) or plot(t, y))
    toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(seen["t"]) == 2 and seen["t"].min() > 0
    # the long passage counts as much at the end as at the start
    assert seen["t"][0] == pytest.approx(seen["t"][1], rel=0.05)


def test_neighbours_recall_in_one_large_block(spark):
    x = np.random.default_rng(0).normal(size=(8000, 64)).astype(np.float32)
    assert neighbours.RERANK_SHARE * len(x) > 4 * neighbours.RERANK_LEAST and len(x) <= neighbours.BLOCK_ROWS
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    got = neighbours.nearest_rows(df, df.where("vec_id % 100 = 0")).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10]) & set(part["vec_id"])) / 10
    print("recall", hit / 80)
    assert got["query_id"].nunique() == 80 and hit / 80 >= 0.95
