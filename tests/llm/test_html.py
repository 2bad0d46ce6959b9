"""Main text of pages made from known blocks, and of awkward tables."""

import random

from pyspark.sql import functions as F

from cartolith.llm import html_text


def say(rng, least, most):
    return " ".join(rng.choice(["the", "river", "of", "stone", "was", "told", "and", "many", "seen", "bridges"]) + rng.choice(["", ",", ""]) for _ in range(rng.randint(least, most))).capitalize() + "."


def build(rng):
    """(html, main text): an article of known blocks among all that is no article."""
    blocks = [("h1", say(rng, 3, 8))] + [(rng.choice(["p", "p", "p", "h2", "li", "blockquote"]), say(rng, 1, 60)) for _ in range(rng.randint(2, 9))]
    inner, want = "", []
    for tag, text in blocks:
        marked = text.replace("river", rng.choice(["<b>river</b>", "<a href='/r'>river</a>", "river"])).replace("and", "&amp;" if rng.random() < 0.3 else "and")
        inner += f"<{tag}>{marked.replace(' ', rng.choice([' ', '  ', chr(10)]))}" + ("" if tag in ("p", "li") and rng.random() < 0.4 else f"</{tag}>")
        want.append(text.replace("and", "&") if "&amp;" in marked else text)
        if rng.random() < 0.2:
            inner += rng.choice(["<script>var a = '<p>x</p>';</script>", "<style>p{}</style>", f"<aside>{say(rng, 3, 30)}</aside>", f"<div class='ad'>{say(rng, 3, 30)}</div>", "<form><input><label>Sign up</label><button>Go</button></form>"])
    wrap = rng.choice(["{}", "<div class='layout has-sidebar'>{}</div>", "<main>{}</main>", "<div id='page-with-header'><div class='share-story'>{}</div></div>", "<div class='hasSidebar'>{}</div>"])
    article = wrap.format(f"<article>{inner}</article>")
    before = rng.choice(["", f"<header><a href=/>{say(rng, 1, 3)}</a></header>"]) + "<nav><ul>" + "".join(f"<li><a href=/{k}>{say(rng, 1, 2)}</a>" for k in range(5)) + "</ul></nav>"
    before += rng.choice(["", f"<div class='cookie-notice'>{say(rng, 5, 30)}</div>", f"<div role='alert'>{say(rng, 5, 20)}</div>", f"<div class='ad'>{say(rng, 5, 40)}</div>"])
    after = rng.choice(["", f"<div class='sidebar'>{say(rng, 5, 60)}</div>", f"<section id='comments'><p>{say(rng, 20, 60)}</p><p>{say(rng, 5, 60)}</p></section>"]) + f"<footer>&copy; {say(rng, 2, 12)}</footer>"
    return f"<!DOCTYPE html><html><head><title>{say(rng, 2, 5)}</title></head><body>{before}{article}{after}</body></html>", "\n".join(want)


def test_pages_of_known_blocks():
    rng = random.Random(2)
    for _ in range(400):
        html, want = build(rng)
        assert html_text.main_text(html) == want, html


def test_formulas_and_hidden_text_are_text():
    assert html_text.main_text("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> here</p><p hidden>More of it</p></article>") == "Energy is E=mc here\nMore of it"


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<article><p>Text</p></article>"), (3, "u", "<article><p>Text</p></article>"), (4, None, "<p>" * 3000 + "deep"), (None, "u", "a &lt; b &#x41; &unknown; 漢字😀")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_main", F.lit(1)).withColumn("text", F.lit("own"))
    got = html_text.extract(pages)
    assert got.columns == [*pages.columns, "_main_"] and {(r["_main"], r["text"]) for r in got.collect()} == {(1, "own")}
    told = [(r["page_id"], r["t"]["text"], r["t"]["chars"]) for r in got.select("page_id", F.col("_main_").alias("t")).collect()]
    assert sorted(told, key=str) == sorted([(1, "", 0), (2, "", 0), (3, "Text", 4), (3, "Text", 4), (4, "deep", 4), (None, "a < b A &unknown; 漢字😀", 21)], key=str)
    assert html_text.extract(pages.where("false")).count() == 0
