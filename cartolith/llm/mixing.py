"""Mixing sources to target weights: iterative proportional fitting, then a calibrated sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, cut, free_name, text_or_empty, uniform

#: Cells of the mixture table (source x language x topic) that the operator accepts; more are an error before they are raked.
MAX_CELLS = 1_000_000
#: Rounds of raking between two looks at the margins, the greatest distance of a margin's share from its target, rounds at most.
ROUNDS, TOLERANCE, MOST_ROUNDS = 8, 0.0005, 160
#: Topics of a corpus without a topic column. A topic's word is in at most one of SPREAD documents of its language; languages
#: with fewer than one of LANGUAGES documents have no words of their own, which bounds the words that are broadcast.
TOPICS, SPREAD, LANGUAGES = 16, 8, 1024
#: Runs of five and more letters, in lower case; all characters beyond ASCII count as letters.
CONTENT_WORD = r"[a-z\x{80}-\x{10FFFF}]{5,}"


def token_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(NOT_SPACE)).cast("long")


def content_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(CONTENT_WORD), F.lit(0))


def topic_words(docs: DataFrame, text_col: str, lang_col: str, topics: int = TOPICS) -> DataFrame:
    """(lang, words): of each language the words that most of its documents hold, among those that at most one in SPREAD holds.

    Words that are in more documents tell topics apart badly, rarer ones cover little; ties are in the order of the words. A
    null language is a language. All documents are counted, in partial sums; at most LANGUAGES rows of `topics` words come out.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.array_distinct(content_words(F.col(text_col))).alias("ws"))
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("c")), "languages")
    large = sizes.where(F.col("c") * LANGUAGES >= F.lit(sizes.agg(F.sum("c")).first()[0] or 0)).select(F.col("lang").alias("_l"), "c")
    held = rows.select("lang", F.explode("ws").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    some = held.join(F.broadcast(large), F.col("lang").eqNullSafe(F.col("_l"))).where(F.col("n") * SPREAD <= F.col("c"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    first = some.withColumn("i", place).where(F.col("i") <= topics)
    return first.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x.w).alias("words"))


def with_topic(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", topics: int = TOPICS) -> DataFrame:
    """docs with, last, a column `_topic` (with underscores added where docs has that name): which of the topic words of its
    language a text holds most often, from 1, of equals the more widespread one; null where it holds none.

    A topic's number stands for one word in each language, so topics are not bound to a language: each language has them
    all, and both margins can be raked.
    """
    found = topic_words(docs, text_col, lang_col, topics).collect()  # at most LANGUAGES rows
    words = docs.sparkSession.createDataFrame([(r["lang"], list(r["words"])) for r in found], f"lang {docs.schema[lang_col].dataType.simpleString()}, words array<string>")
    any_ = sorted({w for r in found for w in r["words"]})
    hits, own, lang, name = (free_name(docs, n) for n in ("_topic_hits", "_topic_words", "_topic_lang", "_topic"))
    told = docs.join(F.broadcast(words.select(F.col("lang").alias(lang), F.col("words").alias(own))), docs[lang_col].eqNullSafe(F.col(lang)), "left")

    def count(i: int) -> Column:
        return F.size(F.filter(F.col(hits), lambda h: h == i))

    counts = [F.struct(count(i).alias("n"), F.lit(-i).alias("i")) for i in range(1, topics + 1)]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    # one look into a set leaves few words; only these are looked up among their language's
    some = F.filter(content_words(F.col(text_col)), lambda w: w.isin(any_)) if any_ else F.array().cast("array<string>")
    places = F.filter(F.transform(some, lambda w: F.array_position(F.col(own), w)), lambda i: i > 0)
    marked = told.withColumn(hits, F.when(F.col(own).isNotNull(), places))
    return marked.withColumn(name, F.when(F.size(hits) > 0, (-best["i"]).cast("int"))).drop(hits, own, lang)


def rake(cells: DataFrame, dims: list[str], damping: float, rounds: int = ROUNDS, most: float | None = None) -> DataFrame:
    """Adds `fitted`: cells' tokens raked so that each margin has its target share, all within TOLERANCE.

    The target share of a margin's value is its actual token share to the power `damping`, normalised (1: as it is; 0:
    equal). `rounds` rounds scale each margin in turn, and are repeated until the greatest distance is below the tolerance,
    or MOST_ROUNDS are done, which only targets that contradict the empty cells can need. With `most`, a cell grows to `most` times
    its tokens at most, and margins that would need more stay below their target. The cells are few and already
    counted, so one task holds them and a chain of windows runs there without an exchange. Cells of no tokens keep 0.
    """
    for d in dims:
        total = F.sum("tokens").over(Window.partitionBy(d))
        cells = cells.withColumn(f"_t_{d}", F.when(total > 0, F.pow(total.cast("double"), F.lit(damping))).otherwise(F.lit(0.0)))
    cells = cut(cells, "cells")
    size = cells.count()
    if size > MAX_CELLS:
        raise ValueError(f"{size} mixture cells; at most {MAX_CELLS} are meant to be raked")
    goal = {}
    for d in dims:
        row = cells.groupBy(d).agg(F.first(f"_t_{d}").alias("t")).agg(F.sum("t").alias("s")).first()
        goal[d] = float(row["s"] or 0.0) or 1.0
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    out = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for _ in range(max(1, MOST_ROUNDS // rounds)):
        out = out.coalesce(1)
        for _ in range(rounds):
            for d in dims:
                now = F.sum("fitted").over(Window.partitionBy(d))
                step = F.col("fitted") * F.col(f"_t_{d}") * (total / goal[d]) / now
                step = step if most is None else F.least(step, F.col("tokens") * F.lit(most))
                out = out.withColumn("fitted", F.when(now > 0, step).otherwise(F.lit(0.0)))
        out = cut(out, "raked")
        if most is not None or not total:
            break
        far = [out.groupBy(d).agg(F.abs(F.sum("fitted") / total - F.first(f"_t_{d}") / goal[d]).alias("far")).agg(F.max("far")) for d in dims]
        if max(float(f.first()[0] or 0.0) for f in far) < TOLERANCE:
            break
    return out.drop(*[f"_t_{d}" for d in dims])


def mix(docs: DataFrame, id_col: str, text_col: str, dims: dict[str, Column], damping: float = 0.7, rounds: int = ROUNDS, most: float | None = None, seed: str = "mix", columns: list[str] | None = None) -> DataFrame:
    """docs with, last, a struct `_mix` (with underscores added where docs has that name): the raked dimensions, tokens,
    weight, p and kept. With `columns`, only these columns of docs are carried along, and texts are read once.

    `dims` names the raked dimensions and gives each as an expression over docs; a null value is a value of
    its own. The weight is the fitted tokens over the actual tokens of the document's cell. The probability is
    the weight over the greatest weight, so none exceeds 1 and the expected tokens of every margin are in proportion to its
    target (with `most`, of those that trimming leaves alone). A document stays if its uniform number, a function of id and seed, is below the
    probability: equal ids (null ones too) get equal decisions, and a rerun decides alike. Documents without tokens
    (null and empty texts) carry no weight in any margin and stay. An empty table gives an empty result; columns of
    docs keep their values whatever their names.
    """
    name = free_name(docs, "_mix")
    facts = F.struct(*[v.alias(k) for k, v in dims.items()], token_count(F.col(text_col)).alias("tokens")).alias(name)
    rows = docs.select(*[docs[c] for c in (docs.columns if columns is None else columns)], facts)
    if columns is not None:
        rows = cut(rows, "facts")
    own = [f"d{i}" for i in range(len(dims))]
    cells = rows.groupBy(*[F.col(name)[k].alias(o) for k, o in zip(dims, own)]).agg(F.sum(F.col(name)["tokens"]).alias("tokens"))
    fitted = rake(cells, own, damping, rounds, most).select(*own, F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).alias("weight"))
    fitted = cut(fitted, "weights")
    top = float(fitted.agg(F.max("weight")).first()[0] or 1.0)
    a, b = rows.alias("a"), fitted.alias("b")
    on = F.lit(True)
    for k, o in zip(dims, own):
        on = on & F.col(f"a.{name}")[k].eqNullSafe(F.col(f"b.{o}"))
    # at most MAX_CELLS rows of a few values: a bounded broadcast
    tokens, weight = F.col(f"a.{name}.tokens"), F.col("b.weight")
    p = F.when(tokens > 0, weight / F.lit(top)).otherwise(F.lit(1.0))
    found = F.struct(F.col(f"a.{name}.*"), weight.alias("weight"), p.alias("p"), (uniform(F.col(f"a.`{id_col}`"), seed) < p).alias("kept"))
    return a.join(F.broadcast(b), on, "left").select(*[F.col(f"a.`{c}`") for c in rows.columns[:-1]], found.alias(name))


def document_dims(docs: DataFrame) -> dict[str, Column]:
    """The dimensions of documents that `with_topic` has gone over."""
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(docs.columns[-1])}


def mix_documents(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`mix` of documents (doc_id, text, lang, source, ...) by source, language and topic, without the topic's own column."""
    told = with_topic(docs)
    return mix(told, "doc_id", "text", document_dims(told), columns=docs.columns if columns is None else columns)
