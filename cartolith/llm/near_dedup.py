"""Near-duplicates by Order MinHash, verified by banded alignment.

A sketch takes the few smallest hashes of a text's occurrence-labelled k-mers (k words, with the number of
times they came before) and keeps them in text order, so two texts share a sketch only if they hold these
k-mers in the same order. Candidates share a sketch and come near the threshold by an estimate; the alignment decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, cut, give_back

WORD = re.compile(r"\w+")
K = 5
SIMILARITY = 0.8
#: Sketches a text and k-mers a sketch. At a similarity of 0.8 a sketch of 3 is shared with probability 0.51,
#: so of 14 at least one is in all but one case of 20,000 (of long texts; short ones are joined exactly).
SKETCHES, ELL = 14, 3
#: Bins of the estimate by which candidates are chosen for the alignment, and by how many standard deviations
#: the estimate may fall short: less than one pair of 4,000 at the threshold is lost.
BINS, DEVIATIONS = 128, 3.5
#: K-mers of the texts that are aligned with one text in a task.
ALIGNED = 200_000
#: Rows of three numbers that are broadcast at most; more are joined by a shuffle of the texts.
SENT = 500_000
#: Texts of at most so many k-mers are joined exactly, as a few k-mers make few sketches that differ.
SHORT = 40
#: Turns in which components that meet at a k-mer are compared by one text of each, before the exact join of what is left.
TURNS = 2
#: K-mers before a posted one that tell whether two texts have met before.
BEFORE = 32

_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(64)], dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of words, kept for as many words as a worker may remember."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.hash, self.known, self.most = xxhash.xxh3_64_intdigest, {}, most

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self.hash(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mers in text order; a text of fewer words is one k-mer, an empty one has none."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    width = min(k, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out = _scramble(out + words[i : n - width + 1 + i] * np.uint64(2 * i + 3))
    ranked = np.sort(out)
    if (ranked[1:] != ranked[:-1]).all():
        return out
    order = np.argsort(out, kind="stable")
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.arange(len(ranked))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    label = np.empty(len(ranked), dtype=np.uint64)
    label[order] = nth.astype(np.uint64)
    return np.where(label > 0, _scramble(out + label * np.uint64(0x9E3779B97F4A7C15)), out)


def sketch(grams: np.ndarray, sketches: int = SKETCHES, ell: int = ELL) -> np.ndarray:
    """Signed 64-bit sketches: for each hash function, the `ell` smallest k-mers combined in text order."""
    take = min(ell, len(grams))
    h = (grams[None, :] ^ _MIX[:sketches, None]) * np.uint64(0xBF58476D1CE4E5B9)
    low = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1)
    out = np.arange(1, sketches + 1, dtype=np.uint64)
    for i in range(take):
        out = _scramble(out + grams[low[:, i]])
    return out.view(np.int64)


def bins(grams: np.ndarray) -> np.ndarray:
    """The smallest k-mer of each bin, 32 bits of it; 0 stands for an empty bin."""
    out = np.full(BINS, 0xFFFFFFFF, dtype=np.uint32)
    np.minimum.at(out, (grams % np.uint64(BINS)).astype(np.int64), (grams >> np.uint64(32)).astype(np.uint32) >> np.uint32(1))
    return np.where(out == 0xFFFFFFFF, np.uint32(0), out + np.uint32(1))


def close(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For rows of bins: whether the share of k-mers in common may reach `least`."""
    held = np.maximum(1, ((a != 0) | (b != 0)).sum(-1))
    same = ((a == b) & (a != 0)).sum(-1)
    return same / held >= least - DEVIATIONS * np.sqrt(least * (1 - least) / held)


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-aware similarity of two sequences of labelled k-mers: L / (len(a) + len(b) - L), or 0 if below `least`.

    L is the longest common subsequence within the band of diagonals that texts of this similarity can reach.
    As labelled k-mers are distinct, it is the longest increasing run of matched positions.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = max(n, m) - need + 1
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if len(i) < need - 1e-9:
        return 0.0
    j = j[np.argsort(i, kind="stable")]
    if (np.diff(j) > 0).all():
        run = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        run = len(tails)
    got = run / (n + m - run)
    return got if got >= least - 1e-12 else 0.0


def _sketches(docs: DataFrame) -> DataFrame:
    """(id, th, key, n, sk, bins) of every row of (id, text, th): a digest of its words, the number of k-mers, the sketches and the bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                key, n, sk, low = [], [], [], []
                for text in part.column(1).to_pylist():
                    w = words(text or "")
                    grams = kmers(w)
                    key.append(xxhash.xxh3_128_digest(w.tobytes()))
                    n.append(len(grams))
                    sk.append(sketch(grams) if len(grams) else np.empty(0, np.int64))
                    low.append(bins(grams).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(sk, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["id", "th", "key", "n", "sk", "bins"])
        del words
        give_back()

    return docs.mapInArrow(run, "id long, th long, key binary, n long, sk array<long>, bins binary")


def _table(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.uint32).reshape(-1, BINS)


def _close(a: str, b: str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(close(_table(a), _table(b))) if len(a) else pd.Series([], dtype=bool)

    return F.pandas_udf(run, "boolean")(F.col(a), F.col(b))


def _verify(pairs: DataFrame, source: DataFrame, kept: Scratch) -> DataFrame:
    """The pairs (a, b) of (a, b, nb) that the alignment confirms; source is (node, text).

    A text that many others are to be aligned with is sent to several tasks, with about ALIGNED k-mers of others each.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / ALIGNED).alias("_parts"))
    dealt = kept.cut(pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest("_parts", F.lit(1))).alias("part")), "pairs")
    left = dealt.join(source.select(F.col("node").alias("b"), F.col("text").alias("other")), "b").select("a", "part", "b", "other")
    own = dealt.select("a", "part").distinct().join(source.select(F.col("node").alias("a"), "text"), "a")
    right = own.select(F.col("a").alias("c"), F.col("part").alias("d"), "text")

    def run(key, others, own):
        words = Words()
        grams = [kmers(words(t or "")) for t in own["text"][:1]]
        keep = [b for b, t in zip(others["b"], others["other"]) if grams and alignment(grams[0], kmers(words(t or "")))]
        return pd.DataFrame({"a": [key[0]] * len(keep), "b": keep}, dtype="int64")

    return left.groupBy("a", "part").cogroup(right.groupBy("c", "d")).applyInPandas(run, "a long, b long")


def _prefixes(texts: DataFrame, source: DataFrame, kept: Scratch) -> DataFrame:
    """(g, node, n, alone, place, short, before): the k-mers by which texts (node, n) are joined so that no pair is left out.

    Two sets of n <= m k-mers with a similarity of t have c = t / (1 + t) * (n + m) in common at least. So with k-mers
    in one order for all, rare ones first, they have one in common at a `place` of at most n - c + 1 in the smaller and
    m - c + 1 in the larger; at most n - 2 t / (1 + t) * n + 1 (`short`) and m - t * m + 1 whatever the other's size.
    K-mers of one text alone come first and are only counted (`alone`), so a text with too many changes of its own
    has nothing left to post, however large its group. `before` holds the posted k-mers just before this one.
    """
    small = lambda n: n - F.ceil(n * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-9) + 1
    large = lambda n: n - F.ceil(n * SIMILARITY - 1e-9) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                grams = [kmers(words(t or "")).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"])
        del words
        give_back()

    whole = source.join(texts.select("node"), "node", "left_semi").select("node", "text")
    posts = kept.cut(whole.mapInArrow(run, "node long, grams array<long>"), "grams").select("node", F.explode("grams").alias("g"))
    shared = posts.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    order = Window.partitionBy("node").orderBy("c", "g")
    ranked = posts.join(shared, "g").select("node", "g", F.row_number().over(order).alias("at"), F.count("*").over(Window.partitionBy("node")).alias("held"))
    alone = F.col("n") - F.col("held")
    place = F.col("at") + F.col("alone")
    first = ranked.join(texts, "node").withColumn("alone", alone).withColumn("place", place).where(F.col("place") <= large(F.col("n")))
    before = F.collect_list("g").over(Window.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1))
    return kept.cut(first.select("g", "node", "n", "alone", "place", (F.col("place") <= small(F.col("n"))).alias("short"), before.alias("before")), "prefixes")


def _hubs(prefixes: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of texts of different components with a k-mer in common, at most one for a post.

    Each component sends one text, another for each k-mer and turn, which meets that of the k-mer's first component.
    """
    each = F.min(F.struct(F.xxhash64("node", "g", F.lit(turn)), "node", "n", "place"))
    first = prefixes.select("g", "node", "n", "place").join(comps, "node").groupBy("g", "comp").agg(each.alias("m")).select("g", "comp", "m.node", "m.n", "m.place")
    hub = first.groupBy("g").agg(F.min(F.struct("comp", "node", "n", "place")).alias("m")).select("g", "m.comp", "m.node", "m.n", "m.place").toDF("g", "hcomp", "hnode", "hn", "hplace")
    common = f"ceil({SIMILARITY / (1 + SIMILARITY)!r} * (n + hn) - 1e-9)"
    met = first.join(hub, "g").where(f"comp <> hcomp and least(n, hn) >= {SIMILARITY} * greatest(n, hn) - 1e-9 and least(n - place, hn - hplace) + 1 >= {common}")
    return met.select(F.least("node", "hnode").alias("a"), F.greatest("node", "hnode").alias("b")).distinct()


def _joined(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, nb) of different components among the prefixes.

    A place rules out all smaller texts above some size; posts that no text of their k-mer can meet are left out, and
    then k-mers of one component alone, before anything is joined. A pair that has met at one of the last BEFORE posted
    k-mers of both has been made there, or earlier, and is not made again: its first meeting always stands.
    """
    t = SIMILARITY / (1 + SIMILARITY)
    least = prefixes.where("short").groupBy("g").agg(F.min("n").alias("least"))
    meets = (F.col("n") + 1 - F.col("place")) / t - F.col("n") + 1e-6
    first = prefixes.join(least, "g").where(F.col("short") | (meets >= F.col("least"))).drop("least").join(comps, "node")
    mixed = first.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("g")
    first = first.join(mixed, "g")
    side = lambda s: [F.col(c).alias(f"{s}{c}") for c in ("node", "n", "comp", "place", "before")]
    x, y = first.where("short").select("g", *side("x")), first.select("g", *side("y"))
    common = f"ceil({t!r} * (xn + yn) - 1e-9)"
    fits = f"xcomp <> ycomp and xn <= yn and xn >= {SIMILARITY} * yn - 1e-9 and xplace <= xn - {common} + 1 and yplace <= yn - {common} + 1"
    met = x.join(y, "g").where(fits).where(~F.arrays_overlap("xbefore", "ybefore"))
    low = F.col("xnode") < F.col("ynode")
    return met.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b"), F.when(low, F.col("yn")).otherwise(F.col("xn")).alias("nb")).distinct()


def _classified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, class_id, class_size, links, kept) of every row of df; th is a hash of the text, which with the id names the row."""
    spark = df.sparkSession
    kept = Scratch(spark, "near")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = kept.cut(_sketches(docs), "sketches")
    best = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    texts = rows.groupBy("key").agg(F.min(F.struct(best.alias("of"), "n", "sk", "bins")).alias("m"), F.count("*").alias("copies"))
    texts = texts.select("key", "m.of.*", "m.n", "m.sk", "m.bins", "copies")
    # a text's node is its smallest id; where an id is missing or stands for several texts, a hash of its words
    unsure = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1 or id is null").limit(1).count() > 0
    if unsure:
        texts = kept.cut(texts, "texts")
        again = texts.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id", F.lit(True).alias("again"))
        own = texts.where("id is not null").join(again, "id", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("key")).otherwise(F.col("id"))).drop("again")
        texts = own.unionByName(texts.where("id is null").withColumn("node", F.xxhash64("key")))
    else:
        texts = texts.withColumn("node", F.col("id"))
    texts = kept.cut(texts, "texts")
    posted = texts.where("n > 0").select("node", F.posexplode("sk").alias("j", "h"))
    buckets = posted.groupBy("j", "h").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
    held = kept.cut(posted.join(buckets, ["j", "h"]), "buckets")
    side = texts.select("node", "n", "bins")

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
        return both.where(f"least(na, nb) >= {SIMILARITY} * greatest(na, nb) - 1e-9").where(_close("sa", "sb")).select("a", "b", "nb")

    def named(links: DataFrame) -> DataFrame:
        found = connected_components(links).withColumnRenamed("node", "_node")
        return kept.cut(texts.select("node").join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("comp")), "components")

    star = held.where("node <> first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("c"))
    star = kept.cut(near(star), "star")
    short = texts.where(f"n > 0 and n <= {SHORT}").select("node")
    wanted = star.select(F.col("a").alias("node")).union(star.select("b")).union(held.where("size > 2").select("node")).union(short).distinct()
    which = kept.cut(texts.select("node", F.col("id").alias("_id"), F.col("th").alias("_th")).join(wanted, "node"), "wanted")
    if which.count() <= SENT:
        which = F.broadcast(which)
    source = docs.join(which, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("node", "text")
    source = kept.cut(source.dropDuplicates(["node"]) if unsure else source, "source")

    linked = kept.cut(_verify(star, source, kept), "links")
    comps = named(linked)
    crowded = held.where("size > 2")
    open_ = crowded.join(comps, "node").groupBy("j", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("j", "h")
    crowded = kept.cut(crowded.join(open_, ["j", "h"]).select("j", "h", "node"), "crowded")
    left = crowded.select("node").union(short).distinct().join(texts.select("node", "n"), "node")
    prefixes = _prefixes(kept.cut(left, "open"), source, kept)
    # the text of a bucket with the fewest k-mers of its own is likely what the others were made from
    posting = crowded.join(prefixes.select("node", "alone").distinct(), "node").join(comps, "node")
    centre = posting.groupBy("j", "h").agg(F.min(F.struct("alone", "node", "comp")).alias("m")).select("j", "h", F.col("m.node").alias("mid"), F.col("m.comp").alias("other"))
    again = posting.join(centre, ["j", "h"]).where("comp <> other").select(F.least("mid", "node").alias("a"), F.greatest("mid", "node").alias("b")).distinct()
    linked = kept.cut(linked.union(_verify(near(again), source, kept)), "links")
    for turn in range(TURNS):
        found = kept.cut(_verify(near(_hubs(prefixes, named(linked), turn)), source, kept), "links")
        linked = kept.cut(linked.union(found), "links")
        if not found.limit(1).count():
            break
    more = kept.cut(_verify(_joined(prefixes, named(linked)), source, kept), "links")
    links = linked.union(more).distinct()
    final = connected_components(links).withColumnRenamed("node", "_node")
    degree = links.select(F.explode(F.array("a", "b")).alias("_of")).groupBy("_of").agg(F.count("*").cast("long").alias("links"))
    classes = texts.select("key", "node", "copies", best.alias("of")).join(final, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
    sizes = classes.groupBy("component").agg(F.sum("copies").cast("long").alias("class_size"), F.min("of").alias("first")).withColumnRenamed("component", "_component")
    classes = classes.join(sizes, F.col("component") == F.col("_component")).join(degree, F.col("node") == F.col("_of"), "left")
    classes = classes.select("key", F.col("first.id").alias("class_id"), "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "first")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    out = cut(rows.select("id", "th", "key").join(classes, "key").select("id", "th", "class_id", "class_size", "links", stays.alias("kept")), "near")
    kept.clear()
    return out


def order_minhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size, links, kept): the near-duplicate class of every row.

    Texts are near-duplicates if the alignment of their 5-word k-mers reaches 0.8; classes are the connected
    components, named by their smallest id (null if none of their rows has one). Rows with the same words are one text
    (null and empty texts are all one text without words), so copies cost nothing beyond their own row; `links` counts
    the verified links of a row's text to other texts that were needed to connect it. `kept` marks the row of the class
    with its smallest id, of several texts of that id the one of the smallest hash; rows that repeat an id and its text
    are alike in all columns. Null ids come last. An empty table gives an empty result; other columns, whatever their
    names, are ignored.

    Every bucket of texts with a common sketch is first compared with one of its texts, which connects
    a group of any size with as many pairs as it has texts. Buckets of three and more that then still hold several
    components are compared with the text that has the fewest k-mers of its own. What is left of them, and all texts of at
    most SHORT k-mers, post the rarest of their k-mers: a k-mer's components are compared with its first one, which connects
    groups with as many pairs as posts, and only what then is in different components is joined by an exact prefix filter.
    """
    return _classified(df, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_size", "links", "kept")


def keep_one_of_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without the near copies: of each class the rows that `order_minhash_classes` marks as kept.

    Rows are told apart by id and text, so a row that shares its id with a copy stays. All columns stay as they are.
    """
    gone = cut(_classified(df, id_col, text_col).where("not kept").select(F.col("id").alias("_gone_id"), F.col("th").alias("_gone_text")).distinct(), "gone")
    same = df[id_col].cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(df[text_col]) == F.col("_gone_text"))
    return df.join(gone, same, "left_anti")
