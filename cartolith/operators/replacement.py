"""Replacing a research's documents by a new list, by what has changed.

The new list is held against the stored documents. What was added, changed or removed decides which buckets of documents,
of the documents' organizations and of the search postings are written anew; organizations' counts move by the
difference of the bridge's old and new rows. All of it becomes visible as one version.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut
from ..sources.snapshots import BUCKET, Snapshot
from .model import LOWER, SEARCHED, UPPER, Tables, ascii_lower, search

BUCKETS = 16
#: Postings of a bucket are in so many folders by gram; a search opens those of its own grams.
GRAM_FOLDERS = 16
GRAM = 3
#: Documents of a bucket that one task takes with their organizations and postings; a bucket of more has several files.
FILE_ROWS = 100_000
#: So many candidates are named to the scan of the documents, which then skips what holds none; beyond, it is a join.
NAMED_MOST = 10_000
KEY = "patent_id"


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _pieces(needle: str) -> list[str]:
    """The literal stretches of a needle: what is between LIKE's wildcards."""
    return [p for p in re.split("[%_]", needle.strip().translate(str.maketrans(UPPER, LOWER))) if p]


def grams_of(text: str) -> list[str]:
    return list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))


def _grams(columns: Sequence[str]) -> Column:
    """All runs of three characters of each searched column, in its compared form; none goes from one column into the next."""
    one = lambda c: F.when(F.length(c) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substr(c, i, F.lit(GRAM))))
    each = [F.coalesce(one(ascii_lower(F.col(c).cast("string"))), F.array().cast("array<string>")) for c in columns]
    return F.array_distinct(F.flatten(F.array(*each)))


class Research:
    """One research's documents, their organizations, organization counts and postings, as of one version."""

    def __init__(self, spark: SparkSession, folder: str, research_id: str, columns: str, buckets: int = BUCKETS):
        """columns: the documents' columns as DDL, with patent_id, position and organization_ids (an array of strings)."""
        self.spark, self.id, self.buckets = spark, research_id, buckets
        key = next(f.dataType.simpleString() for f in spark.createDataFrame([], columns).schema if f.name == KEY)
        schemas = {
            "documents": columns,
            "bridge": f"{KEY} {key}, organization_id string",
            "organizations": "organization_id string, name string, document_count long",
            "postings": f"gram string, {KEY} {key}, _g int",
        }
        self.snapshot = Snapshot(spark, f"{folder.rstrip('/')}/{research_id}", schemas)
        self.columns = spark.createDataFrame([], columns).columns
        self.searched = [c for c in SEARCHED if c in self.columns]

    def documents(self) -> DataFrame:
        return self.snapshot.read("documents")

    def tables(self) -> Tables:
        """The tables that filters and facets take, for this research."""
        named = lambda df: df.select(F.lit(self.id).alias("research_id"), "*")
        return Tables(named(self.documents()), named(self.snapshot.read("bridge")), named(self.organizations()))

    def organizations(self) -> DataFrame:
        """Those that the last list named, with the documents that each has."""
        return self.snapshot.read("organizations").where(F.col("name").isNotNull())

    def changes(self, incoming: DataFrame) -> DataFrame:
        """(patent_id, change, _bucket): added, changed, removed or same, by all columns of both sides, position among them."""
        a = self.documents().select(F.col(KEY).alias("_old"), F.struct(*self.columns).alias("_a"))
        b = incoming.select(F.col(KEY).alias("_new"), F.struct(*self.columns).alias("_b"))
        both = a.join(b, F.col("_old") == F.col("_new"), "full_outer")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
        return both.select(F.coalesce("_old", "_new").alias(KEY), change.alias("change")).withColumn(BUCKET, bucket(KEY, self.buckets))

    def replace(self, incoming: DataFrame, organizations: DataFrame, about: dict | None = None) -> DataFrame:
        """Makes the incoming documents the research's own; returns (patent_id, change) of all that is not the same.

        organizations (organization_id, name) are those that count from now on, with 0 documents too. A null id is no
        document; of rows that repeat an id the one of the smallest position counts. An id of an organization that is null
        is none, and one that repeats in a document counts once. An empty list removes all.
        """
        first = F.min_by(F.struct(*self.columns), F.struct(F.col("position").isNull(), F.col("position"), F.xxhash64(*self.columns)))
        rows = cut(incoming.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(first.alias("r")).select("r.*").withColumn(BUCKET, bucket(KEY, self.buckets)), "incoming")
        changed = cut(self.changes(rows).where("change <> 'same'"), "changes")
        touched = sorted(r[BUCKET] for r in changed.select(BUCKET).distinct().collect())  # at most `buckets`
        parts, changes = rows.where(F.col(BUCKET).isin(touched)), {}
        if touched:
            own = self._dealt(parts, len(touched))
            held = own.select(BUCKET, KEY, F.explode(F.array_distinct(F.coalesce("organization_ids", F.array().cast("array<string>")))).alias("organization_id")).where("organization_id IS NOT NULL")
            grams = own.select(BUCKET, KEY, F.explode(_grams(self.searched)).alias("gram")).withColumn("_g", F.pmod(F.xxhash64("gram"), F.lit(GRAM_FOLDERS)).cast("int"))
            changes["documents"] = touched, self.snapshot.stage("documents", own, touched, [KEY], dealt=True)
            changes["bridge"] = touched, self.snapshot.stage("bridge", held, touched, ["organization_id"], dealt=True)
            changes["postings"] = touched, self.snapshot.stage("postings", grams, touched, ["gram", KEY], "_g", dealt=True)
        changes["organizations"] = self._counted(changed, parts, organizations)
        self.snapshot.commit(changes, {"research_id": self.id} | (about or {}))
        return changed.drop(BUCKET)

    def _dealt(self, parts: DataFrame, touched: int) -> DataFrame:
        """The documents of the touched buckets, by bucket and, beyond FILE_ROWS, by a share of it; what is made of them stays in their task."""
        shares = math.ceil(parts.count() / touched / FILE_ROWS)
        if shares <= 1:
            return parts.repartition(touched, BUCKET)
        return parts.repartition(touched * shares, BUCKET, F.pmod(F.xxhash64(KEY, F.lit(1)), F.lit(shares)))

    def _counted(self, changed: DataFrame, parts: DataFrame, organizations: DataFrame) -> tuple[list[int], dict[str, str]]:
        """The buckets of organizations whose count or name moves, written anew.

        The differences come from the documents that have changed: their old rows of the bridge count down, the new ones up.
        Organizations without a name stay in the table while documents have them, so that they can be named later.
        """
        none = F.array().cast("array<string>")
        new = parts.join(changed.select(KEY), KEY, "left_semi").select(F.explode(F.array_distinct(F.coalesce("organization_ids", none))).alias("organization_id"), F.lit(1).alias("n"))
        old_rows = self.snapshot.read("bridge", sorted(r[BUCKET] for r in changed.select(BUCKET).distinct().collect()))
        old = old_rows.join(changed.select(KEY), KEY, "left_semi").select("organization_id", F.lit(-1).alias("n"))
        moved = new.where("organization_id IS NOT NULL").unionByName(old).groupBy("organization_id").agg(F.sum("n").alias("_moved"))
        before = self.snapshot.read("organizations").select("organization_id", F.col("name").alias("_name"), F.col("document_count").alias("_count"))
        named = organizations.where(F.col("organization_id").isNotNull()).groupBy("organization_id").agg(F.min(F.coalesce("name", F.lit(""))).alias("name"))
        whole = before.join(moved, "organization_id", "full_outer").join(named, "organization_id", "full_outer")
        count = F.coalesce("_count", F.lit(0)) + F.coalesce("_moved", F.lit(0))
        whole = whole.withColumn("document_count", count.cast("long")).withColumn(BUCKET, bucket("organization_id", self.buckets))
        same = F.col("name").eqNullSafe(F.col("_name")) & F.col("document_count").eqNullSafe(F.col("_count"))
        whole = cut(whole.select(BUCKET, "organization_id", "name", "document_count", same.alias("_same")), "organizations")
        touched = sorted(r[BUCKET] for r in whole.where("not _same").select(BUCKET).distinct().collect())
        kept = whole.where(F.col("name").isNotNull() | (F.col("document_count") > 0))
        return touched, self.snapshot.stage("organizations", kept, touched, ["organization_id"]) if touched else {}

    def candidates(self, needle: str) -> DataFrame | None:
        """(patent_id) of documents with all runs of three characters of a needle; None if it has none, so that postings can't tell."""
        grams = list(dict.fromkeys(g for p in _pieces(needle) for g in grams_of(p)))
        if not grams:
            return None
        hashed = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_FOLDERS)).cast("int"))
        folders = sorted({r[0] for r in hashed.collect()})
        posted = self.snapshot.read("postings").where(F.col("_g").isin(folders) & F.col("gram").isin(grams))
        return posted.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(KEY)

    def find(self, needle: str) -> DataFrame:
        """The documents that LIKE finds in any searched column: postings first, then the needle itself on what is left.

        Up to NAMED_MOST candidates are named to the scan, which opens only the buckets and parts that may hold them; more
        than that are joined. A needle without three literal characters in a row reads all documents.
        """
        if not needle.strip():
            return self.documents()
        found = self.candidates(needle)
        if found is None:
            return self.documents().where(search(needle, self.searched))
        found = cut(found.withColumn(BUCKET, bucket(KEY, self.buckets)), "candidates")
        few = found.limit(NAMED_MOST + 1).collect()
        if len(few) <= NAMED_MOST:
            rows = self.snapshot.read("documents", sorted({r[BUCKET] for r in few})).where(F.col(KEY).isin([r[KEY] for r in few]))
        else:
            rows = self.documents().join(found.select(KEY), KEY, "left_semi")
        return rows.where(search(needle, self.searched))


def researches(spark: SparkSession, folder: str, ids: Sequence[str]) -> DataFrame:
    """(research_id, version, about as JSON): what each research's last version says of itself, one row a research."""
    rows = []
    for i in ids:
        s = Snapshot(spark, f"{folder.rstrip('/')}/{i}", {})
        if s.number:
            rows.append((i, s.number, json.dumps(s.about, ensure_ascii=False, sort_keys=True)))
    return spark.createDataFrame(rows, "research_id string, version long, about string")

