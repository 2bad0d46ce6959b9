"""What the operators share: reading, cutting lineage in the shared folder, ranks without one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, cut  # noqa: F401  for the operators

#: ASCII white space, as a character class of Java's and DuckDB's patterns and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Returns a Python worker's freed memory to the system; Spark keeps workers for later stages of other needs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of an md5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def bucketed_rank(df: DataFrame, group: list[str], bucket: list[str], within: list[Column], name: str) -> DataFrame:
    """Adds `name`, the rank from 0 in each group, by (bucket, within); no task holds a whole group.

    Buckets are counted first (partial sums in the map tasks), a running sum over the counts gives each
    bucket its first rank, and rows are only numbered inside their bucket.
    """
    counts = df.groupBy(*group, *bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy(*[F.col(b).asc_nulls_first() for b in bucket]).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = df.withColumn("_at", F.row_number().over(Window.partitionBy(*group, *bucket).orderBy(*within)))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, *bucket]]
    joined = inner.alias("a").join(bases.alias("b"), on)
    return joined.select("a.*", (F.col("b._base") + F.col("a._at") - 1).cast("long").alias(name)).drop("_at")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node long, component long) of the undirected links (a long, b long); a component is its smallest node.

    Alternates large-star and small-star steps, which need a number of rounds that grows with the logarithm
    of the number of nodes. A round is written to the shared folder, and the one before it is deleted. Nodes
    without a link do not appear. Links that do not settle in `rounds` rounds are an error, never a wrong answer.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    kept = Scratch(spark, "links")
    edges = kept.cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(seen):
            break
        before = tuple(seen)
        # large star: every larger neighbour of u goes to the least of u's neighbours and u itself
        near = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = near.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = near.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, kept = kept, Scratch(spark, "links")
        edges = kept.cut(small.where("u <> v").distinct(), "links")
        last.clear()
    else:
        raise RuntimeError("components did not settle")
    # the edges are now stars: u's only smaller neighbour is its component
    member = edges.groupBy("u").agg(F.min("v").alias("component"))
    return member.select(F.col("u").alias("node"), "component").union(member.select("component", "component").distinct())
