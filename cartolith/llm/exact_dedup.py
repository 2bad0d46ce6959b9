"""Exact duplicates by content sort.

The normalised text is dealt into ranges by sampled splitters, each range is sorted (spilling to disk where
needed) so that equal texts lie side by side, and neighbours are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, shuffle_partitions, text_or_empty

#: A text held by more than 1 / (HOT_SHARE * partitions) of all rows is settled by partial aggregation.
HOT_SHARE = 4


def normalised(text: Column) -> Column:
    out = text_or_empty(text)
    for char in SPACE_CHARS:  # plain replacements search bytes, faster than translate() or a pattern
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _split(df: DataFrame, id_col: str, text_col: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Rows to sort and rows of hot texts that are settled without a sort.

    A hot text is one that more than 1 / (4 * partitions) of the rows hold, so there are at most
    4 * partitions of them: that bounds the broadcasts. Counts by hash find them, and their groups are
    reduced by a map-side partial aggregate; of their rows only the ones that may stay go to the sort.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    columns = [F.col(id_col).alias("_id"), F.length(text_or_empty(text)).alias("_cp"), F.xxhash64(normalised(text)).alias("_hash")]
    columns.append(F.struct("*").alias("_row") if whole else normalised(text).alias("_norm"))
    rows = df.select(*columns)
    norm = normalised(F.col("_row")[text_col]) if whole else F.col("_norm")
    limit = max(256, df.count() // (HOT_SHARE * shuffle_partitions(spark)))
    many = rows.groupBy("_hash").agg(F.count("*").alias("_c")).where(F.col("_c") > limit).select("_hash")
    best = F.min(F.struct((-F.col("_cp")).alias("cp"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    hot = rows.join(F.broadcast(many), "_hash").groupBy("_hash", F.sha2(norm, 256).alias("_sha")).agg(F.count("*").alias("_n"), best.alias("_best"))
    hot = cut(hot, "hot")
    heavy = F.broadcast(hot.select(F.col("_hash").alias("_h"), "_sha", "_n", "_best"))
    marked = rows.join(heavy, (F.col("_hash") == F.col("_h")) & (F.sha2(norm, 256) == F.col("_sha")), "left").drop("_h")
    stays = F.col("_id").eqNullSafe(F.col("_best.id")) & (F.col("_cp") == -F.col("_best.cp"))
    settled = marked.where(F.col("_n").isNotNull() & ~stays) if hot.limit(1).count() else marked.where(F.lit(False))
    return marked.where(F.col("_n").isNull() | stays), settled


def _sorted(rows: DataFrame, norm: Column) -> DataFrame:
    """Adds _at, _keep and _size from the neighbours in content order.

    Splitters are sampled from the first characters of the normalised text and its hash: short, whatever the
    texts' lengths, and never between equal texts. Inside a range rows are in the order of these and then of
    the whole text, so texts are compared in full only where both agree.
    """
    head = F.substring(norm, 1, 8)
    ranged = rows.withColumn("_head", head).repartitionByRange(shuffle_partitions(rows.sparkSession), "_head", "_hash")
    equal = Window.partitionBy("_head", "_hash", norm)
    order = equal.orderBy(F.col("_cp").desc(), F.col("_id").asc_nulls_last())
    return ranged.select(
        "*",
        F.row_number().over(order).alias("_at"),
        F.first("_id").over(order).alias("_keep"),
        F.count("*").over(equal).alias("_size"),
    )


def content_sort_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after deleting ASCII white space; a null text counts as empty. The row
    with the most code points in its original text stays, of those the smallest id (a null id comes last).
    Rows that agree in id and text are one row's repeats: one of them is kept. An empty table gives an
    empty result, and columns of other names than id_col and text_col are ignored.
    """
    to_sort, settled = _split(df, id_col, text_col, whole=False)
    norm = F.col("_norm")
    sha = F.sha2(norm, 256).alias("text_sha256")
    a = _sorted(to_sort, norm).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.coalesce("_n", "_size").cast("long").alias("group_size"),
        (F.col("_at") == 1).alias("kept"),
        sha,
    )
    b = settled.select(
        F.col("_id").alias(id_col),
        F.col("_best.id").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.lit(False).alias("kept"),
        sha,
    )
    return a.unionByName(b)


def keep_one_of_equals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without the copies, under the rules of content_sort_groups; all columns stay as they are."""
    to_sort, _ = _split(df, id_col, text_col, whole=True)
    return _sorted(to_sort, normalised(F.col("_row")[text_col])).where(F.col("_at") == 1).select("_row.*")
