"""Which list a document's row came from, and until when it held: a history in which the newest list supersedes the older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESEARCH, KEY = "research_id", "patent_id"
SPAN = ("valid_from", "valid_to", "list_id")


def history(rows: DataFrame, content: list[str]) -> DataFrame:
    """(research_id, patent_id, content, valid_from, valid_to, list_id): one row for each stretch of lists with equal content.

    rows (research_id, list_id, listed_at, patent_id, content) are those of all lists of all researches. A row holds from its
    list on until the first later list of the research that lacks the document or has other content; valid_to is null while
    it holds. list_id is the list that it came with. Lists of one time are in the order of their ids. Of rows that repeat a
    document in a list the one of the smallest content counts; null ids and undated lists are left out. A window is one
    document's lists, or one research's list of lists.
    """
    known = rows.where(F.col(KEY).isNotNull() & F.col("listed_at").isNotNull())
    lists = known.select(RESEARCH, "listed_at", "list_id").distinct()
    order = Window.partitionBy(RESEARCH).orderBy("listed_at", "list_id")
    lists = lists.select(F.col(RESEARCH).alias("_r"), F.col("listed_at").alias("_t"), F.col("list_id").alias("_l"), F.row_number().over(order).alias("_n"), F.lead("listed_at").over(order).alias("_next"))
    same = F.col(RESEARCH).eqNullSafe(F.col("_r")) & (F.col("listed_at") == F.col("_t")) & F.col("list_id").eqNullSafe(F.col("_l"))
    one = known.groupBy(RESEARCH, "listed_at", "list_id", KEY).agg(F.min(F.struct(*content)).alias("_c")).join(lists, same)
    of = Window.partitionBy(RESEARCH, KEY).orderBy("_n")
    begins = F.coalesce((F.lag("_n").over(of) != F.col("_n") - 1) | ~F.lag("_c").over(of).eqNullSafe(F.col("_c")), F.lit(True))
    marked = one.withColumn("_begins", begins).withColumn("_i", F.sum(F.col("_begins").cast("int")).over(of))
    spans = marked.groupBy(RESEARCH, KEY, "_i").agg(
        F.any_value("_c").alias("_c"), F.min("listed_at").alias("valid_from"), F.max_by("_next", "_n").alias("valid_to"), F.min_by("list_id", "_n").alias("list_id")
    )
    return spans.select(RESEARCH, KEY, "_c.*", *SPAN)


def superseded(stored: DataFrame, newer: DataFrame, content: list[str]) -> DataFrame:
    """stored, a history, after one newer list for each research that `newer` (rows as in `history`) holds.

    Only open rows of those researches meet the new list; closed ones stay as they are. A list that is not later than what
    its research holds is an error in the data: its rows are passed over. The result equals the history of all rows.
    """
    last = stored.groupBy(F.col(RESEARCH).alias("_r")).agg(F.max(F.greatest("valid_from", F.coalesce("valid_to", "valid_from"))).alias("_last"))
    dated = newer.where(F.col(KEY).isNotNull() & F.col("listed_at").isNotNull()).join(last, F.col(RESEARCH).eqNullSafe(F.col("_r")), "left")
    dated = dated.where(F.col("_last").isNull() | (F.col("listed_at") > F.col("_last")))
    new = dated.groupBy(RESEARCH, KEY, "listed_at", "list_id").agg(F.min(F.struct(*content)).alias("_new"))
    lists = new.select(F.col(RESEARCH).alias("_r"), F.col("listed_at").alias("_at")).distinct()
    closed, open_ = stored.where("valid_to IS NOT NULL"), stored.where("valid_to IS NULL")
    old = open_.select(F.col(RESEARCH).alias("_or"), F.col(KEY).alias("_ok"), F.struct(*content).alias("_old"), F.struct(*SPAN).alias("_span"))
    both = old.join(new, F.col("_or").eqNullSafe(F.col(RESEARCH)) & (F.col("_ok") == F.col(KEY)), "full_outer")
    both = both.withColumn("_of", F.coalesce("_or", RESEARCH)).join(lists, F.col("_of").eqNullSafe(F.col("_r")), "left")
    kept = F.col("_old").isNotNull() & (F.col("_old").eqNullSafe(F.col("_new")) | F.col("_at").isNull())
    ended = F.struct(F.col("_span.valid_from").alias("valid_from"), F.col("_at").alias("valid_to"), F.col("_span.list_id").alias("list_id"))
    begun = F.struct(F.col("listed_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("list_id").alias("list_id"))
    row = lambda c, span: F.struct(F.col(c).alias("c"), span.alias("s"))
    rows = F.when(kept, F.array(row("_old", F.col("_span")))).otherwise(F.filter(F.array(F.when(F.col("_old").isNotNull(), row("_old", ended)), F.when(F.col("_new").isNotNull(), row("_new", begun))), lambda x: x.isNotNull()))
    out = both.select(F.coalesce("_or", RESEARCH).alias(RESEARCH), F.coalesce("_ok", KEY).alias(KEY), F.explode(rows).alias("x"))
    return closed.select(RESEARCH, KEY, *content, *SPAN).unionByName(out.select(RESEARCH, KEY, "x.c.*", "x.s.*"))


def as_of(spans: DataFrame, at: str) -> DataFrame:
    """The rows that held at a time."""
    moment = F.lit(at).cast("timestamp")
    return spans.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def stale_results(results: DataFrame, spans: DataFrame) -> DataFrame:
    """results (research_id, patent_id, analysed_at, ...) with `stale`: why a result no longer stands for its document, or null.

    removed: no list that holds now names the document; changed: the row that holds now came after the result; unlisted: no
    list ever named it. A result without a time is changed.
    """
    now = spans.where("valid_to IS NULL").select(F.col(RESEARCH).alias("_r"), F.col(KEY).alias("_k"), F.col("valid_from").alias("_since"))
    ever = spans.select(F.col(RESEARCH).alias("_er"), F.col(KEY).alias("_ek"), F.lit(True).alias("_ever")).distinct()
    joined = results.join(now, F.col(RESEARCH).eqNullSafe(F.col("_r")) & (F.col(KEY) == F.col("_k")), "left")
    joined = joined.join(ever, F.col(RESEARCH).eqNullSafe(F.col("_er")) & (F.col(KEY) == F.col("_ek")), "left")
    why = F.when(F.col("_ever").isNull(), "unlisted").when(F.col("_since").isNull(), "removed").when(F.coalesce(F.col("analysed_at") < F.col("_since"), F.lit(True)), "changed")
    return joined.withColumn("stale", why).drop("_r", "_k", "_since", "_er", "_ek", "_ever")


def stale_researches(stale: DataFrame) -> DataFrame:
    """(research_id, results, stale_results, analysis_stale) of `stale_results`."""
    return stale.groupBy(RESEARCH).agg(F.count("*").alias("results"), F.count("stale").alias("stale_results")).withColumn("analysis_stale", F.col("stale_results") > 0)
