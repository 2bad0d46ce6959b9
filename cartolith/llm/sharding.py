"""Balanced label propagation: linked texts move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucketed_rank, cut, shuffle_partitions, text_or_empty, uniform

#: Lines of at least so many characters link the texts that hold them.
LINK_CHARS = 20
#: A shard may hold so many times the mean while labels move; the final deal is even to one row.
SLACK = 1.05
#: Rows that a task numbers at a time in the final deal, and buckets a shard has at most.
BUCKET_ROWS, BUCKETS = 500, 4096
#: A line that more than 1 / (HOT_SHARE * partitions) of all texts hold is sent to the texts instead of the texts to it.
HOT_SHARE = 4


def _links(rows: DataFrame, nodes: int, kept: Scratch) -> tuple[DataFrame, DataFrame]:
    """(_node, _line, _share) of the lines that a text shares with others, common lines apart; a line of n texts weighs 1 / (n - 1).

    Lines stand between texts, so a line that a third of all texts hold costs one row a text and no pairs. There are at
    most HOT_SHARE * partitions common lines for each line that a text holds on average, which bounds their broadcast.
    """
    lines = F.explode(F.array_distinct(F.transform(F.filter(F.split(text_or_empty(F.col("_text")), "\n"), lambda s: F.length(s) >= LINK_CHARS), lambda s: F.xxhash64(s))))
    held = kept.cut(rows.select("_node", lines.alias("_line")).groupBy("_node", "_line").agg(F.count("*").alias("_c")).drop("_c"), "lines")
    shared = held.groupBy("_line").agg(F.count("*").alias("_texts")).where("_texts > 1")
    limit = max(1000, nodes // (HOT_SHARE * shuffle_partitions(rows.sparkSession)))
    hot = kept.cut(shared.where(F.col("_texts") > limit), "hot")
    share = (F.lit(1.0) / (F.col("_texts") - 1)).alias("_share")
    rest = held.join(F.broadcast(hot.select("_line")), "_line", "left_anti").join(shared.where(F.col("_texts") <= limit), "_line")
    common = held.join(F.broadcast(hot), "_line")
    return tuple(kept.cut(part.select("_node", "_line", share), "links") for part in (rest, common))


def voices(state: DataFrame, links: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(_node, _own, _shard, _line, _g): what a text hears over a line: the weight of its neighbours in each shard where it has some.

    The texts of a line are counted by shard, at most `shards` rows a line, and a text hears these counts without itself.
    """
    parts = []
    for part, common in zip(links, (False, True)):
        seen = part.join(state.select("_node", F.col("_shard").alias("_own")), "_node")
        votes = seen.groupBy("_line", F.col("_own").alias("_shard")).agg(F.count("*").alias("_n"))
        told = seen.join(F.broadcast(votes) if common else votes, "_line")
        weight = F.col("_share") * (F.col("_n") - (F.col("_own") == F.col("_shard")).cast("int"))
        parts.append(told.select("_node", "_own", "_shard", "_line", weight.alias("_g")))
    return parts[0].unionByName(parts[1])


def propagate(nodes: DataFrame, links: tuple[DataFrame, DataFrame], shards: int, rounds: int, kept: Scratch) -> DataFrame:
    """(_node, _w, _shard) after some rounds.

    In a round a text wants the shard with the greatest weight of neighbours, of equals its own, then the smallest. From
    shard s to t, moves are let through by share: as many as go the other way, and then what t has free. The table of
    flows has shards * shards rows at most, which bounds its broadcast.
    """
    # texts of a line start together, and a start costs nothing: the rarest line of a text picks its shard
    start = links[0].groupBy("_node").agg(F.max(F.struct("_share", "_line")).alias("_m")).select("_node", "_m._line")
    first = nodes.join(start, "_node", "left").select("_node", "_w", F.pmod(F.xxhash64(F.coalesce("_line", "_node")), F.lit(shards)).cast("int").alias("_shard"))
    state = kept.cut(first, "labels")
    total = float(nodes.agg(F.sum("_w")).first()[0] or 0)
    cap = SLACK * total / shards
    for k in range(rounds):
        sums = voices(state, links).groupBy("_node", "_own", "_shard").agg(F.sum("_g").alias("_g"))
        best = sums.groupBy("_node", "_own").agg(F.max(F.struct("_g", (F.col("_shard") == F.col("_own")).alias("stay"), (-F.col("_shard")).alias("to"))).alias("b"))
        wants = kept.cut(best.select("_node", (-F.col("b.to")).alias("_to")).where("_to <> _own").join(state, "_node"), "wants")
        flow = wants.groupBy(F.col("_shard").alias("s"), F.col("_to").alias("t")).agg(F.sum("_w").cast("double").alias("f"))
        back = flow.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("f").alias("r"))
        free = state.groupBy(F.col("_shard").alias("t")).agg(F.greatest(F.lit(0.0), F.lit(cap) - F.sum("_w")).alias("free"))
        rest = flow.join(back, ["s", "t"], "left").join(free, "t", "left")
        rest = rest.select("s", "t", "f", F.least("f", F.coalesce("r", F.lit(0.0))).alias("even"), F.coalesce("free", F.lit(cap)).alias("free"))
        left = rest.groupBy("t").agg(F.sum(F.col("f") - F.col("even")).alias("left"))
        pass_on = (F.col("even") + (F.col("f") - F.col("even")) * F.least(F.lit(1.0), F.col("free") / F.greatest("left", F.lit(1e-9)))) / F.col("f")
        quota = rest.join(left, "t").select(F.col("s").alias("_shard"), F.col("t").alias("_to"), pass_on.alias("_p"))
        moves = wants.join(F.broadcast(quota), ["_shard", "_to"]).where(uniform(F.col("_node"), f"round{k}") < F.col("_p")).select("_node", F.col("_to").alias("_new"))
        state = kept.cut(state.join(moves, "_node", "left").select("_node", "_w", F.coalesce("_new", "_shard").alias("_shard")), "labels")
    return state


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4) -> DataFrame:
    """Every row of df with its shard and slot, by the law `rows`: shards' row counts differ by one at most.

    Equal texts are one node of the graph; nodes are linked where they share a line. After propagation a row keeps the
    shard of its label up to the shard's quota, and only what is over goes to shards with room: first rows without a
    neighbour in their shard, which lose nothing, then rows side by side that share a line, so that they stay together
    where they go. Copies are side by side as well. Null texts count as
    empty with size 8. Repeated rows and null ids are rows like others; which of two equal rows gets which slot is left
    open. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    spark = df.sparkSession
    kept = Scratch(spark, "shards")
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text_or_empty(text)).alias("_node"))
    nodes = kept.cut(rows.groupBy("_node").agg(F.count("*").alias("_w")), "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.sum("_w").alias("rows")).first()
    total = size["rows"] or 0
    links = _links(rows, size["n"], kept)
    state = propagate(nodes, links, shards, rounds, kept)
    inside = voices(state, links).where("_own = _shard and _g > 0").groupBy("_node").agg(F.max(F.struct("_g", "_line")).alias("_m")).select("_node", F.col("_m._line").alias("_with"))
    state = kept.cut(state.join(inside, "_node", "left"), "settled")
    buckets = min(BUCKETS, max(1, total // (shards * BUCKET_ROWS)))
    limit = max(64, total // (4 * shards * buckets))  # a heavier node gets buckets of its own: at most 4 * shards * buckets of them, and as many more buckets
    # an arbitrary number deals the equal rows of a heavy text; it is written down, so that it stays what it is
    narrow = rows.select(
        "_node", "_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("_bytes"), F.crc32(F.encode(text_or_empty(F.col("_text")), "UTF-8")).alias("_crc"), F.monotonically_increasing_id().alias("_row")
    )
    heavy: Column = F.col("_w") > limit
    group = F.coalesce("_with", "_node")
    placed = kept.cut(narrow.join(state, "_node").select(
        "_id", "_bytes", "_crc", "_node", "_shard", "_row", F.col("_with").isNull().alias("_alone"), group.alias("_group"),
        F.pmod(F.shiftrightunsigned(group, 7), F.lit(buckets)).alias("_b"),
        F.when(heavy, F.col("_node")).alias("_heavy"),
        F.when(heavy, F.pmod(F.xxhash64("_row"), F.ceil(F.col("_w") / F.lit(limit)))).otherwise(F.lit(0)).cast("long").alias("_part"),
    ), "placed")
    ranked = bucketed_rank(placed, ["_shard"], ["_alone", "_b", "_heavy", "_part"], [F.col("_group"), F.col("_node"), F.col("_id").asc_nulls_last(), F.col("_row")], "_rank")
    held = {r["_shard"]: r["n"] for r in placed.groupBy("_shard").agg(F.count("*").alias("n")).collect()}  # `shards` rows
    each, more = divmod(total, shards)
    quotas, over, room = [], 0, [(-1, 0, 0, 0)]
    free = 0
    for s in range(shards):
        quota, n = each + (s < more), held.get(s, 0)
        quotas.append((s, quota, over - quota))
        over += max(0, n - quota)
        if n < quota:
            room.append((s, free, free + quota - n, n - free))
            free += quota - n
    own = spark.createDataFrame(quotas, "_shard int, _quota long, _shift long")
    space = spark.createDataFrame(room, "_to int, _lo long, _hi long, _slot long")
    marked = ranked.join(F.broadcast(own), "_shard").withColumn("_over", F.when(F.col("_rank") >= F.col("_quota"), F.col("_rank") + F.col("_shift")))
    dealt = marked.join(F.broadcast(space), (F.col("_over") >= F.col("_lo")) & (F.col("_over") < F.col("_hi")), "left")
    out = cut(dealt.select(
        F.col("_id").alias(id_col),
        (F.col("_bytes") + 8).alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.coalesce("_to", "_shard").cast("int").alias("shard"),
        F.coalesce(F.col("_over") + F.col("_slot"), F.col("_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_shard").alias("label"),
    ), "sharded")
    kept.clear()
    return out
