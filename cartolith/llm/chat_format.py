"""Reply trees formatted as chats.

Messages point to the message that they answer. Iterative self-joins double the distance that each message looks
upwards, so a root-to-leaf path of n messages takes log2(n) joins; the joins carry keys and sums only, no text. Leaves
are ranked by the mean score of their path, and the paths of the chosen leaves are enumerated by the same doubled
steps, each message of a path once. Only then do the texts join, and each path becomes one conversation.

The template is <|im_start|>role, a line feed, the text, <|im_end|> and a line feed for each message. In texts and roles
every control string gets one more backslash after its first character, whatever number of them it has there, and loses
one when it is read back; so no text can hold a control string, and every text can be read back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, free_name

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat models read as control, in several templates; none begins inside another one.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"


def control_pattern(slashes: str) -> str:
    """A pattern of all control strings, with `slashes` after the first character; groups 1 or 4 hold that character, 3 or 6 the rest."""
    def literal(s: str) -> str:
        return "".join("\\" + c if c in r"|[]()\.*+?^${}" else c for c in s)

    rest = {first: "|".join(literal(s[1:]) for s in CONTROL if s[0] == first) for first in "<["}
    return "|".join(f"({literal(first)}){slashes}({r})" for first, r in rest.items())


ESCAPE, UNESCAPE = control_pattern(r"(\\*)"), control_pattern(r"\\(\\*)")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$4\\$2$5$3$6")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$4$2$5$3$6")


def _role_out(role: Column) -> Column:
    """A role is one line: its backslashes and line feeds are written as two characters, then control strings are escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\", -1)  # at pairs of backslashes, read from the left
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def chained(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, id, parent, role, text, score) of a table of turns: each row answers the one before it, so a conversation is one path.

    Rows are ordered by turn (null last), then role and text, so repeated turns all stay. A null role or text is empty.
    """
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("_turn").asc_nulls_last(), "role", "text")).cast("long")
    return own.withColumn("id", at).select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _tree(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, conv, id, up, score) of the messages that count: row is a number of their own, up the row of the answered message."""
    keys = rows.where(F.col("id").isNotNull()).select("row", "conv", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "role", F.md5("text").alias("digest"))
    order = [F.col("score").desc(), F.col("role"), F.col("digest"), F.col("parent").asc_nulls_last(), F.col("row")]
    one = keys.withColumn("_at", F.row_number().over(Window.partitionBy("conv", "id").orderBy(*order))).where("_at = 1")
    one = scratch.cut(one.select("row", "conv", "id", "parent", "score"), "messages")
    above = one.select(F.col("conv").alias("_c"), F.col("id").alias("_i"), F.col("row").alias("up"))
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_i")) & (F.col("parent") != F.col("id"))
    return scratch.cut(one.join(above, same, "left").select("row", "conv", "id", "up", "score"), "tree")


def _upwards(tree: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """((row, depth, total) of every message that hangs from a root, [(row, up)] where `up` is 1, 2, 4 ... messages above).

    A message looks at its parent first, then at what that looks at, and so on; one that has met its root is done, and the
    others are joined again. Messages on a circle, or below one, never meet a root and have no row.
    """
    done = tree.where("up IS NULL").select("row", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    waits = tree.where("up IS NOT NULL").select("row", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    steps, left = [], waits.count()
    for _ in range(left.bit_length() + 1):  # a path is no longer than that
        if not left:
            break
        steps.append(waits.select("row", "up"))
        ends = done.select(F.col("row").alias("_row"), F.lit(None).cast("long").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_t"))
        ends = ends.unionByName(waits.select(F.col("row").alias("_row"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_t")))
        met = waits.join(ends, F.col("up") == F.col("_row"))
        met = scratch.cut(met.select("row", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_t")).alias("total")), "met")
        done = done.unionByName(met.where("up IS NULL").drop("up"))
        waits = met.where("up IS NOT NULL")
        left = waits.count()
    return done, steps


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, path, position, role, text) of the chosen root-to-leaf paths of messages (conv, id, parent, role, text, score).

    Of each conversation the `branches` paths of the greatest mean score are chosen, ties to the longer path and then to
    the smaller leaf; path counts them from 1, and position counts messages from 1. Every message of a path is there once.
    A message without a parent, or whose parent does not exist or is itself, is a root, and a conversation may have several.
    Of rows that repeat an id in a conversation the one of the greatest score counts, ties by role, the text's digest and
    parent. A null id, and messages on a circle of parents or below one, are on no path. A null score is 0, a null role or
    text is empty, a null conversation is a conversation. An empty table gives no path; other columns are ignored.
    """
    scratch = Scratch(messages.sparkSession, "replies")
    empty = F.lit("")
    rows = messages.select("conv", "id", "parent", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), "score")
    rows = scratch.cut(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    tree = _tree(rows, scratch)
    done, steps = _upwards(tree, scratch)
    answered = tree.where("up IS NOT NULL").select("up").distinct()
    leaves = done.join(answered, F.col("row") == F.col("up"), "left_anti").join(tree.select("row", "conv", "id"), "row")
    best = Window.partitionBy("conv").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "id")
    chosen = leaves.withColumn("path", F.row_number().over(best)).where(F.col("path") <= branches)
    on_path = scratch.cut(chosen.select("conv", "path", "row", F.col("depth").alias("position")), "paths")
    # after step k the paths hold their 2^(k + 1) last messages: each one there meets the one 2^k above it
    for k, step in enumerate(steps):
        more = on_path.join(step, "row").select("conv", "path", F.col("up").alias("row"), (F.col("position") - (1 << k)).alias("position"))
        on_path = scratch.cut(on_path.unionByName(more), "paths")
    out = cut(on_path.join(rows.select("row", "role", "text"), "row").select("conv", "path", "position", "role", "text"), "turns")
    scratch.clear()
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """(conv, path, chat, mask) of turns (conv, path, position, role, text).

    mask lists the spans [from, to) of `chat`, in code points, that are trained on: the texts of the role `assistant`. A
    conversation is one row, as it is one text; rows of different conversations are never brought together.
    """
    written = turns.select("conv", "path", "position", F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == TRAINED).alias("trained"))
    long_ = (F.length("head") + F.length("body") + F.lit(len(END) + 1)).cast("long")
    before = Window.partitionBy("conv", "path").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(long_).over(before), F.lit(0)) + F.length("head")
    own = written.withColumn("begin", begin).select("conv", "path", F.struct("position", F.concat("head", "body", F.lit(END + "\n")).alias("turn"), "trained", "begin", (F.col("begin") + F.length("body")).alias("end")).alias("t"))
    lists = own.groupBy("conv", "path").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    mask = F.transform(F.filter("ts", lambda t: t.trained), lambda t: F.struct(t.begin.alias("begin"), t.end.alias("end")))
    return lists.select("conv", "path", F.array_join(F.transform("ts", lambda t: t.turn), "").alias("chat"), mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns, a list of (role, text), and trained, the list of texts under the mask, all from chat and mask alone."""
    pieces = F.split("chat", r"<\|im_end\|>\n", -1)  # no text holds this: its control string is escaped there
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(START) + 1)), "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescaped(F.substr(piece, F.instr(piece, "\n") + 1)).alias("text"))

    under = F.transform("mask", lambda m: unescaped(F.substr(F.col("chat"), (m.begin + 1).cast("int"), (m.end - m.begin).cast("int"))))
    return chats.withColumns({free_name(chats, "turns"): F.transform(pieces, turn), free_name(chats, "trained"): under})
