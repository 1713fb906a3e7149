"""Chat formatting by reply trees (DataFrame and SQL functions only).

A message table is a forest: every row names its parent.  Iterative self-joins double the
reach of each row's ancestor link, so a path of depth d needs about log2(d) joins; the same
links, walked from the longest to the shortest, list every row of a root-to-leaf path.  Paths
are ranked by the mean score of their rows and each chosen path becomes one conversation.

Defined results: null text or role counts as empty; rows whose parent is null or absent are
roots; of rows that repeat a (conversation, message) key the smallest (role, text) stays; rows
on a cycle lie on no root-to-leaf path and are left out; an empty table gives an empty result;
columns beyond those named are ignored.  A null conversation id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    """``<|`` never appears in the result: every ``<\\*|`` gains one backslash."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """As escape(), and one line: a backslash doubles first, a line feed becomes ``\\n``."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    parts = F.split(unescape(c), r"\\\\")  # a pair of backslashes is one
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def chain(conversations: DataFrame) -> DataFrame:
    """A reply tree of rows that only have a turn: each row answers the one before it (ties: role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.row_number().over(w).cast("long").alias("msg_id"),
        (F.row_number().over(w) - 1).cast("long").alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _on(a: str, x: str, b: str, y: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))


def paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Rows (conv_id, leaf, branch, path_score, depth, role, text): every row of every chosen root-to-leaf path.

    ``branch`` ranks the leaves of a conversation by the mean score of their path (ties: smaller
    leaf id); ``top`` keeps that many branches, None keeps all.
    """
    rows = saved(
        messages.groupBy("conv_id", "msg_id").agg(
            F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("r")
        ).filter("msg_id is not null").select("conv_id", "msg_id", "r.*")
    )
    ids = rows.select("conv_id", "msg_id")
    linked = rows.alias("a").join(ids.alias("b"), _on("a", "parent_id", "b", "msg_id"), "left").select("a.conv_id", "a.msg_id", F.col("b.msg_id").alias("up"), F.col("a.score").alias("total"), F.lit(1).cast("long").alias("depth"))
    state = saved(linked)
    hops, ends = [state.filter("up is not null")], [state.filter("up is null")]
    left, reach = hops[0].count(), 2 * rows.count()
    while left:  # only rows whose link has not passed the root are joined again
        step = hops[-1].alias("a").join(state.alias("b"), _on("a", "up", "b", "msg_id")).select(
            "a.conv_id", "a.msg_id", F.col("b.up").alias("up"), (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.depth") + F.col("b.depth")).alias("depth")
        )
        step = saved(step)
        state = ends[0]
        for e in ends[1:]:
            state = state.unionByName(e)
        state = state.unionByName(step)
        hops.append(step.filter("up is not null"))
        ends.append(step.filter("up is null"))
        before, left = left, hops[-1].count()
        if left == before and 2 ** len(hops) > reach:
            break  # only cycles are left
    all_ends = ends[0]
    for e in ends[1:]:
        all_ends = all_ends.unionByName(e)
    ends = all_ends
    parents = hops[0].select("conv_id", F.col("up").alias("msg_id")).distinct()
    leaves = ends.alias("a").join(parents.alias("b"), _on("a", "msg_id", "b", "msg_id"), "left_anti")
    leaves = leaves.select("conv_id", F.col("msg_id").alias("leaf"), (F.col("total") / F.col("depth")).alias("path_score"))
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf")))
    if top is not None:
        ranked = ranked.filter(F.col("branch") <= top)
    on_path = ranked.withColumn("msg_id", F.col("leaf"))
    for h in reversed(hops):
        more = on_path.alias("a").join(h.alias("b"), _on("a", "msg_id", "b", "msg_id")).select("a.conv_id", "a.leaf", "a.path_score", "a.branch", F.col("b.up").alias("msg_id"))
        on_path = saved(on_path.unionByName(more))  # else the plan doubles with each hop
    level = ends.select("conv_id", "msg_id", "depth")
    full = rows.alias("a").join(level.alias("b"), _on("a", "msg_id", "b", "msg_id")).select("a.conv_id", "a.msg_id", "a.role", "a.text", "b.depth")
    return on_path.alias("a").join(full.alias("b"), _on("a", "msg_id", "b", "msg_id")).select("a.conv_id", "a.leaf", "a.branch", "a.path_score", "b.depth", "b.role", "b.text")


def format_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, leaf, branch, path_score, formatted, loss_mask): loss_mask lists the [start, end) code points of assistant texts."""
    whole = Window.partitionBy("conv_id", "leaf").orderBy("depth")
    t = turns.withColumn("role_out", escape_role("role")).withColumn("text_out", escape("text"))
    head = F.concat(F.lit(START), F.col("role_out"), F.lit("\n"))
    t = t.withColumn("head_len", F.length(head)).withColumn("body_len", F.length("text_out"))
    t = t.withColumn("begin", F.sum(F.col("head_len") + F.col("body_len") + len(END) + 1).over(whole) - F.col("body_len") - len(END) - 1)
    t = t.withColumn("piece", F.concat(head, F.col("text_out"), F.lit(END + "\n")))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("begin").alias("start"), (F.col("begin") + F.col("body_len")).alias("end")))
    g = t.groupBy("conv_id", "leaf", "branch", "path_score").agg(F.sort_array(F.collect_list(F.struct("depth", "piece"))).alias("ps"), F.sort_array(F.collect_list(span)).alias("loss_mask"))
    return g.select("conv_id", "leaf", "branch", "path_score", F.array_join(F.col("ps.piece"), "").alias("formatted"), "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the output again: adds ``turns`` array<struct<role,text>> and ``loss_text``."""
    tail = len(END) + 1

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        at = F.length(role) + 2
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(x, at, F.length(x) - at + 1 - tail)).alias("text"))

    pieces = F.split("formatted", r"<\|im_start\|>")
    masked = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)).withColumn("loss_text", F.array_join(masked, ""))
