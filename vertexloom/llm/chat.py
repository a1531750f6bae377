"""Chat formatting: reply trees to conversations, with DataFrame functions only.

``paths`` enumerates root-to-leaf paths by iterated self-joins: pointer doubling finds each message's
root, depth and summed score in as many joins as the logarithm of the depth; the same jumps, applied
from the leaves of the chosen branches, list the messages of each path, so that a path of n messages
costs n rows. ``render`` turns the rows of a path into one conversation.

The template marks a turn as ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and
texts get a backslash after their first character, after backslashes were doubled; dropping the first
of each pair "backslash, any character" restores them. No control string can arise at a seam, as each
starts with ``<`` or ``[`` and has neither bracket inside.

Only the first and the last step move texts: messages are numbered with them and written, the walks
between are over ids alone, and at the end each message of a path meets its text.

Null texts and roles are empty; an empty table gives no rows. A text of any length is taken whole, and a path
is one row, however long. Columns other than those named below are not looked at. A message without a parent in its tree is a root. Messages whose
chain of parents runs in a circle reach no root and form no path. Rows that repeat a message id are
different messages with the same parent; replies to it belong to the first of them in the order of
role and text. A null tree id is a tree like any other. Branches of equal score rank by leaf id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.workspace import Workspace

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The template's own marks and those of other chat templates.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def escape(c: Column) -> Column:
    """Double backslashes, then break each control string behind its first character."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        c = F.replace(c, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Conversations that are plain lists, as reply trees: each row replies to the one before. Rows
    with the same turn, and null turns, which come first, are ordered by role and text."""
    w = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = rows.select(F.col(tree).alias("tree_id"), F.row_number().over(w).cast("long").alias("message_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree_id, message_id, parent_id, role, text, score) -> one row for each message of each chosen
    path: tree_id, leaf, rank (from 1, by the sum of scores, best first), depth (from 0), role, text.
    ``branches``: how many paths of a tree to choose; None: all."""
    work = Workspace(messages.sparkSession, "chat")
    same = Window.partitionBy("tree_id", "message_id").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    said = messages.select("tree_id", "message_id", "parent_id", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    said = work.save(said.withColumn("copy", F.row_number().over(same).cast("long")), "said")
    nodes = said.select("tree_id", "message_id", "copy", "parent_id", "score")
    first = nodes.filter("copy = 1").select(F.col("tree_id").alias("t"), F.col("message_id").alias("p"), F.lit(1).cast("long").alias("up_copy"))
    hit = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("p"))
    nodes = nodes.join(first, hit, "left").select("tree_id", "message_id", "copy", F.col("p").alias("up"), "up_copy", "score")
    nodes = work.save(nodes, "nodes")
    at_root = F.col("up").isNull()
    jumps = nodes.select("tree_id", "message_id", "copy", "up", "up_copy", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    ranked, levels, open_before, step = jumps.filter(at_root), [], -1, 0
    while True:
        # Only messages that have not reached their root are joined again.
        still = work.save(jumps.filter(~at_root), f"jump{step}")
        n = still.count()
        # As many as before: only circles are left.
        if n in (0, open_before):
            break
        levels.append(still)
        open_before, step = n, step + 1
        far = ranked.unionByName(still).select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("copy").alias("c"), F.col("up").alias("u2"), F.col("up_copy").alias("c2"), F.col("total").alias("more"), F.col("steps").alias("further"))
        on = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")) & (F.col("up_copy") == F.col("c"))
        jumps = still.join(far, on).select("tree_id", "message_id", "copy", F.col("u2").alias("up"), F.col("c2").alias("up_copy"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps"))
        jumps = work.save(jumps, f"far{step}")
        ranked = ranked.unionByName(jumps.filter(at_root))
    parents = nodes.filter("up is not null").select("tree_id", F.col("up").alias("message_id"), F.col("up_copy").alias("copy")).distinct()
    p = parents.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("copy").alias("c"))
    leaves = ranked.join(p, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")) & (F.col("copy") == F.col("c")), "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.desc("total"), "message_id", "copy")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.filter(F.col("rank") <= branches)
    # The messages of each path, from the leaf up: a set of those fewer than 2^k steps away doubles by jumping 2^k steps.
    leaf = F.struct(F.col("message_id").alias("message"), F.col("copy").alias("copy")).alias("leaf")
    members = leaves.select("tree_id", "rank", leaf, "message_id", "copy", (F.col("steps") - 1).alias("depth"))
    for k, level in enumerate(levels):
        if k % 4 == 3:
            members = work.save(members, f"members{k}")
        jump = level.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("copy").alias("c"), "up", "up_copy")
        on = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")) & (F.col("copy") == F.col("c"))
        above = members.join(jump, on).select("tree_id", "rank", "leaf", F.col("up").alias("message_id"), F.col("up_copy").alias("copy"), (F.col("depth") - (1 << k)).alias("depth"))
        members = members.unionByName(above)
    said = said.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("copy").alias("c"), "role", "text")
    on = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")) & (F.col("copy") == F.col("c"))
    return members.join(said, on).select("tree_id", "leaf", "rank", "depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def render(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per path: tree_id, rank, formatted, and mask, the spans (start, length, in characters) of
    ``formatted`` under the loss mask: the texts of role ``trained``, without the marks around them."""
    turns = rows.select("tree_id", "rank", "depth", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("text"), (F.col("role") == trained).alias("loss"))
    before = F.sum(F.length("head") + F.length("text") + len(END)).over(Window.partitionBy("tree_id", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    whole = turns.groupBy("tree_id", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "head", "text", "loss"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    mask = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].cast("int").alias("start"), F.length(t["text"]).alias("length")))
    return whole.select("tree_id", "rank", formatted.alias("formatted"), mask.alias("mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    turns = F.slice(F.split(formatted, r"<\|end\|>"), F.lit(1), F.greatest(F.size(F.split(formatted, r"<\|end\|>")) - 1, F.lit(0)))
    halves = F.transform(turns, lambda t: F.split(F.substring(t, len(TURN) + 1, 1 << 30), r"<\|text\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def digests(rendered: DataFrame) -> DataFrame:
    """What was formatted, read back: conv_id, number and digest of the turns, length and digest of
    the text under the loss mask, length of the whole."""
    nl = F.lit("\n")
    turns = rendered.select("tree_id", "formatted", "mask", read_back(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    return turns.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
