"""Reply trees to training conversations, with DataFrame operations only.

``reply_paths`` enumerates root-to-leaf paths by self-joins that double the distance they jump: levels of jump
tables up, then the ancestors of every leaf down, so a tree of depth d takes about 2 log2(d) joins and no more rows
than the paths have; nodes that never reach a root are found by it and left out. ``format_paths`` renders each chosen path; ``read_back`` parses what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(c: Column) -> Column:
    """Leaves no '<' and no lone backslash; every backslash starts a two-character code."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chain(rows: DataFrame) -> DataFrame:
    """Conversations given as turns (conv_id, turn, role, text) as trees with one branch: node and parent are positions.

    Rows of one turn number (ties, repeats) stand in order of role, then text; null turns come first. A null conv_id
    is a conversation of its own.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(w).cast("long")
    return rows.select("conv_id", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _key(conv_id: Column) -> Column:
    """A conversation's name as text; null is one of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row (c, node, parent, score, role, text) a node; of several, the least in this order of columns, nulls first."""
    given = {"parent": F.lit(None).cast("long"), "score": F.lit(0.0), "role": F.lit(""), "text": F.lit("")}
    row = F.struct(*[(F.col(c) if c in nodes.columns else absent).alias(c) for c, absent in given.items()])
    one = nodes.select(_key(F.col("conv_id")).alias("c"), "node", row.alias("row")).groupBy("c", "node").agg(F.min("row").alias("row"))
    return one.select("c", "node", "row.parent", F.coalesce("row.score", F.lit(0.0)).alias("score"), F.coalesce("row.role", F.lit("")).alias("role"), F.coalesce("row.text", F.lit("")).alias("text"))


def reply_paths(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(c, leaf, rank, pos, node): the nodes of each root-to-leaf path, pos 0 at the root; c names the conversation.

    nodes: conv_id, node, parent (null at roots), score (null: 0), and role and text for ``distinct_nodes``. Paths of a
    conversation are ranked by the sum of their scores, highest first, ties by the smaller leaf; with ``top``, only
    that many are kept. A node whose parent is missing is a root. Of repeated nodes one counts. Nodes on or below a
    cycle don't reach a root and give no path. An empty table gives no rows.
    """
    own = materialise(distinct_nodes(nodes).select("c", "node", "parent", "score"), "nodes")
    there = own.select("c", F.col("node").alias("up"))
    jump = materialise(own.select("c", "node", F.col("parent").alias("up")).join(there, ["c", "up"]).select("c", "node", "up"), "jump0")
    levels, left = [jump], jump.count()
    while left:
        last = levels[-1]
        onward = materialise(last.join(last.select("c", F.col("node").alias("up"), F.col("up").alias("upper")), ["c", "up"]).select("c", "node", F.col("upper").alias("up")), f"jump{len(levels)}")
        # a node this deep has an ancestor of exactly this depth, which jumps no further: only nodes without a root all jump
        left, before = onward.count(), left
        if left == before:
            lost = onward.select("c", "node")
            own, levels = materialise(own.join(lost, ["c", "node"], "left_anti"), "rooted"), [x.join(lost, ["c", "node"], "left_anti") for x in levels[:-1]] or [jump.limit(0)]
            jump = levels[0]
            break
        if left:
            levels.append(onward)
    leaves = own.join(jump.select("c", F.col("up").alias("node")).distinct(), ["c", "node"], "left_anti").select("c", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in range(len(levels) - 1, -1, -1):
        leaves = leaves.unionByName(leaves.join(levels[k], ["c", "node"]).select("c", "leaf", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above")))
        leaves = materialise(leaves, f"paths{k}")
    scored = leaves.join(own.select("c", "node", "score"), ["c", "node"]).groupBy("c", "leaf").agg(F.sum("score").alias("total"), F.max("above").alias("depth"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("total"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return leaves.join(ranked.select("c", "leaf", "rank", "depth"), ["c", "leaf"]).select("c", "leaf", "rank", (F.col("depth") - F.col("above")).alias("pos"), "node")


def format_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per path: conv_id, leaf, rank, formatted, loss_spans (array of start, end in code points).

    Each turn is OPEN, its role, a new line, its text, CLOSE; null roles and texts are empty. Spans cover the texts of
    the role "assistant".
    """
    kind = nodes.schema["conv_id"].dataType
    content = distinct_nodes(nodes).select(F.when(F.col("c") != "", F.substring("c", 2, 2**31 - 1)).cast(kind).alias("conv_id"), "c", "node", "role", "text")
    turns = paths.join(content, ["c", "node"]).select(
        "conv_id", "leaf", "rank", "pos", "role",
        F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + len(CLOSE)
    w = Window.partitionBy("conv_id", "leaf", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum(size).over(w) - F.length("body") - len(CLOSE)).cast("long")
    turns = turns.select("*", start.alias("start")).select("conv_id", "leaf", "rank", F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), (F.col("role") == "assistant").alias("loss"), "start", (F.col("start") + F.length("body")).alias("end")).alias("t"))
    out = turns.groupBy("conv_id", "leaf", "rank").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return out.select(
        "conv_id", "leaf", "rank",
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, leaf, rank, formatted, turns (array of role, text) and loss_text, parsed from the formatted strings alone."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    inner = lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
    role = lambda x: F.substring_index(inner(x), "\n", 1)
    turn = lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring(inner(x), F.length(role(x)) + 2, F.length(x))).alias("text"))
    spans = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "leaf", "rank", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(spans, "").alias("loss_text"))
