"""Reply trees as formatted conversations, in DataFrame operations alone.

Messages form trees by their parent. Root-to-leaf paths are enumerated by self-joins
that double: after round k every leaf has its 2^k nearest ancestors, so a path of n
messages takes log2(n) rounds, and no chain is walked one message at a time. The branches
of a root are ranked by the mean score of their messages and the best are formatted.

The template writes a turn as ``### Role: text </turn>`` and a line feed, with the role's
first letter raised. In roles and texts a backslash becomes two, ``#`` becomes
backslash h and ``<`` backslash l, and in roles ``:`` becomes backslash c, so no control string can occur inside them and reading back is
exact. The loss mask is the span of each assistant text, in code points of the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .storage import cut

END = " </turn>\n"


def escaped(text):
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit("<"), F.lit("\\l"))


def unescaped(text):
    """Undo ``escaped``: pairs of backslashes are split at, from the left, so what stands between has single ones."""
    parts = F.split(text, r"\\\\", -1)

    def plain(p):
        for code, char in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            p = F.replace(p, F.lit(code), F.lit(char))
        return p

    return F.array_join(F.transform(parts, plain), "\\")


def linear_nodes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations without replies as trees of one branch: tree, node, parent, role, text, score."""
    rows = turns.select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # A conversation becomes one output row, so its turns meet in one task in any case.
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every message on a leaf's path; up counts from the leaf.

    A parent that does not exist in the tree, or a null one, makes a root. Messages in a cycle
    of replies, and those below one, have no root above them and take no part: each round shortens
    some path that ends at a root, so what is left when a round shortens none hangs on a cycle.
    Rows that repeat a (tree, node, parent) are one message; a node with several parents has a path through each.
    """
    ids = cut(nodes.select("tree", "node", "parent").distinct(), "nodes")
    real = ids.select("tree", F.col("node").alias("parent")).distinct()
    jump = ids.where("parent is not null").join(real, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above"))
    leaves = ids.join(jump.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    jump = cut(jump, "jump")
    reach = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    span, left = 1, jump.select("tree", "node").distinct().count()
    while left:
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + span).alias("up"))
        reach = cut(reach.union(further), "paths")
        again = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        jump = cut(jump.join(again, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")).distinct(), "jump")
        span *= 2
        before, left = left, jump.select("tree", "node").distinct().count()
        if left == before:
            return reach.join(jump.select("tree", F.col("node").alias("leaf")).distinct(), ["tree", "leaf"], "left_anti")
    return reach


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best branches of each root as messages: tree, root, leaf, place from 1, pos from 0, role, text.

    Branches rank by the mean score of their messages (null scores count 0), the smaller leaf first on
    a tie. ``branches`` a root are chosen.
    """
    walked = paths(nodes)
    named = walked.join(nodes.select("tree", "node", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    top = named.groupBy("tree", "leaf").agg(F.max("up").alias("depth"), F.avg("score").alias("score"), F.max_by("node", "up").alias("root"))
    best = Window.partitionBy("tree", "root").orderBy(F.desc("score"), "leaf")
    chosen = top.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches)
    return named.drop("score").join(chosen.select("tree", "leaf", "root", "place", "depth"), ["tree", "leaf"]).select("tree", "root", "leaf", "place", (F.col("depth") - F.col("up")).alias("pos"), "role", "text")


def formatted(messages: DataFrame, keys: tuple[str, ...] = ("tree", "leaf"), loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: keys, formatted, loss_spans array<struct<start, length>>.

    Spans count code points from 0. Null texts and roles are empty.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    label = F.replace(escaped(role), F.lit(":"), F.lit("\\c"))
    raised = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30))
    # A role that does not start with a letter from a to z is marked, so reading back lowers no other.
    head = F.concat(F.lit("### "), F.when(role.rlike("^[a-z]"), raised).otherwise(F.concat(F.lit("="), label)), F.lit(": "))
    rows = messages.select(*keys, "pos", (role == loss_role).alias("learn"), head.alias("head"), escaped(text).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "learn", "start", F.length("body").alias("length")))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].cast("long").alias("length")))
    return got.select(*keys, F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(rows: DataFrame, text_col: str = "formatted") -> DataFrame:
    """``rows`` with turns array<struct<role, text>> read from the formatted text."""
    pieces = F.filter(F.split(F.col(text_col), " </turn>\n", -1), lambda p: p != "")

    def turn(p):
        mark = F.locate(": ", p)
        label = F.substring(p, F.lit(5), mark - 5)
        rest = F.substring(label, 2, 1 << 30)
        role = F.when(F.substring(label, 1, 1) == "=", rest).otherwise(F.concat(F.lower(F.substring(label, 1, 1)), rest))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, mark + 2, F.length(p))).alias("text"))

    return rows.withColumn("turns", F.transform(pieces, turn))
