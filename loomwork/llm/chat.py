"""Reply trees to formatted conversations, with DataFrame functions only.

Root-to-leaf paths come from iterative self-joins that double the covered
distance each round, so a thread of depth d takes log2(d) joins.  Branches are
ranked by score, and each chosen path is formatted as one conversation.

Template, one turn after another::

    <|role|>
    text<|end|>

Inside roles and texts a backslash is put before every backslash, and between
the two characters of ``<|`` and of ``|>``, before a ``>`` with which a role
begins, and before the role ``end``, whose head would be the mark of a turn's
end.  So no control string survives in a text, and dropping each first
backslash restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, save, scratch

END = "<|end|>\n"


def escape(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths of ``nodes(tree, node, parent)``: ``tree, leaf, node, up``.

    ``up`` is the distance from the leaf.  A node whose parent is null or not
    in the tree is a root.  Nodes that only reach a cycle belong to no path.
    """
    spark, folder = nodes.sparkSession, scratch(nodes.sparkSession)
    ids = nodes.select("tree", "node")
    parents = ids.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    has_parent = nodes.select("tree", "node", "parent").join(
        parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p"))
    )
    jump = save(has_parent.select("tree", "node", F.col("p").alias("to")), f"{folder}/jump0")
    inner = jump.select(F.col("tree").alias("t"), F.col("to").alias("p")).distinct()
    leaves = ids.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    first = jump
    paths = save(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), f"{folder}/paths0")
    reach, left, total, k = 1, jump.count(), nodes.count(), 0
    while left and reach <= total:
        k += 1
        step = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to"))
        at = F.col("tree").eqNullSafe(F.col("t"))
        longer = paths.join(step, at & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up")
        )
        grown = save(paths.unionByName(longer), f"{folder}/paths{k}")
        twice = jump.join(step.withColumnRenamed("to", "far"), at & (F.col("to") == F.col("n")))
        wider = save(twice.select("tree", "node", F.col("far").alias("to")), f"{folder}/jump{k}")
        remove(spark, f"{folder}/paths{k - 1}")
        if k > 1:
            remove(spark, f"{folder}/jump{k - 1}")
        paths, jump, reach = grown, wider, reach * 2
        left = jump.count()
    if left:  # a cycle: keep the paths that end at a root
        tops = ids.join(
            first.select(F.col("tree").alias("t"), F.col("node").alias("n")),
            F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")),
            "left_anti",
        ).select(F.col("tree").alias("t"), F.col("node").alias("n"))
        whole = (
            paths.join(tops, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_semi")
            .select(F.col("tree").alias("t"), F.col("leaf").alias("n"))
            .distinct()
        )
        paths = paths.join(whole, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n")), "left_semi")
    return paths


def format_reply_trees(messages: DataFrame, *, top: int | None = None, learn: str = "assistant") -> DataFrame:
    """Format each chosen root-to-leaf path of each tree as one conversation.

    ``messages`` has ``tree, node, parent, role, text, score``.  Returns
    ``tree, leaf, branch_score, branch_rank, n_turns, formatted, loss_spans``;
    ``loss_spans`` are code-point ranges ``{from, to}`` of ``formatted`` that
    hold the texts of role ``learn``, without the markup.  Branches of a tree
    are ranked by the sum of their scores (null: 0), ties by the smaller leaf;
    ``top`` keeps that many a tree (the feature; None keeps all).

    Null roles and texts are empty strings.  Null tree ids form one tree; rows
    with a null node id are no nodes.  Of rows that repeat a node id within a
    tree, the smallest by (parent, role, text, score) is the node.  An empty
    table gives an empty result; extra columns are ignored.
    """
    node = F.struct(
        F.col("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    nodes = (
        messages.where(F.col("node").isNotNull())
        .groupBy("tree", "node")
        .agg(F.min(node).alias("x"))
        .select("tree", "node", "x.*")
    )
    nodes = save(nodes, f"{scratch(messages.sparkSession)}/nodes")
    paths = reply_paths(nodes)

    opened = F.when(F.col("role").startswith(">") | (F.col("role") == "end"), "<|\\").otherwise("<|")
    turn = F.concat(opened, escape(F.col("role")), F.lit("|>\n"))
    texts = nodes.select(
        F.col("tree").alias("t"),
        F.col("node").alias("n"),
        turn.alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == learn).alias("learn"),
        "score",
    )
    rows = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    width = F.char_length("head") + F.char_length("body") + len(END)
    start = F.coalesce(F.sum(width).over(before), F.lit(0)) + F.char_length("head")
    span = F.struct(start.alias("from"), (start + F.char_length("body")).alias("to"))
    piece = F.struct(
        (-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("text"), "learn", span.alias("span")
    )
    joined = (
        rows.select("tree", "leaf", "score", piece.alias("piece"))
        .groupBy("tree", "leaf")
        .agg(F.array_sort(F.collect_list("piece")).alias("p"), F.sum("score").alias("branch_score"))
    )
    best = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    out = joined.select(
        "tree",
        "leaf",
        "branch_score",
        F.row_number().over(best).alias("branch_rank"),
        F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.col("p.text"), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["learn"]), lambda x: x["span"]).alias("loss_spans"),
    )
    return out if top is None else out.where(F.col("branch_rank") <= top)


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of ``{role, text}``."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "|>\n", 1)
        text = F.substr(piece, F.char_length(head) + 4)
        return F.struct(unescape(F.substr(head, F.lit(3))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, s["from"] + 1, s["to"] - s["from"]))), ""
    )


def threads(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` rows as trees in which each turn replies to the one before.

    Rows are ordered by turn (null first), ties by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order)
    return turns.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text").select(
        "tree",
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(None).cast("double").alias("score"),
    )
