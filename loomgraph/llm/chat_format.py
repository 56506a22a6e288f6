r"""Chat formatting over reply trees.

Messages form trees (tree, msg, parent). Iterative self-joins enumerate root-to-leaf paths: each
round joins the table of jumps with itself and so doubles their length, so a tree of depth d takes
log2(d) rounds; trees whose messages have all met their root leave. Branches are ranked by the mean score along the path; the best `branches` leaves of a
tree are chosen, the jumps are walked back from these leaves only, and each chosen path is formatted
as one conversation.

Template: every turn is `<turn>role\ntext</turn>\n`. Inside roles and texts `\` is written `\\`, and
the `<` of `<turn` or `</turn` is written `\l`; a line end in a role is written `\n`. So no control
string is left inside, and `parse` gets back exactly what went in. The loss mask lists the code-point
spans of the assistant texts.

Defined results: a null role or text is empty; a null tree is one tree of its own; a null or unknown
parent makes a root; messages on a parent cycle have no root and are on no path; repeated (tree, msg)
keep one row, the first by role and text; turns of equal number are ordered by role and text, null being
empty there too; branches of equal score are ranked by message; an empty table gives an empty result. Only the
named columns are read, so further ones, whatever their names, do not clash. A text of any length is taken
whole; a conversation is one value, so the longest one must fit in memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import materialise, table

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("<turn"), F.lit("\\lturn"))
    return F.replace(text, F.lit("</turn"), F.lit("\\l/turn"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _undo(text: Column, letter: str, becomes: str) -> Column:
    # an odd number of backslashes before the letter: the last belongs to it
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\" + letter, "$1" + becomes)


def unescape(text: Column) -> Column:
    return F.replace(_undo(text, "l", "<"), F.lit("\\\\"), F.lit("\\"))


def unescape_role(role: Column) -> Column:
    return F.replace(_undo(_undo(role, "l", "<"), "n", "\n"), F.lit("\\\\"), F.lit("\\"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, rank, score, pos, msg): the messages of the chosen root-to-leaf paths, in order.

    messages has tree, msg, parent and score. Every round of either loop is one self-join on
    (tree, message); only chosen leaves are expanded, so the output is the only thing of the size of
    all paths together.
    """
    node = messages.select("tree", "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    up = node.join(node.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("known")), ["tree", "parent"], "left")
    # jump: the ancestor `steps` above, null beyond the root; total: scores of the nodes passed
    jump = up.select("tree", "msg", F.when(F.col("known"), F.col("parent")).alias("to"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    jump = materialise(jump, "jumps")
    levels, rooted = [jump], []
    most = node.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while (1 << (len(levels) - 1)) <= most:
        live = jump.filter("to is not null")
        trees = materialise(live.select("tree").distinct(), "trees")
        if trees.isEmpty():
            break
        rooted.append(jump.join(trees, "tree", "left_anti"))  # trees whose messages have all met their root
        state = jump.join(trees, "tree", "left_semi")
        right = state.select("tree", F.col("msg").alias("to"), F.col("to").alias("to2"), F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        moved = live.join(right, ["tree", "to"]).select(
            "tree", "msg", F.col("to2").alias("to"), (F.col("total") + F.col("total2")).alias("total"), (F.col("steps") + F.col("steps2")).alias("steps")
        )
        jump = materialise(moved.unionByName(state.filter("to is null")), "jumps")
        levels.append(jump)
    rooted = reduce(DataFrame.unionByName, rooted, jump.filter("to is null"))  # the rest is on or below a cycle
    leaf = rooted.join(up.filter("known").select("tree", F.col("parent").alias("msg")).distinct(), ["tree", "msg"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "msg")
    chosen = (
        leaf.select("tree", "msg", (F.col("total") / F.col("steps")).alias("score"), F.col("steps").alias("n"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= branches)
        .select("tree", F.col("msg").alias("branch"), "rank", "score", F.col("msg"), (F.col("n") - 1).alias("pos"))
    )
    members = chosen
    for k in range(len(levels) - 1, -1, -1):
        hop = levels[k].filter("to is not null").select("tree", "msg", "to")
        above = members.join(hop, ["tree", "msg"]).select("tree", "branch", "rank", "score", F.col("to").alias("msg"), (F.col("pos") - (1 << k)).alias("pos"))
        members = members.unionByName(above)
        if k % 3 == 0:
            members = materialise(members, "paths")
    return members


def format_paths(members: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per chosen path: tree, branch, rank, score, text and loss_spans."""
    turn = members.join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    line = turn.select(
        "tree", "branch", "rank", "score", "pos", (role == "assistant").alias("loss"), F.concat(F.lit(OPEN), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body")
    )
    path = Window.partitionBy("tree", "branch").orderBy("pos")
    line = line.withColumn("end", F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(path) - len(CLOSE))
    piece = F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("s"), "loss", (F.col("end") - F.length("body")).alias("start"), "end")
    return (
        line.groupBy("tree", "branch", "rank", "score")
        .agg(F.array_sort(F.collect_list(piece)).alias("p"))
        .select(
            "tree",
            "branch",
            "rank",
            "score",
            F.array_join(F.transform("p", lambda x: x["s"]), "").alias("text"),
            F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
        )
    )


def parse(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(text, "</turn>\n"), lambda x: x != "")

    def one(x: Column) -> Column:
        body = F.substr(x, F.lit(len(OPEN) + 1))
        at = F.instr(body, "\n")
        return F.struct(unescape_role(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + 1)).alias("text"))

    return F.transform(turns, one)


def masked(text: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")


def tree_key(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def linear_trees(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations of numbered rows as trees: each row replies to the row before it."""
    order = Window.partitionBy("tree").orderBy(turn, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    out = turns.select(tree_key(F.col(conv)).alias("tree"), turn, "role", "text").withColumn("msg", F.row_number().over(order).cast("long"))
    return out.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Chosen paths of reply trees (tree, msg, parent, role, text, score) as conversations."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    one = Window.partitionBy("tree", "msg").orderBy("role", "text", "parent", F.desc("score"))
    own = messages.select("tree", "msg", "parent", role, text, "score", F.row_number().over(one.orderBy(role, text, "parent", F.desc("score"))).alias("n"))
    messages = materialise(own.filter("n = 1").drop("n"), "messages")
    return format_paths(paths(messages, branches), messages)


PLANTED = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    chats = format_chats(linear_trees(turns.unionByName(planted)))
    read = chats.select("tree", "text", parse(F.col("text")).alias("turns"), masked(F.col("text"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        F.when(F.col("tree") != "null", F.substr("tree", F.lit(2))).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_chat_format": op1_chat_format}

ORACLE = {
    "op1_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
        e AS (
          SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\lturn'), '</turn', '\l/turn') AS body,
                 replace(replace(replace(replace(role, '\', '\\'), '<turn', '\lturn'), '</turn', '\l/turn'), chr(10), '\n') AS head
          FROM t)
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(head) + length(body) + 15) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id"""
}
