"""Chat formatting of reply trees.

Messages point to the message that they answer. Iterative self-joins double the length of the jumps up the tree until no
jump stays inside it, which takes log2(depth) rounds; jumps that outlive log2(messages) rounds go round a cycle. Then
with each length, from the longest, every path found so far grows twofold, and all root-to-leaf paths are there.
A path's score is the sum of its messages' scores; the best paths of each tree are chosen and formatted, each as one
conversation. The template marks turns with control strings; inside roles and texts the characters that such strings
are made of are written as two-character codes, so a text can't forge a turn and reading back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevec.llm.common import drop_paths, written

#: Control strings of the template, and the codes of the characters that they are made of.
OPEN, HEAD, END = "<|", "|>\n", "<|end|>\n"
CODES = {"\\": "\\b", "<": "\\l", "[": "\\s", "|": "\\p"}


@dataclass(frozen=True)
class ChatParams:
    """best: paths taken from each tree, by score, ties by leaf (None: all); trained: roles whose texts are learned."""

    best: int | None = None
    trained: tuple[str, ...] = ("assistant",)


def escaped(text: Column) -> Column:
    for char, code in CODES.items():
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in reversed(CODES.items()):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def reply_paths(messages: DataFrame, params: ChatParams = ChatParams(), paths: list[str] | None = None) -> DataFrame:
    """(leaf, node, up, root, path_score): a row for each message of each chosen path, up counting from the leaf.

    messages: msg_id (unique), parent_id, score. A message whose parent is null or missing is a root. Null scores count
    as 0. A cycle of replies raises a ValueError before any path grows.
    """
    own: list[str] = []
    keep = own if paths is None else paths
    nodes = messages.select("msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("msg_id").alias("parent_id"))
    jumps = nodes.where("parent_id is not null").join(known, "parent_id", "left_semi").select(F.col("msg_id").alias("node"), F.col("parent_id").alias("to"))
    rounds = [written(jumps, "jumps", keep)]  # rounds[k]: jumps over 2**k messages
    most = rounds[0].count().bit_length()
    while not rounds[-1].isEmpty():
        if len(rounds) > most:  # a way of 2**most messages has one of them twice
            drop_paths(messages.sparkSession, keep)
            raise ValueError("the replies form a cycle")
        on = rounds[-1].select(F.col("node").alias("to"), F.col("to").alias("next"))
        rounds.append(written(rounds[-1].join(on, "to").select("node", F.col("next").alias("to")), "jumps", keep))
    leaves = nodes.join(rounds[0].select(F.col("to").alias("msg_id")).distinct(), "msg_id", "left_anti")
    found = leaves.select(F.col("msg_id").alias("leaf"), F.col("msg_id").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in reversed(list(enumerate(rounds[:-1]))):
        higher = found.join(jump, "node").select("leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        found = written(found.unionByName(higher), "paths", keep)
    scored = found.join(nodes.select(F.col("msg_id").alias("node"), "score"), "node")
    summary = scored.groupBy("leaf").agg(F.sum("score").alias("path_score"), F.max_by("node", "up").alias("root"))
    if params.best is not None:
        ranked = summary.withColumn("rank", F.row_number().over(W.partitionBy("root").orderBy(F.desc("path_score"), "leaf")))
        summary = ranked.where(F.col("rank") <= params.best).drop("rank")
    return found.join(summary, "leaf")


def formatted(turns: Column, params: ChatParams) -> tuple[Column, Column]:
    """The text of a conversation and its loss mask, from an array of structs (role, text) in order.

    The mask is an array of structs (start, end), code points, end exclusive: one for each trained text.
    """
    one = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(HEAD), escaped(t["text"]), F.lit(END))
    text = F.array_join(F.transform(turns, one), "")
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(escaped(t["role"])) + len(OPEN) + len(HEAD)
        end = start + F.length(escaped(t["text"]))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        trained = t["role"].isin(*params.trained)
        return F.struct((end + len(END)).alias("at"), F.when(trained, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return text, F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda a: a["spans"])


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation: an array of structs (role, text)."""
    parts = F.filter(F.split(text, r"<\|end\|>\n", -1), lambda x: x != "")
    cut = F.lit(HEAD)
    head = lambda x: F.substring_index(x, HEAD, 1)
    role = lambda x: unescaped(F.substring(head(x), F.lit(len(OPEN) + 1), F.length(x)))
    rest = lambda x: unescaped(F.substring(x, F.length(head(x)) + F.length(cut) + 1, F.length(x)))
    return F.transform(parts, lambda x: F.struct(role(x).alias("role"), rest(x).alias("text")))


def chats(messages: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """(leaf, root, path_score, conversation, mask) of every chosen path.

    messages: msg_id, parent_id, role, text, score; further columns are ignored. Null roles and texts count as empty.
    """
    paths: list[str] = []
    chosen = reply_paths(messages, params, paths)
    said = messages.select(F.col("msg_id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = chosen.join(said, "node").groupBy("leaf").agg(F.first("root").alias("root"), F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "role", "text"))).alias("turns"))
    text, mask = formatted(F.col("turns"), params)
    out = written(grouped.select("leaf", "root", "path_score", text.alias("conversation"), mask.alias("mask")), "chats")
    drop_paths(messages.sparkSession, paths)
    return out


def linear(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as messages: each row answers the one before it.

    Rows are in order of turn, then role, then text, nulls first; repeated rows are turns of their own. A null conv_id
    is a conversation like any other.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_n", F.row_number().over(order))
    key = lambda n: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("/"), n.cast("string"))
    return rows.select("conv_id", key(F.col("_n")).alias("msg_id"), F.when(F.col("_n") > 1, key(F.col("_n") - 1)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted_chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all taken from conversation and mask;
    conv_id is the part of the leaf's key before the stroke."""
    turns = parsed(F.col("conversation"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("conversation"), m["start"] + 1, m["end"] - m["start"]))), "")
    conv = F.substring_index("leaf", "/", 1)
    return formatted_chats.select(
        F.when(conv != "null", conv.cast("string")).cast("long").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"),
    )
