"""Operator 8: chat formatting over reply trees.

Messages form trees (node, parent).  Every root-to-leaf path is enumerated by
iterative self-joins with doubling steps: round k joins the covered (leaf,
ancestor) rows to the 2^k-th ancestor of each, so a tree of depth d takes
log2(d) joins.  Branches of a tree are ranked by score (the mean of their
messages' scores), and each chosen path is written as one conversation.

Template: each turn is ``<turn>role`` + newline + text + ``</turn>`` + newline.
Inside roles and texts a backslash is written ``\\s``, ``<`` is written ``\\l``
and, in roles, a newline ``\\n``; so no text can hold a control string, and
reading back is exact.  The loss mask holds the [start, end) code-point spans
of the escaped assistant texts in the formatted string.

Defined results: null roles and texts count as empty.  A message whose parent
is null or not in the table is a root.  ``messages_by_turn`` chains the rows of
a conversation by (turn, role, text), nulls first, so tied turns and repeated
rows follow each other and none is lost; null conversation ids form one
conversation.  Messages in a parent cycle have no root, hence no path.  An
empty table gives an empty result.  Other columns are not read.  A formatted
conversation is one string, so one row holds a whole conversation by
definition of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def messages_by_turn(rows: DataFrame) -> DataFrame:
    """Reply-tree messages (tree, node, parent, role, text, score) of linear conversations."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"),
        "role", "text", F.lit(0.0).alias("score")).withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path, ``up`` steps above its leaf."""
    links = save(messages.select(F.struct("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("p")))
    # The tree as a struct: a null tree id then joins like any other.
    known = links.select("t", F.col("n").alias("p"))
    step = save(links.join(known, ["t", "p"], "left_semi").select("t", "n", F.col("p").alias("a")))
    # Ancestors 1, 2, 4, ... steps up.  Within a parent cycle they never end, so
    # what still has one after more steps than there are messages has no root.
    steps, reach, most = [step], 1, links.count()
    while reach <= most and not steps[-1].isEmpty():
        ahead = steps[-1].select("t", F.col("n").alias("a"), F.col("a").alias("b"))
        steps.append(save(steps[-1].join(ahead, ["t", "a"]).select("t", "n", F.col("b").alias("a"))))
        reach *= 2
    covered = (links.join(step.select("t", F.col("a").alias("n")), ["t", "n"], "left_anti")
               .join(steps.pop().select("t", "n"), ["t", "n"], "left_anti")
               .select("t", F.col("n").alias("leaf"), "n", F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(steps):
        more = covered.join(jump, ["t", "n"]).select("t", "leaf", F.col("a").alias("n"), (F.col("up") + (1 << k)).alias("up"))
        covered = save(covered.unionByName(more))
    return covered.select("t.tree", "leaf", F.col("n").alias("node"), "up")


def format_branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, formatted, mask): the ``top`` branches of each tree (all if None)."""
    body = messages.select(
        F.struct("tree").alias("t"), F.col("node"), F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce("score", F.lit(0.0)).alias("score"))
    on_path = paths(messages).select(F.struct("tree").alias("t"), "leaf", "node", "up").join(body, ["t", "node"])
    if top is not None:
        scored = on_path.groupBy("t", "leaf").agg(F.avg("score").alias("s"))
        best = Window.partitionBy("t").orderBy(F.desc("s"), "leaf")
        chosen = scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).select("t", "leaf")
        on_path = on_path.join(chosen, ["t", "leaf"], "left_semi")
    # Where each turn's text ends in the formatted string: a running sum over the
    # path, which becomes one row in the end anyway.
    upto = Window.partitionBy("t", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("head") + F.char_length("body") + len(CLOSE)
    placed = on_path.withColumn("end", F.sum(length.cast("long")).over(upto) - len(CLOSE)).withColumn(
        "start", F.col("end") - F.char_length("body"))
    turn = F.struct((-F.col("up")).alias("place"), "role", "head", "body", "start", "end")
    grouped = placed.groupBy("t", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.avg("score").alias("score"))
    said = F.filter("turns", lambda x: x["role"] == "assistant")
    made = grouped.select("t", "leaf", "score", F.concat_ws("", F.transform(
        "turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))).alias("formatted"), F.transform(
            said, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("mask"))
    ranked = Window.partitionBy("t").orderBy(F.desc("score"), "leaf")
    return made.select("t.tree", "leaf", F.row_number().over(ranked).alias("rank"), "score", "formatted", "mask")


def read_back(formatted: str = "formatted") -> Column:
    """array<struct<role,text>> parsed from a formatted conversation."""
    parts = F.filter(F.split(F.col(formatted), F.lit("</turn>\n")), lambda x: x != "")

    def turn(x):
        inner = F.substr(x, F.lit(len(OPEN) + 1))
        cut = F.instr(inner, "\n")
        return F.struct(unescape_role(F.substr(inner, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substr(inner, cut + 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: str = "formatted", mask: str = "mask", some: int = 256) -> Column:
    """The text under the loss mask, unescaped.  Spans are cut from stretches of
    ``some`` spans, as a cut from the whole string walks through all before it."""
    def cut(text, start, end):
        return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))

    def stretch(at):
        spans = F.slice(F.col(mask), at, F.lit(some))
        first, last = F.get(spans, F.lit(0))["start"], F.element_at(spans, -1)["end"]
        return F.struct(spans.alias("spans"), first.alias("first"), cut(F.col(formatted), first, last).alias("text"))

    starts = F.when(F.size(mask) > 0, F.sequence(F.lit(1), F.size(mask), F.lit(some))).otherwise(F.array().cast("array<int>"))
    return F.concat_ws("", F.transform(F.transform(starts, stretch), lambda x: F.concat_ws("", F.transform(
        x["spans"], lambda m: unescape(cut(x["text"], m["start"] - x["first"], m["end"] - x["first"]))))))


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role) + length(text) + 15
           + length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))
           + length(role) - length(replace(role, chr(10), '')))::bigint as formatted_chars
from c group by conv_id
"""
