"""Conversations as one training text each, with a loss mask, by Spark expressions only.

Template: every run of turns of one role is a block

    <|im_start|>ROLE newline TEXT (<|im_sep|>TEXT)* <|im_end|> newline

A conversation's turns are collected as structs and sorted as an array. Runs of one role are merged in
that array: a run begins where the turn before has another role, and the turns from there to the next
beginning are one slice. All sums over turns go by blocks, so that long conversations take linear time.

Inside texts a backslash goes between < and | wherever they stand together, after those that are
there already, so that no text holds a control string and every text can be read back. Roles
write % < and newline as %25 %3C and %0A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import cut, let, pieces, sums_before

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ANSWERS = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for c, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(c), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for c, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(c))
    return role


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of each conversation of turns (conv_id, turn, role, text).

    loss holds structs (start, end) of code points in formatted, end exclusive: the escaped texts of
    assistant turns in order. Turns come by turn, nulls first; rows that share a turn by role and
    text; repeated rows stay. Null roles and texts count as empty, null conv_ids as one conversation.
    Other columns are ignored; an empty table gives an empty result. One conversation is one row, so
    its turns meet in one task; texts of different conversations never do.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct("turn", said("role").alias("role"), said("text").alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("p"))
    opens = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i)["role"] != F.get("p", i - 1)["role"]))
    runs = sorted_.withColumn("opens", opens).select("conv_id", F.transform("opens", lambda s, j: _run(s, F.coalesce(F.get("opens", j + 1), F.size("p")))).alias("runs"))
    placed = runs.withColumn("at", sums_before(F.transform("runs", lambda r: F.length(r["head"]) + F.aggregate(r["texts"], F.lit(0), lambda a, x: a + F.length(x) + len(SEP)) - len(SEP) + len(END))))
    block = lambda r: F.concat(r["head"], F.array_join(r["texts"], SEP), F.lit(END))
    answers = F.transform("runs", lambda r, i: F.when(r["role"] == ANSWERS, _places(r["texts"], F.get("at", i) + F.length(r["head"]))).otherwise(F.expr("cast(array() as array<struct<start:long,end:long>>)")))
    return placed.select("conv_id", F.array_join(F.transform("runs", block), "").alias("formatted"), F.flatten(answers).alias("loss"))


def _run(start: Column, end: Column) -> Column:
    """The turns start to end (exclusive) of the sorted array p, merged."""
    role = F.get("p", start)["role"]
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    texts = F.transform(F.slice("p", start + 1, end - start), lambda x: escape(x["text"]))
    return F.struct(role.alias("role"), head.alias("head"), texts.alias("texts"))


def _places(texts: Column, first: Column) -> Column:
    """Where the texts of a run stand, the first one at `first`."""
    before = sums_before(F.transform(texts, lambda x: F.length(x) + len(SEP)))
    return let(before, lambda b: F.transform(texts, lambda x, k: F.struct((first + F.get(b, k)).alias("start"), (first + F.get(b, k) + F.length(x)).alias("end"))))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda text: F.struct(unescape_role(head).alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return let(pieces(formatted), lambda parts: F.array_join(F.transform(loss, lambda s: unescape(cut(parts, s["start"], s["end"]))), ""))
