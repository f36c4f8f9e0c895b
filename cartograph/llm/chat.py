"""Chat formatting (operator 12), with DataFrame functions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role are merged into a block, and blocks are written one after the other:

    <s>[SYS]text[/SYS][INST]text[/INST]text</s>[INST]text[NEXT]text[/INST]...

System and user blocks stand between marks, an assistant's block ends with
``</s>``, and a block of any other role is ``[ROLE]role[TURN]text[/ROLE]``.
``[NEXT]`` parts the merged turns of a block.

A mark inside a text gets a backslash after its first character, and one that
has backslashes there already gets one more, so escaping is undone by taking one
away, and no text holds a mark.  No mark has its first character anywhere else,
so none arises where a text meets a mark.

The loss mask is a list of spans, one for each assistant turn, in bytes of the
UTF-8 text, so that a long text is read back span by span without a walk over
all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, NAMED = "<s>", "[NEXT]", "[TURN]"
#: Marks before and after a block, by role.
AROUND = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
#: What follows a mark's first character.
_REST = r"(s>|/s>|/?SYS\]|/?INST\]|/?ROLE\]|NEXT\]|TURN\])"
_FIRST = r"([<\[])"
#: Numbers that are added up one after the other; longer lists go by chunks of so many.
CHUNK = 1024


def escaped(text: Column) -> Column:
    """text with a backslash put into each mark."""
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _REST, "$1$2$3")


def before(role: Column) -> Column:
    """What opens a block of a role (escaped)."""
    known = F.when(role == "system", AROUND["system"][0]).when(role == "user", AROUND["user"][0]).when(role == "assistant", AROUND["assistant"][0])
    return known.otherwise(F.concat(F.lit(OTHER[0]), role, F.lit(NAMED)))


def after(role: Column) -> Column:
    return F.when(role == "system", AROUND["system"][1]).when(role == "user", AROUND["user"][1]).when(role == "assistant", AROUND["assistant"][1]).otherwise(OTHER[1])


def upto(numbers: Column) -> Column:
    """Sums of an array's numbers up to and with each, in two levels: an accumulated array is copied at each step, so none grows long."""

    def added(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all"))
        return F.aggregate(xs, start, step, lambda acc: acc["all"])

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(numbers)), F.lit(CHUNK)), lambda k: k <= F.size(numbers))
    chunks = F.transform(starts, lambda k: added(F.slice(numbers, k, F.lit(CHUNK))))
    totals = F.transform(chunks, lambda c: F.element_at(c, -1))
    # each chunk begins where the chunks before it end
    firsts = F.slice(F.concat(F.array(F.lit(0).cast("long")), added(totals)), F.lit(1), F.size(totals))
    return F.flatten(F.zip_with(chunks, firsts, lambda c, first: F.transform(c, lambda x: x + first)))


def collected(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (structs in order, roles and texts escaped): rows that name no conversation are one each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(turn.isNull().alias("last"), turn.alias("turn"), escaped(role).alias("role"), escaped(text).alias("text")).alias("t"))
    named = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return named.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_blocks, text, loss_spans (array of begin and end, bytes of the text) of every conversation.

    Turns are in the order of turn (null last), ties by role and text; repeated
    rows are turns of their own.  A null text or role is empty; a role other than
    system, user and assistant is written by name.  A row without conv_id is a
    conversation of its own.  A conversation is one value, so it can't go beyond
    2 GB.  Other columns are ignored; an empty table has no conversations.
    """
    rows = collected(conversations)
    turns = F.col("turns")
    role = lambda k: F.element_at(turns, k)["role"]
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size(turns)), lambda k: (k == 1) | (role(F.greatest(k - 1, F.lit(1))) != role(k))))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size(turns) + 1))
    run = lambda a, b: F.struct(role(a).alias("role"), F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts"))
    rows = rows.withColumn("blocks", F.zip_with("starts", ends, run))
    written = F.transform("blocks", lambda b: F.concat(before(b["role"]), F.array_join(b["texts"], NEXT), after(b["role"])))
    # of each turn: bytes up to its text, bytes of the text; what closes a block counts with the next turn
    sizes = lambda b: F.transform(b["texts"], lambda t, k: F.struct(F.when(k == 0, F.octet_length(before(b["role"]))).otherwise(len(NEXT)).alias("gap"), F.octet_length(t).alias("size"), (b["role"] == "assistant").alias("loss")))
    close = lambda b: F.struct(F.octet_length(after(b["role"])).alias("gap"), F.lit(0).alias("size"), F.lit(False).alias("loss"))
    rows = rows.withColumn("parts", F.flatten(F.transform("blocks", lambda b: F.concat(sizes(b), F.array(close(b))))))
    rows = rows.withColumn("ends", upto(F.transform("parts", lambda p: (p["gap"] + p["size"]).cast("long"))))
    span = lambda p, e: F.struct((e - p["size"] + len(START)).alias("begin"), (e + len(START)).alias("end"), p["loss"].alias("loss"))
    masked = F.filter(F.zip_with("parts", "ends", span), lambda s: s["loss"])
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        F.concat(F.lit(START), F.array_join(written, "")).alias("text"),
        F.transform(masked, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """chats (text, loss_spans) with turns (array of role and text) and loss (array of texts), read from the formatted text alone."""
    body = F.substring(F.col("text"), F.lit(len(START) + 1), F.length("text"))
    blocks = F.filter(F.split(body, r"(?<=\[/INST\]|\[/SYS\]|\[/ROLE\]|</s>)"), lambda b: b != "")

    def inner(b: Column, marks: tuple[str, str]) -> Column:
        return F.substring(b, F.lit(len(marks[0]) + 1), F.length(b) - sum(map(len, marks)))

    def parsed(b: Column) -> Column:
        other = inner(b, OTHER)
        named = F.struct(F.substring_index(other, NAMED, 1).alias("role"), F.substring(other, F.length(F.substring_index(other, NAMED, 1)) + len(NAMED) + 1, F.length(other)).alias("text"))
        known = [(F.endswith(b, F.lit(marks[1])), F.struct(F.lit(r).alias("role"), inner(b, marks).alias("text"))) for r, marks in AROUND.items()]
        return F.when(*known[0]).when(*known[1]).when(*known[2]).otherwise(named)

    turns = lambda b: F.transform(F.split(b["text"], r"\[NEXT\]"), lambda t: F.struct(unescaped(b["role"]).alias("role"), unescaped(t).alias("text")))
    taken = lambda s: F.decode(F.substring(F.col("bytes"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")), "UTF-8")
    rows = chats.withColumn("blocks", F.transform(blocks, parsed)).withColumn("bytes", F.encode("text", "UTF-8"))
    rows = rows.withColumn("turns", F.flatten(F.transform("blocks", turns)))
    return rows.withColumn("loss", F.transform("loss_spans", lambda s: unescaped(taken(s)))).drop("blocks", "bytes")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, as read back from formatted conversations."""
    rows = read_back(chats.select("conv_id", "text", "loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "text", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("loss", "").alias("learnt"))
    return rows.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


def with_marks_inside(conversations: DataFrame) -> DataFrame:
    """conversations with number -7 added: two turns that say marks."""
    turn = lambda k, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    more = conversations.sparkSession.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(more)
