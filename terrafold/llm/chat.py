"""Chat formatting: render, reparse with a deterministic parser, escape until the turns come back. DataFrame functions only.

Grammar of the rendered text::

    conversation := turn*
    turn         := "### " role ": " text "</turn>" newline

In a role or a text a backslash code stands for a character: ``\\h`` for ``#``, ``\\l`` for ``<``, ``\\c`` for ``:``,
``\\s`` for the backslash. The parser cuts at every ``</turn>``, refuses a turn that holds a
second ``### ``, and always decodes. Whatever a text says, once it is escaped it holds no control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MARK, STOP = "### ", ": ", "</turn>"
CODES = (("#", "\\h"), ("<", "\\l"), (":", "\\c"))
SELF = ("\\", "\\s")
TURNS = "array<struct<role:string,text:string>>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(SELF[0]), F.lit(SELF[1]))
    for plain, code in CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def decode(c: Column) -> Column:
    """The backslash's own code comes last: every backslash of an escaped text begins a code, so none is made up."""
    for plain, code in (*reversed(CODES), SELF):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def chunk(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role), F.lit(MARK), body, F.lit(STOP + "\n"))


def segment(piece: Column) -> Column:
    """Role and text of what stands before a ``</turn>``; nulls where the grammar doesn't fit."""
    inner = F.substring(piece, F.lit(len(HEAD) + 1), F.length(piece))
    at = F.instr(inner, MARK)
    fits = F.startswith(piece, F.lit(HEAD)) & (at > 0) & ~F.contains(inner, F.lit(HEAD))
    role = F.substring(inner, F.lit(1), at - 1)
    body = F.substring(inner, at + len(MARK), F.length(inner))
    return F.struct(F.when(fits, decode(role)).alias("role"), F.when(fits, decode(body)).alias("text"), F.when(fits, at + len(HEAD) + len(MARK) - 1).alias("skip"), F.when(fits, F.length(body)).alias("chars"))


def parse(formatted: Column) -> Column:
    """The parser: an array of ``(role, text, skip, chars)``, the last two telling where the text stands in its turn."""
    cut = F.split(formatted, STOP)
    pieces = F.slice(cut, F.lit(1), F.size(cut) - 1)
    after = lambda p, i: F.when((i > 0) & F.startswith(p, F.lit("\n")), F.substring(p, F.lit(2), F.length(p))).otherwise(p)
    return F.transform(F.transform(pieces, after), segment)


def same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"], t["text"])).cast(TURNS).eqNullSafe(turns)


def rendered(turns: Column, body) -> Column:
    return F.array_join(F.transform(turns, lambda t: chunk(t["role"], body(t))), "")


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, parsed, loss, level, identical)`` per conversation.

    Level 0 renders every text as it is. Where the reparsed turns aren't the source's, level 1
    escapes the turns that don't come back alone, and level 2, if ever needed, all of them; ``identical`` tells
    that the last parse gave the source. ``parsed`` is what the parser read from ``formatted``; ``loss``
    marks the spans to learn, ``(turn, skip, chars)``: in that turn's segment, ``chars`` code points after ``skip``.

    A conversation's turns must meet in one row, as its text does; they move once, and Spark gathers
    them per task before. Cases: a null role or text is empty; a null conversation id is one more
    conversation; turns are ordered by turn (null first), then role, then text, so ties and repeated rows, which are all kept, have one
    order; an empty table gives no conversation; other columns are ignored.
    """
    given = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = rows.select(F.col(conv_id).alias("conv_id"), given.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    raw = rendered(F.col("turns"), lambda t: t["text"])
    convs = convs.withColumn("formatted", raw).withColumn("parsed", parse(F.col("formatted"))).withColumn("level", F.when(same(F.col("parsed"), F.col("turns")), 0))

    alone = lambda t: same(parse(chunk(t["role"], t["text"])), F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    some = rendered(F.col("turns"), lambda t: F.when(alone(t), t["text"]).otherwise(escape(t["text"])))
    every = rendered(F.col("turns"), lambda t: escape(t["text"]))
    for level, again in ((1, some), (2, every)):
        open_ = F.col("level").isNull()
        convs = convs.withColumn("formatted", F.when(open_, again).otherwise(F.col("formatted")))
        convs = convs.withColumn("parsed", F.when(open_, parse(F.col("formatted"))).otherwise(F.col("parsed")))
        convs = convs.withColumn("level", F.when(open_, F.when(same(F.col("parsed"), F.col("turns")), level)).otherwise(F.col("level")))
    numbered = F.transform("parsed", lambda t, i: F.struct(i.alias("turn"), t["skip"].alias("skip"), t["chars"].alias("chars"), t["role"].alias("role")))
    loss = F.transform(F.filter(numbered, lambda t: t["role"] == loss_role), lambda t: F.struct(t["turn"].alias("turn"), t["skip"].alias("skip"), t["chars"].alias("chars")))
    return convs.select("conv_id", "formatted", "parsed", loss.alias("loss"), "level", F.col("level").isNotNull().alias("identical"))


def chat_report(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The digest of :func:`format_chats`, read back from its output: turns from the parse, loss text
    cut from ``formatted`` by the mask and decoded."""
    done = format_chats(rows, loss_role=loss_role)
    segments = F.split("formatted", STOP + "\n")
    marked = lambda m: decode(F.substring(F.get(F.col("segments"), m["turn"]), m["skip"] + 1, m["chars"]))
    done = done.withColumn("segments", segments).withColumn("learnt", F.array_join(F.transform("loss", marked), ""))
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("level").alias("escape_level"),
        "identical",
    )
