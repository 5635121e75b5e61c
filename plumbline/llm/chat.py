"""Chat formatting by event-sourced reconstruction, in column expressions.

A log holds one row per event: conv_id, turn, copy (tells apart messages of the same turn), seq (one sequence
for the whole conversation), kind, role, text. ``delta`` appends to its message, ``edit`` replaces what the message
said so far, at any later time, and leaves the turns after it alone; ``regenerate`` throws away what the message said
and withdraws every later message said until then, since it answered a text that is gone. Events are partitioned by
conversation, sorted by sequence and folded in windows; only the rendered result is one value per conversation.

The template writes a turn as ``### role``, a line break, the text and ``</turn>`` with a line break.
Inside roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h`` (and a
line break in a role ``\\n``), so no mark of the template can occur in them, and the original comes back by
undoing the three in reverse.

Corner cases: null texts and roles are empty; messages of one turn stand in the order of role, then
text; a repeated row is a message of its own; conversations with a null conv_id form one
conversation; events of equal seq stand in the order of turn, copy, kind, role, text; a message all of whose
events are withdrawn is gone; other columns are left out; an empty log gives no rows. One rendered conversation has to fit a string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, copy, role, text): the events that no later one withdrew, joined in sequence."""
    said = (F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.select("conv_id", "turn", "copy", "seq", "kind", *said)
    place, order = F.struct("turn", "copy"), ("seq", "turn", "copy", "kind", "role", "text")
    later = Window.partitionBy("conv_id").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    earliest = F.min(F.when(F.col("kind") == "regenerate", place)).over(later)
    log = log.withColumn("withdrawn", F.coalesce(earliest < place, F.lit(False))).where(~F.col("withdrawn"))
    event = F.struct("seq", F.col("kind").isin("edit", "regenerate").alias("reset"), "kind", "role", "text")
    grouped = log.groupBy("conv_id", "turn", "copy").agg(F.array_sort(F.collect_list(event)).alias("log"))
    since = F.array_max(F.transform("log", lambda e, i: F.when(e["reset"], i).otherwise(0)))
    live = F.filter("log", lambda e, i: i >= F.col("since"))
    text = F.array_join(F.transform(live, lambda e: e["text"]), "")
    return grouped.withColumn("since", since).select("conv_id", "turn", "copy", F.element_at("log", -1)["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: [turn number, start, end in formatted, start in the turn] of every learned text, escaped as it stands there."""
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = messages.select("conv_id", "turn", "copy", "role", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("chars", (F.length("head") + F.length("body") + len(CLOSE)).cast("bigint"))
    order = Window.partitionBy("conv_id").orderBy("turn", "copy")
    turns = turns.withColumn("number", F.row_number().over(order) - 1)
    turns = turns.withColumn("at", F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("at") + F.length("head")
    span = F.struct(F.col("number").alias("turn"), start.alias("start"), (start + F.length("body")).alias("end"), F.length("head").alias("skip"))
    row = F.struct("number", F.concat("head", "body", F.lit(CLOSE)).alias("text"), F.when(F.col("role") == learned, span).alias("loss"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as [role, text], unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = piece.substr(F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(inner, "\n", 1)
        text = inner.substr(F.length(role) + 2, F.length(inner))
        return F.struct(unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """Everything under the loss mask, unescaped, in order."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.get(
        F.transform(
            F.array(pieces),
            lambda p: F.array_join(
                F.transform(loss_spans, lambda s: unescape(p[s["turn"]].substr(s["skip"] + 1, (s["end"] - s["start"]).cast("int")))), ""
            ),
        ),
        F.lit(0),
    )


def as_events(rows: DataFrame) -> DataFrame:
    """An event log that ends in these rows.

    Assistant texts arrive in two deltas after a first try that was answered and then regenerated, which withdraws try and
    answer; all other texts are begun in their turn and edited to their final form after the last turn.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    parts = (text.substr(F.lit(1), half), text.substr(half + 1, F.length(text)))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    steps, after_all = 8, 1 << 40

    def event(seq: Column, kind: str, value: Column, copy: Column | None = None) -> Column:
        own = F.col("number") if copy is None else copy
        return F.struct(seq.alias("seq"), own.alias("copy"), F.lit(kind).alias("kind"), value.alias("text"))

    at = lambda k: F.col("number") * steps + k
    again = F.array(
        event(at(0), "delta", parts[0]),
        event(at(1), "delta", F.lit("..."), F.lit(after_all)),
        event(at(2), "regenerate", F.lit("")),
        event(at(3), "delta", parts[0]),
        event(at(4), "delta", parts[1]),
    )
    begun = F.array(event(at(0), "delta", parts[0]), event(F.col("number") + after_all, "edit", text))
    log = F.when(F.col("role") == "assistant", again).otherwise(begun)
    out = rows.withColumn("number", number).select("conv_id", "turn", "role", F.explode(log).alias("e"))
    return out.select("conv_id", "turn", "e.copy", "role", "e.seq", "e.kind", "e.text")
