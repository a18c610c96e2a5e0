"""Chat formatting in budgeted windows; DataFrame functions only.

Turns stand in the order of turn (null first), role, text. Prefix sums of turn tokens cut a conversation into spans of
whole turns: turns that lie inside one step of the budget form a span, a turn that crosses steps is a span of its own, so
a span is never longer than a step unless it is a single longer turn. Each span becomes one window: the system turn,
then as much history before the span as ``HISTORY`` tokens allow, then the span's new turns. Only assistant turns among
the new ones are under the loss mask, so every assistant text is learned from exactly once.

Template: ``<|window|>`` turns ``<|now|>`` turns, a turn being ``<|turn|>`` role, ``<|text|>`` or ``<|loss|>``, text, ``<|end|>``.
Roles and texts are escaped: a ``~`` goes in after each ``<`` that a ``|`` or ``~`` follows, so no text holds a control
string and ``unescaped`` undoes it exactly.

* Null roles and texts are empty; a null conv_id is one conversation. Repeated rows are turns of their own. The first
  turn whose role is ``system`` is the system turn. An empty table gives no windows. Other columns are not looked at.
* A conversation's spans are built from window functions over (conv_id); its turns then meet by (conv_id, window), so no row
  holds more than one window. Only the digests of ``read_back`` hold a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
CHARS_PER_TOKEN = 4
WINDOW, NOW, TURN, TEXT, LOSS, END = "<|window|>", "<|now|>", "<|turn|>", "<|text|>", "<|loss|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<([|~])", "<~$1")


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<~"), F.lit("<"))


def _literal(mark: str) -> str:
    return mark.replace("|", "\\|")


def turns_in_order(turns: DataFrame) -> DataFrame:
    """Every turn with its place, tokens, prefix sums and the step its conversation is cut by."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", 1 + F.ceil(F.length("text") / CHARS_PER_TOKEN))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("idx", F.count("*").over(order)).withColumn("after", F.sum("tokens").over(order))
    rows = rows.withColumn("before", F.col("after") - F.col("tokens"))
    every = Window.partitionBy("conv_id")
    system = F.min(F.when(F.col("role") == "system", F.struct("idx", "tokens"))).over(every)
    rows = rows.withColumn("system", system)
    spare = BUDGET - HISTORY - F.coalesce("system.tokens", F.lit(0))
    return rows.withColumn("step", F.greatest(spare, F.lit(BUDGET // 4)))


def windows(turns: DataFrame) -> DataFrame:
    """conv_id, number of the window, formatted text."""
    rows = turns_in_order(turns)
    place = Window.partitionBy("conv_id").orderBy("before")
    rows = rows.withColumn("span", F.struct(F.floor(F.col("before") / F.col("step")), F.floor((F.col("after") - 1) / F.col("step"))))
    rows = rows.withColumn("starts", ~F.col("span").eqNullSafe(F.lag("span").over(place)))
    rows = rows.withColumn("from", F.min("idx").over(place.rangeBetween(-HISTORY, 0)))
    rows = rows.withColumn("window", F.sum(F.col("starts").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    # Windows that begin up to HISTORY tokens after the turn's own beginning; spans are about a step long, so these are few.
    rows = rows.withColumn("later", F.collect_list(F.when(F.col("starts"), F.col("window"))).over(place.rangeBetween(1, HISTORY)))
    head = F.concat(F.lit(TURN), escaped(F.col("role")))
    tail = F.concat(escaped(F.col("text")), F.lit(END))
    new = F.when(F.col("role") == "assistant", F.lit(LOSS)).otherwise(F.lit(TEXT))
    rows = rows.withColumn("past", F.concat(head, F.lit(TEXT), tail))
    system = F.min(F.when(F.col("role") == "system", F.struct("idx", "past"))).over(Window.partitionBy("conv_id"))
    rows = rows.withColumn("system", F.when(F.col("starts") & (F.col("system.idx") < F.col("from")), system))
    piece = lambda window, now, idx, text: F.struct(window.alias("window"), F.struct(F.lit(now).alias("now"), idx.alias("idx"), text.alias("text")).alias("p"))
    own = piece(F.col("window"), True, F.col("idx"), F.concat(head, new, tail))
    first = piece(F.col("window"), False, F.col("system.idx"), F.col("system.past"))
    history = F.transform("later", lambda w: piece(w, False, F.col("idx"), F.col("past")))
    pieces = F.concat(F.array(own), F.filter(F.array(first), lambda p: p["p"]["text"].isNotNull()), history)
    made = rows.select("conv_id", F.inline(pieces)).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    side = lambda now: F.array_join(F.transform(F.filter("ps", lambda p: p["now"] == F.lit(now)), lambda p: p["text"]), "")
    return made.select("conv_id", "window", F.concat(F.lit(WINDOW), side(False), F.lit(NOW), side(True)).alias("formatted"))


def new_turns(formatted: Column) -> Column:
    """The turns that a window is the first to hold, read back from its text: role, text, loss."""
    body = F.substring_index(formatted, NOW, -1)
    pieces = F.filter(F.split(body, _literal(END)), lambda p: p != "")

    def read(piece: Column) -> Column:
        parts = F.split(F.substring(piece, len(TURN) + 1, 2**31 - 1), "<\\|(?:text|loss)\\|>", 2)
        return F.struct(unescaped(parts[0]).alias("role"), unescaped(parts[1]).alias("text"), F.contains(piece, F.lit(LOSS)).alias("loss"))

    return F.transform(pieces, read)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its windows: digests of all turns and of all text under the loss mask."""
    rows = formatted.select("conv_id", F.struct("window", new_turns(F.col("formatted")).alias("turns")).alias("w"), F.length("formatted").alias("chars"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    convs = convs.withColumn("turns", F.flatten(F.transform("ws", lambda w: w["turns"])))
    convs = convs.withColumn("loss", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
