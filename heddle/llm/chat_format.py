"""Chat formatting in budgeted windows, with DataFrame functions alone.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Each window opens with the system turn, then repeats a limited
history from the span before, then its own turns. The loss mask covers the text of its own assistant turns: each once over all windows.
Text is escaped so that no control string can stand in it, and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Every control string, of this template and of usual others, begins with one of these.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse: the escape character itself comes last, so that no code is made on the way."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """(conv_id, window, formatted, n_context, loss, tokens) a window.

    formatted is the window's text, n_context how many turns at its start are repeated, loss the array of (start, length) in code points.
    A turn's tokens are estimated at a quarter of its formatted code points. A window takes at most `budget` tokens, but a turn larger than
    that leaves to own turns stands alone with its context, whole. A turn of over half of it opens a window and shares it with the turns
    that follow as far as they fit. Turns go by (turn, role, text); nulls first; repeated turns all stay. Null
    text and role are empty; a null conv_id is a conversation of its own. A first turn of role system is the system turn. Empty tables
    give empty ones; other columns are ignored.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("body", escape(F.col("text"))).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    t = t.withColumn("part", F.concat("head", "body", F.lit(END))).withColumn("size", F.ceil(F.length("part") / 4))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    t = t.withColumn("seq", F.row_number().over(order)).withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    system = F.first(F.when((F.col("seq") == 1) & (F.col("role") == "system"), F.struct("part", "size"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("system", system).withColumn("own", F.lit(budget - history) - F.coalesce("system.size", F.lit(0))).withColumn("large", F.col("size") * 2 > F.col("own"))
    # A large turn opens a stretch, the rest of which is smaller turns; each stretch is cut by its own prefix sums.
    t = t.withColumn("stretch", F.sum(F.col("large").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy("conv_id", "stretch")
    t = t.withColumn("reach", F.sum("size").over(stretch.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.greatest("own", F.max(F.when(F.col("large"), F.col("size"))).over(stretch))
    room = F.greatest(F.col("own") - F.max(F.when(~F.col("large"), F.col("size"))).over(stretch), F.lit(1))
    # What fits with the stretch's first turn is its first window. After it turns end in the same span of `room` tokens: with the one that
    # began before it, they stay within room and the largest of them.
    t = t.withColumn("opened", opened).withColumn("room", room)
    t = t.withColumn("slot", F.when(F.col("reach") <= F.col("opened"), 0).otherwise(1 + F.floor((F.col("reach") - F.col("opened") - 1) / F.col("room"))))
    t = t.withColumn("window", F.min("seq").over(Window.partitionBy("conv_id", "stretch", "slot")).cast("long"))
    later = conv.orderBy("window").rangeBetween(1, Window.unboundedFollowing)
    t = t.withColumn("start", F.col("stop") - F.col("size")).withColumn("next", F.min("window").over(later)).withColumn("next_start", F.min("start").over(later))
    own = F.struct(F.col("window").alias("w"), F.lit(2).alias("kind"), F.col("part").alias("p"))
    again = F.when((F.col("next_start") - F.col("start") <= history) & ~((F.col("seq") == 1) & F.col("system").isNotNull()), F.struct(F.col("next").alias("w"), F.lit(1).alias("kind"), F.col("part").alias("p")))
    opening = F.when((F.col("seq") == F.col("window")) & (F.col("seq") > 1) & F.col("system").isNotNull(), F.struct(F.col("window").alias("w"), F.lit(0).alias("kind"), F.col("system.part").alias("p")))
    rows = t.select("conv_id", "seq", "role", F.length("head").alias("head"), F.length("body").alias("body"), F.explode(F.filter(F.array(own, again, opening), lambda x: x.isNotNull())).alias("x"))
    rows = rows.select("conv_id", "seq", "role", "head", "body", F.col("x.w").alias("window"), F.col("x.kind").alias("kind"), F.col("x.p").alias("part"))
    inside = Window.partitionBy("conv_id", "window").orderBy("kind", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("part")).over(inside), F.lit(0)))
    span = F.when((F.col("kind") == 2) & (F.col("role") == "assistant"), F.struct((F.col("at") + F.col("head")).cast("int").alias("start"), F.col("body").cast("int").alias("length")))
    grouped = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("kind", "seq", "part", span.alias("span")))).alias("parts"))
    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_context"),
        F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.ceil(F.length(p["part"]) / 4)).alias("tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_text, n_chars): each window's own turns as structs (role, text) and its unmasked text, from formatted alone."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    own = F.slice(pieces, F.col("n_context") + 1, F.size(pieces))
    text = lambda x: F.substring_index(F.substring_index(x, TEXT, -1), END, 1)
    turns = F.transform(own, lambda x: F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(text(x)).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("n_chars"))
