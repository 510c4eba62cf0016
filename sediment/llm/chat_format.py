"""Chat formatting in budgeted windows, in DataFrame expressions only.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts `%`
becomes `%25` and `<|` becomes `<%7C`, so no text can hold a mark, and the way
back is exact. Costs are tokens by a rule that needs no vocabulary: up to six
letters, one digit, or one other character that is no white space are a token,
and so are a turn's two marks and two new lines. Prefix sums of costs cut a
conversation into windows of whole turns: with a stride of half of what the
budget leaves beside the system turn and the history, a turn belongs to the
stride in which its end falls, and a turn longer than a stride has a window of
its own. Each window repeats the leading system turn, whole, and the last turns
of the window before, up to the history budget. So a window holds more than the
budget only if one turn alone does, beside the system turn. If the system turn
leaves less than a quarter of the budget beside the history, none is repeated.
Only assistant turns are targets, and only in the window that owns them;
repeated ones are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
TOKEN, MARKS = r"\p{L}{1,6}|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]", 4


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("<%7C"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<%7C"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def format_windows(conversations: DataFrame, budget: int = 512, history: int = 64) -> DataFrame:
    """conv_id, window, formatted, n_repeated, loss of each window of conversations(conv_id, turn, role, text, ...).

    n_repeated: leading turns that the window repeats (system turn, history);
    loss: spans (start, length) in code points, the escaped texts of the
    window's own assistant turns. Null text and role are empty; a new line in a
    role is escaped as %0A. Turns stand in order of turn, null first, then of
    role and text; equal rows are all kept. Rows without conv_id are left out.
    A conversation's turns are numbered in one task, by window functions over
    sorted rows that spill; windows are put together each by itself, and any
    text's length is bounded by a row's only. An empty table gives no rows.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    role, body = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("%0A")), escaped(F.col("text"))
    tokens = lambda c: F.regexp_count(c, F.lit(TOKEN))
    cost = (tokens(F.col("role")) + tokens(F.col("text")) + MARKS).cast("long")
    is_head = (F.col("at") == 1) & (F.col("role") == "system")
    t = rows.withColumn("cost", cost).withColumn("at", F.row_number().over(order))
    t = t.withColumn("system", F.max(F.when(is_head, F.col("cost")).otherwise(0)).over(upto)).withColumn("cost", F.when(is_head, 0).otherwise(F.col("cost")))
    left = F.lit(budget) - F.col("system")
    t = t.withColumn("history", F.when(left - history >= budget // 4, history).otherwise(0))
    t = t.withColumn("stride", F.floor(F.greatest(F.lit(2).cast("long"), left - F.col("history")) / 2)).withColumn("end", F.sum("cost").over(upto))
    t = t.withColumn("long", (F.col("cost") > F.col("stride")).cast("long"))
    t = t.withColumn("longs", F.sum("long").over(upto))
    # a long turn and what follows it differ: twice the number of long turns so far, less one at a long turn
    key = F.struct((2 * F.col("longs") - F.col("long")).alias("a"), F.floor((F.col("end") - 1) / F.col("stride")).alias("b"))
    same = F.coalesce(F.lag("key").over(order) == F.col("key"), F.lit(False))
    new = F.when(is_head | same, 0).otherwise(1)  # a leading system turn is in the first window, whatever it costs
    t = t.withColumn("key", key).withColumn("new", new).withColumn("window", F.greatest(F.sum("new").over(upto) - 1, F.lit(0).cast("long")))
    # what stands from a turn to its window's end: the window's last end less what came before
    of = Window.partitionBy("conv_id", "window")
    t = t.withColumn("tail", F.max("end").over(of) - F.col("end") + F.col("cost"))
    t = t.withColumn("last", F.max("window").over(Window.partitionBy("conv_id")))
    turn = lambda kind, window: F.struct(window.cast("long").alias("window"), F.lit(kind).alias("kind"))
    again = (F.col("tail") <= F.col("history")) & (F.col("window") < F.col("last")) & ~is_head
    heads = F.when(is_head & (F.col("last") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("last"))), lambda w: turn(0, w))).otherwise(F.array().cast("array<struct<window:bigint,kind:int>>"))
    places = F.concat(heads, F.when(again, F.array(turn(1, F.col("window") + 1))).otherwise(F.array().cast("array<struct<window:bigint,kind:int>>")), F.array(turn(2, F.col("window"))))
    t = t.select("conv_id", "at", role.alias("role"), body.alias("body"), F.explode(places).alias("p"))
    t = t.select("conv_id", F.col("p.window").alias("window"), F.col("p.kind").alias("kind"), "at", "role", "body")
    w = t.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "role", "body"))).alias("turns"))
    piece = lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["body"], F.lit(END + "\n"))
    w = w.withColumn("pieces", F.transform("turns", piece))
    sizes = F.transform("pieces", lambda x: F.length(x))
    w = w.withColumn("sizes", sizes)

    def loss(x: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(F.col("sizes"), 1, i), F.lit(0), lambda a, b: a + b)
        start = before + F.lit(len(START) + 1) + F.length(x["role"])
        return F.struct(start.alias("start"), F.length(x["body"]).alias("length"), (x["kind"] == 2).alias("own"), (x["role"] == "assistant").alias("target"))

    spans = F.transform(F.filter(F.transform("turns", loss), lambda x: x["own"] & x["target"]), lambda x: F.struct(x["start"], x["length"]))
    return w.select("conv_id", "window", F.array_join("pieces", "").alias("formatted"), F.size(F.filter("turns", lambda x: x["kind"] < 2)).alias("n_repeated"), spans.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation what formatted windows say: n_turns, turns (role, new line, text, new line each), loss text, formatted_chars."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("n_repeated") + 2, F.size(F.split("formatted", r"<\|im_start\|>")))

    def one(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END) - 1)
        return F.concat(unescaped(F.replace(role, F.lit("%0A"), F.lit("\n"))), F.lit("\n"), unescaped(body), F.lit("\n"))

    w = windows.withColumn("own", F.transform(parts, one))
    text = F.col("formatted")
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")
    w = w.select("conv_id", "window", F.size("own").cast("long").alias("n"), F.array_join("own", "").alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    c = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    return c.select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")
