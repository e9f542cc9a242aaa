"""Chat formatting in budgeted windows, in DataFrame functions alone.

Prefix sums of the turns' tokens, cut at a stride that leaves room for the longest turn, give spans of
whole turns that keep within the budget; a turn of more than half the room stands alone. Each window after the
first begins with the system turn and the last few turns before it, which are masked: a target is learnt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

BUDGET = 1024
HISTORY_TURNS, HISTORY_TOKENS = 2, 256
#: The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
#: A token, as counted here: a run of letters, marks, digits, or one other sign. A turn's marks count MARKS.
TOKEN, MARKS = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]", 5
TURN = r"(?s)<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*?)<\|im_end\|>\n"


def escaped(text: Column) -> Column:
    """A backslash before each backslash, and inside each ``<|``: no mark is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))


def rendered(turn: Column) -> Column:
    return F.concat(header(turn["role"]), escaped(turn["text"]), F.lit(END + "\n"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Windows of each conversation (conv_id, turn, role, text).

    ``text``: the formatted turns; ``loss_spans``: start and length, in code points, of what is learnt: each
    assistant text in the one window where it is new; ``n_repeated``: turns at the window's start that stand
    in an earlier one; ``n_turns``: the new ones; ``n_tokens``; ``over_budget``: its one turn, with the system
    turn and what is repeated, is longer than the budget, as turns are never cut.

    A first turn by ``system`` is kept at the head of all windows. Turns are in order of turn (null first), then
    role and text; repeated rows are turns of their own. Null roles and texts are empty; null conv_ids are
    one conversation. An empty table gives no rows. A conversation's windows are made by window functions that
    spill to disk; each window is bounded by the budget. Very long texts stand alone in a window. Other columns, also of clashing names, are not read.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    blank = F.lit("")
    t = pick(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    t = t.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + MARKS).cast("long")).withColumn("pos", F.row_number().over(order))
    t = t.withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    t = t.withColumn("system_tokens", F.sum(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(sofar))
    room = F.greatest(budget - F.col("system_tokens") - history_tokens, F.lit(budget // 4))
    t = t.withColumn("room", room).withColumn("own", F.when(F.col("is_system"), 0).otherwise(F.col("tokens")))
    t = t.withColumn("big", 2 * F.col("own") > F.col("room"))
    t = t.withColumn("segment", F.sum((F.col("big") | F.coalesce(F.lag("big").over(order), F.lit(False))).cast("int")).over(sofar))
    t = t.withColumn("stride", F.col("room") - F.coalesce(F.max(F.when(~F.col("big"), F.col("own"))).over(whole), F.lit(0)) + 1)
    ends = F.sum("own").over(Window.partitionBy("conv_id", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("cell", F.when(F.col("big"), 0).otherwise(F.floor((F.greatest(ends, F.lit(1)) - 1) / F.col("stride"))))
    changed = (F.col("segment") != F.lag("segment").over(order)) | (F.col("cell") != F.lag("cell").over(order))
    t = t.withColumn("new", (F.col("pos") > 1) & ~F.coalesce(F.lag("is_system").over(order), F.lit(False)) & F.coalesce(changed, F.lit(False)))
    t = t.withColumn("window", F.sum(F.col("new").cast("int")).over(sofar))

    this = F.struct("role", "text", "tokens", "is_system")
    recent = F.collect_list(this).over(order.rowsBetween(-history_turns, -1))
    recent = F.filter(recent, lambda x: ~x["is_system"])
    within = lambda x, i: F.aggregate(F.slice(F.col("recent"), i + 1, F.size("recent")), F.lit(0).cast("long"), lambda a, y: a + y["tokens"]) <= history_tokens
    system = F.first(F.when(F.col("is_system"), this), ignorenulls=True).over(sofar)
    none = F.filter(F.array(this), lambda x: F.lit(False))
    t = t.withColumn("recent", F.when(F.col("new"), recent).otherwise(none)).withColumn("system", F.when(F.col("new"), system))
    t = t.withColumn("repeated", F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(none), F.filter("recent", within)))
    t = t.withColumn("lead", F.array_join(F.transform("repeated", rendered), "")).withColumn("head", header(F.col("role"))).withColumn("body", escaped(F.col("text")))
    t = t.withColumn("chunk", F.concat("lead", "head", "body", F.lit(END + "\n")))
    chunks = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("at", F.sum(F.length("chunk").cast("long")).over(chunks) - F.length("chunk"))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("lead") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    t = t.withColumn("span", span).withColumn("used", F.col("tokens") + F.aggregate("repeated", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    w = t.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk", "span"))).alias("parts"), F.count("*").alias("n_turns"), F.max(F.size("repeated")).alias("n_repeated"), F.sum("used").alias("n_tokens"))
    return w.select("conv_id", "window", F.array_join(F.col("parts.chunk"), "").alias("text"), F.filter(F.col("parts.span"), lambda x: x.isNotNull()).alias("loss_spans"), "n_turns", "n_repeated", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """What a reader of the formatted windows finds, for each conversation: its turns and the text under the
    loss mask, unescaped. A digest needs its whole conversation in one value."""
    role = F.regexp_extract_all("text", F.lit(TURN), F.lit(1))
    body = F.regexp_extract_all("text", F.lit(TURN), F.lit(2))
    w = windows.withColumn("turns", F.arrays_zip(role.alias("role"), body.alias("body")))
    w = w.withColumn("turns", F.slice("turns", F.col("n_repeated") + 1, F.greatest(F.size("turns"), F.lit(1))))
    said = F.transform("turns", lambda x: F.concat(unescaped(x["role"]), F.lit("\n"), unescaped(x["body"]), F.lit("\n")))
    learnt = F.transform("loss_spans", lambda x: unescaped(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    w = w.select("conv_id", F.struct("window", F.array_join(said, "").alias("said"), F.array_join(learnt, "").alias("learnt")).alias("x"), F.size("turns").alias("n"), F.length("text").alias("chars"))
    c = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    learnt = F.array_join(F.col("x.learnt"), "")
    return c.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("x.said"), "").cast("binary"), 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
