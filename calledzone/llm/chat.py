"""Chat formatting in budgeted windows, in built-in functions only.

Prefix sums of turn tokens place each turn in a grid of cells as wide as the room a window has for new turns; a
turn that crosses into the next cell gets a window of its own, so no window exceeds its budget unless
one turn alone does. Every window starts with the system turn (a first turn of role system), then repeats the turns
before it as far as HISTORY tokens allow, then brings its new turns. The loss mask covers the texts of
new assistant turns only: repeated ones are masked, so each target is learned once.

A turn is written as <|turn|>role<|text|>text<|end|> and a line end. Inside roles and texts a backslash is doubled and
"<|" becomes "<" + backslash + "|", so control strings in a text cannot be mistaken for marks, and reading back is exact.

Prefix sums are taken within blocks of turn numbers and then over blocks, so that a conversation of very many
turns is spread over tasks; only `read_back`, whose digest is of a whole conversation, puts its text in one row.

Defined cases: null texts and roles count as empty; turns are ordered by number (nulls first), then role and text;
repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty
result. Very long turns are not cut. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, LEAST_ROOM = 1024, 256, 64
TURN_BLOCK = 256
# Fixed values of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
BEFORE_ALL = -(1 << 62)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place, the tokens before them (the system turn not counted) and the room of a window."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"))
    # A conversation without id gets a key of its own for the joins.
    rows = rows.select(F.struct(F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("none")).alias("conv"),
                       F.coalesce("turn", F.lit(BEFORE_ALL)).alias("turn"), "role", "text",
                       F.ceil(F.octet_length("text") / 4).cast("long").alias("text_tokens"))
    rows = rows.withColumn("tokens", F.col("text_tokens") + 4).withColumn(
        "block", F.when(F.col("turn") == BEFORE_ALL, F.col("turn")).otherwise(F.floor(F.col("turn") / TURN_BLOCK)))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(inside)).withColumn(
        "sum", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    system = F.when((F.col("at") == 1) & (F.col("role") == "system"), F.col("tokens"))
    blocks = rows.groupBy("conv", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max(system).alias("system"))
    before = Window.partitionBy("conv").orderBy("block")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("sum_before"),
        F.coalesce(F.first("system").over(before.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("system"))
    rows = rows.join(blocks, ["conv", "block"])
    seq = F.col("n_before") + F.col("at")
    is_system = (seq == 1) & (F.col("role") == "system")
    start = F.when(is_system, 0).otherwise(F.col("sum_before") + F.col("sum") - F.col("tokens") - F.col("system"))
    room = F.greatest(F.lit(BUDGET - HISTORY) - F.col("system"), F.lit(LEAST_ROOM))
    return rows.select(
        "conv", seq.alias("seq"), is_system.alias("is_system"), "role",
        F.when(is_system, 0).otherwise(F.col("tokens")).alias("tokens"), start.alias("start"), room.alias("room"),
        escape(F.col("role")).alias("role_text"), escape(F.col("text")).alias("body"))


def format_windows(turns: DataFrame) -> DataFrame:
    """One row per window: conv_id, window, formatted, fresh (for each turn in it, whether it is new here),
    mask (start and length, in code points, of the texts that are learned)."""
    rows = _numbered(turns)
    cell = F.floor(F.col("start") / F.col("room"))
    rows = rows.withColumn("cell", cell).withColumn(
        "own", F.when(F.col("start") + F.col("tokens") > (F.col("cell") + 1) * F.col("room"), 1).otherwise(0))
    turn = F.struct("seq", "role", "role_text", "body")
    fresh = rows.select("conv", "cell", "own", turn.alias("turn"), F.lit(True).alias("fresh"))
    windows = rows.groupBy("conv", "cell", "own").agg(F.min("start").alias("from"))
    later = rows.filter("not is_system").select(
        "conv", "start", turn.alias("turn"),
        F.explode(F.sequence(F.col("cell"), F.floor((F.col("start") + HISTORY) / F.col("room")))).alias("cell"))
    history = later.join(windows, ["conv", "cell"]).filter(
        (F.col("start") < F.col("from")) & (F.col("start") >= F.col("from") - HISTORY))
    system = rows.filter("is_system").select("conv", turn.alias("turn"))
    repeated = windows.filter("cell > 0 or own > 0").join(system, "conv")
    every = fresh.unionByName(history.select("conv", "cell", "own", "turn", F.lit(False).alias("fresh"))).unionByName(
        repeated.select("conv", "cell", "own", "turn", F.lit(False).alias("fresh")))
    window = every.groupBy("conv", "cell", "own").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn.seq").alias("seq"), "fresh", "turn"))).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(
        F.lit(TURN), t["turn"]["role_text"], F.lit(TEXT), t["turn"]["body"], F.lit(END)))
    window = window.withColumn("written", written).withColumn("lengths", F.transform("written", F.length))
    span = F.transform("turns", lambda t, i: F.struct(
        (F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, b: a + b) + len(TURN) + len(TEXT)
         + F.length(t["turn"]["role_text"])).alias("start"),
        F.length(t["turn"]["body"]).alias("length"),
        (t["fresh"] & (t["turn"]["role"] == "assistant")).alias("learned")))
    mask = F.transform(F.filter(span, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return window.select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), (F.col("cell") * 2 + F.col("own")).alias("window"),
        F.concat_ws("", "written").alias("formatted"), F.transform("turns", lambda t: t["fresh"]).alias("fresh"), mask.alias("mask"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted windows: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    parts = F.split("formatted", "<\\|end\\|>\n")
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.split(p, "<\\|text\\|>", 2))
    told = F.transform(turns, lambda t, i: F.when(F.get(F.col("fresh"), i), F.concat(
        unescape(F.substr(t[0], F.lit(len(TURN) + 1))), F.lit("\n"), unescape(t[1]), F.lit("\n"))).otherwise(F.lit("")))
    learned = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    read = windows.select(
        "conv_id", "window", F.concat_ws("", told).alias("turns"), F.concat_ws("", learned).alias("loss"),
        F.size(F.filter("fresh", lambda f: f)).alias("n"), F.length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("windows"))
    turns_text = F.concat_ws("", F.transform("windows", lambda w: w["turns"]))
    loss_text = F.concat_ws("", F.transform("windows", lambda w: w["loss"]))
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
