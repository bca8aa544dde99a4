"""Dialogues as training text, seen from every speaker in turn. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

BEGIN, END, SYSTEM, NAMELESS = "<|im_start|>", "<|im_end|>", "system", "unknown"
LAST = 2**63 - 1


def harmless(text: Column) -> Column:
    """Text that can't pass for a turn's marks."""
    return F.replace(F.replace(text, F.lit(BEGIN), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))


def cut_crowded(rows: DataFrame, crowded: DataFrame, part_turns: int, scratch: Scratch) -> DataFrame:
    """rows with `sub`: the rank div part_turns within the parts that crowded (c, m) names, by turn, role and md5 of the text.

    Equal rows are counted first, and ranges of rows are counted before ranks are given, so no part meets in one task.
    """
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("number") == F.col("m"))
    by = ["conv_id", "number"]
    order = [F.asc_nulls_last("turn"), F.asc("role"), F.asc("tie")]
    counted = rows.join(crowded, here, "left_semi").groupBy(*by, "turn", "role", "said").agg(F.count("*").alias("copies"))
    dealt = counted.withColumn("tie", F.md5("said")).repartitionByRange(*by, *order)
    dealt = scratch.keep(dealt.withColumn("task", F.spark_partition_id()), "crowded-rows")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "task").agg(F.sum("copies").alias("n"))
    start = F.coalesce(F.sum("n").over(before.partitionBy(*by).orderBy("task")), F.lit(0))
    starts = sums.select(F.col("conv_id").alias("c"), F.col("number").alias("m"), F.col("task").alias("t"), start.alias("start"))
    inside = F.coalesce(F.sum("copies").over(before.partitionBy(*by, "task").orderBy(*order)), F.lit(0))
    placed = dealt.withColumn("inside", inside).join(starts, here & (F.col("task") == F.col("t")))
    placed = placed.withColumn("low", F.col("inside") + F.col("start")).withColumn("high", F.col("low") + F.col("copies") - 1)
    # Equal rows may reach over several parts.
    spread = placed.withColumn("sub", F.explode(F.sequence(F.expr(f"low div {part_turns}"), F.expr(f"high div {part_turns}"))))
    first, last = F.col("sub") * part_turns, F.col("sub") * part_turns + part_turns - 1
    times = F.least("high", last) - F.greatest("low", first) + 1
    each = spread.withColumn("copy", F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
    few = rows.join(crowded, here, "left_anti").withColumn("sub", F.lit(0).cast("long"))
    return few.unionByName(each.select(*rows.columns, "sub"))


def perspectives(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 256
) -> DataFrame:
    """For each conversation and each of its speakers: the dialogue with that speaker as assistant and the others as users.

    Columns: conv_id, speaker, part, text, begin, n_chars, spans, n_trained. Turns are rendered as
    `<|im_start|>head LF text<|im_end|> LF`, where head is `assistant` for the speaker, `user name` for every other one, and
    `system` for system turns, which belong to no speaker. `spans` are `low:high` places (code points, in the part's
    text) of what the speaker says with the end mark behind it, joined by commas: the loss mask is 1 there and 0 elsewhere.

    A dialogue is rendered in parts of the turns whose number div part_turns is equal. Where equal numbers or missing ones
    put more than part_turns rows there, such a part is cut into parts of part_turns rows, by turn, role and md5 of the
    text, so no row gathers more than that. `begin` is where the part's text begins in the dialogue. Short conversations
    are one part.

    Null role or an empty one: the speaker `unknown`. Null text: empty. Null turn: after all others, in parts of their own.
    Null conversation: a conversation of its own. Equal turns of a part: by role, then text. Repeated rows: each is a turn. Marks
    inside texts and names are broken by spaces. Conversations of system turns alone, and empty tables: no rows. Only the
    four columns are read, so other columns do not matter.
    """
    role = F.when(F.trim(F.coalesce(F.col(role_col), F.lit(""))) == "", F.lit(NAMELESS)).otherwise(F.col(role_col))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        harmless(role).alias("role"),
        harmless(F.coalesce(F.col(text_col), F.lit(""))).alias("said"),
    )
    number = F.coalesce(F.expr(f"turn div {part_turns}"), F.lit(LAST)).cast("long")
    rows = rows.withColumn("number", number)
    scratch = Scratch(turns.sparkSession, "chat")
    crowded = rows.groupBy("conv_id", "number").agg(F.count("*").alias("n")).where(F.col("n") > part_turns)
    crowded = scratch.keep(crowded.select(F.col("conv_id").alias("c"), F.col("number").alias("m")), "crowded")
    if crowded.limit(1).count():
        rows = cut_crowded(rows, crowded, part_turns, scratch)
    else:
        rows = rows.withColumn("sub", F.lit(0).cast("long"))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit("assistant")).when(F.col("role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user "), F.col("role")))
    head = F.concat(F.lit(BEGIN), head, F.lit("\n"))
    tail = F.concat(F.col("said"), F.lit(END))
    segment = F.struct(
        F.coalesce("turn", F.lit(LAST)).alias("turn"),
        "role",
        "said",
        F.concat(head, tail, F.lit("\n")).alias("text"),
        F.length(head).alias("lead"),
        F.length(tail).alias("size"),
        own.alias("own"),
    )
    parts = seen.groupBy("conv_id", "speaker", "number", "sub").agg(F.sort_array(F.collect_list(segment)).alias("segments"))

    def advance(state: Column, s: Column) -> Column:
        low = state["at"] + s["lead"]
        high = low + s["size"]
        span = F.concat_ws(":", low.cast("string"), high.cast("string"))
        spans = F.when(s["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        trained = state["trained"] + F.when(s["own"], s["size"]).otherwise(0)
        return F.struct((high + 1).alias("at"), spans.alias("spans"), trained.cast("long").alias("trained"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("trained"))
    rendered = parts.select(
        "conv_id", "speaker", "number", "sub", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), F.aggregate("segments", start, advance).alias("mask")
    )
    # Where parts stand follows from their lengths, which are summed without their texts.
    lengths = seen.groupBy("conv_id", "speaker", "number", "sub").agg(F.sum(F.length(head) + F.length(tail) + 1).alias("n"))
    by_part = Window.partitionBy("conv_id", "speaker").orderBy("number", "sub")
    before = F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lengths.select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("number").alias("m"), F.col("sub").alias("u"), F.row_number().over(by_part).cast("long").alias("part"), before.cast("long").alias("begin")
    )
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("number") == F.col("m")) & (F.col("sub") == F.col("u"))
    return rendered.join(placed, here).select(
        "conv_id",
        "speaker",
        "part",
        "text",
        "begin",
        F.length("text").cast("long").alias("n_chars"),
        F.array_join("mask.spans", ",").alias("spans"),
        F.col("mask.trained").alias("n_trained"),
    )
