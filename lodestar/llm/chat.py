"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all others
as named users; the mask is true on what the assistant says. Conversations are rendered in parts of a bounded number of
turns, so that no task gathers a whole one: parts follow each other and offsets run on.

Only turns move with their text, once, to be gathered by part. Where a part begins in a perspective follows from counts
alone: a speaker's own heads are so much shorter or longer than the heads that others see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import durable, prefix_sums

#: Turn numbers of one block of parts.
PART_TURNS = 64
#: Turns of one part at most.
PART_ROWS = 256
#: Crowded blocks whose list is sent to all tasks; a longer list is joined.
SENT_BLOCKS = 10_000

_CONV = ["conv_id", "no_conv"]  # a null id is a conversation, told apart by a flag so that joins are plain equalities


def _ranked(rows: DataFrame) -> DataFrame:
    """Turns of crowded blocks with ``cut``, their rank in the block over ``PART_ROWS``, and ``times``, how often the turn stands there.

    Ranges of the whole order are dealt to tasks, equal turns as one with a number; ranges' sizes give the ranks.
    """
    turn = ["numbered", "turn", "role", "said"]
    block = [*_CONV, "block"]
    same = rows.groupBy(*block, *turn).agg(F.count("*").alias("n"))
    dealt = durable(same.repartitionByRange(*block, *turn).withColumn("range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*block, "range").agg(F.sum("n").alias("n"))
    base = sizes.select(*block, "range", F.coalesce(F.sum("n").over(before(Window.partitionBy(*block).orderBy("range"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy(*block, "range").orderBy(*turn))), F.lit(0))
    at = dealt.withColumn("own", own).join(base, [*block, "range"]).withColumn("at", F.col("own") + F.col("base"))
    cuts = F.sequence(F.floor(F.col("at") / PART_ROWS), F.floor((F.col("at") + F.col("n") - 1) / PART_ROWS))
    cut = at.withColumn("cut", F.explode(cuts))
    times = F.least(F.col("at") + F.col("n"), (F.col("cut") + 1) * PART_ROWS) - F.greatest("at", F.col("cut") * PART_ROWS)
    return cut.select(*block, *turn, "cut", times.cast("int").alias("times"))


def _cut(t: DataFrame) -> tuple[DataFrame, list[str]]:
    """Turns with ``cut`` and ``times``, and what tells their part: the block, where some are crowded the cut too, which is 0 in others."""
    block = [*_CONV, "block"]
    crowded = durable(t.groupBy(*block).count().where(F.col("count") > PART_ROWS).select(*block))
    plain = lambda df: df.withColumn("cut", F.lit(0).cast("long")).withColumn("times", F.lit(1))
    n = crowded.count()
    if not n:
        return plain(t), block
    listed = F.broadcast(crowded) if n <= SENT_BLOCKS else crowded
    return plain(t.join(listed, block, "left_anti")).unionByName(_ranked(t.join(listed, block, "left_semi"))), [*block, "cut"]


def rotate_perspectives(turns: DataFrame, system: tuple[str, ...] = ("system",), open_tag: str = "<|", close_tag: str = "|>", end_tag: str = "<|end|>\n", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, part, start_char, text, mask, n_turns), a row for each participant and part.

    ``text`` joins one segment a turn: ``<|assistant|>`` or ``<|user:NAME|>`` or ``<|system|>``, a line feed, the turn's
    text, the end tag. ``mask`` lists [from, to) characters of the whole rendering that the assistant said, end tag
    included. ``start_char`` is where the part begins in it. Speakers named in ``system`` are context for all and take no
    perspective; a conversation without other speakers gives no rows.

    Turns go by number, then role, then text, null before all. A part holds the turns of ``PART_TURNS`` numbers (0 to 63,
    64 to 127 and so on, those without a number together), and if these are more than ``PART_ROWS``, so many of them each
    in their order. Parts are numbered from 0 in the order of the turns.

    A null role is the speaker ``unknown``, a null text is empty, turns without a conversation belong to one of their own
    (null). Repeated rows stay, in turn order. Other columns play no part. An empty table stays empty.
    """
    conv = F.col(conv_col)
    kind = dict(turns.dtypes)[conv_col]
    filler = F.lit("") if kind == "string" else F.lit(0).cast(kind)
    t = turns.select(F.coalesce(conv, filler).alias("conv_id"), conv.isNull().alias("no_conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("said"))
    t = t.withColumn("numbered", F.col("turn").isNotNull()).withColumn("turn", F.coalesce("turn", F.lit(0)))
    t, part = _cut(t.withColumn("block", F.when(F.col("numbered"), F.floor(F.col("turn") / PART_TURNS)).otherwise(F.lit(-(1 << 62)))))

    heads = lambda who: F.concat(F.lit(open_tag), who, F.lit(close_tag + "\n"))
    is_system = lambda role: role.isin(*system) if system else F.lit(False)
    other = lambda role: heads(F.when(is_system(role), F.lit("system")).otherwise(F.concat(F.lit("user:"), role)))
    own = heads(F.lit("assistant"))

    # counts: of each part and speaker the turns and the characters that others see
    chars = (F.length(other(F.col("role"))) + F.length("said") + F.length(F.lit(end_tag))).cast("long") * F.col("times")
    spoken = durable(t.groupBy(*part, "role").agg(F.sum(F.col("times").cast("long")).alias("n"), F.sum(chars).alias("chars")))
    parts = spoken.groupBy(*part).agg(F.sum("chars").alias("chars"))
    starts = prefix_sums(_numbered(parts, part), _CONV, "part", F.col("chars"), "start").select(*part, "part", "start")
    mine = spoken.where(~is_system(F.col("role"))).select(*part, F.col("role").alias("perspective"), "n")
    grid = starts.join(mine.select(*_CONV, "perspective").distinct(), _CONV).join(mine, [*part, "perspective"], "left")
    said = prefix_sums(durable(grid.withColumn("n", F.coalesce("n", F.lit(0)))), [*_CONV, "perspective"], "part", F.col("n"), "before")
    shorter = (F.length(other(F.col("perspective"))) - F.length(own)).cast("long")
    placed = said.select(*part, "perspective", "part", (F.col("start") - F.col("before") * shorter).alias("start_char"))

    turn = F.struct("numbered", "turn", "role", "said", "times")
    gathered = t.groupBy(*part).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    copies = lambda x: F.array_repeat(F.struct(x["role"].alias("role"), x["said"].alias("said")), x["times"])
    seen = gathered.withColumn("turns", F.flatten(F.transform("turns", copies))).join(placed, part)

    def segment(s: Column) -> Column:
        is_own = s["role"] == F.col("perspective")
        head, body = F.when(is_own, own).otherwise(other(s["role"])), F.concat(s["said"], F.lit(end_tag))
        return F.struct(F.concat(head, body).alias("text"), F.length(head).alias("head"), (F.length(head) + F.length(body)).cast("long").alias("chars"), is_own.alias("own"))

    seen = seen.select("conv_id", "no_conv", "perspective", "part", "start_char", F.transform("turns", segment).alias("segments"))
    offset = lambda i: F.col("start_char") + F.aggregate(F.slice("segments", 1, i), F.lit(0).cast("long"), lambda n, s: n + s["chars"])
    span = lambda s, i: F.when(s["own"], F.struct((offset(i) + s["head"]).alias("from"), (offset(i) + s["chars"]).alias("to")))
    mask = F.filter(F.transform("segments", span), lambda x: x.isNotNull())
    name = F.when(~F.col("no_conv"), F.col("conv_id")).alias("conv_id")
    return seen.select(name, "perspective", "part", "start_char", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), mask.alias("mask"), F.size("segments").alias("n_turns"))


def _numbered(parts: DataFrame, part: list[str]) -> DataFrame:
    """Parts with their number in the conversation, by block and cut: blocks are numbered first, then cuts counted on."""
    parts, block = durable(parts), [*_CONV, "block"]
    cuts = prefix_sums(parts.groupBy(*block).agg(F.count("*").alias("cuts")), _CONV, "block", F.col("cuts"), "first")
    cut = F.col("cut") if "cut" in part else F.lit(0)
    return durable(parts.join(cuts.select(*block, "first"), block).withColumn("part", F.col("first") + cut).drop("first"))
