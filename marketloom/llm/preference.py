"""Preference formatting: pairs of conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.session import cut_lineage

END = "<|end|>"


def turn_lists(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): the turns of every conversation in order of their number,
    nulls first, equal numbers by role and text. One row holds one conversation."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    """`<|role|>`, a line break, the text, `<|end|>` and a line break for every turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """The trained spans of a rendered completion, as `start:end` joined by
    commas: text and end mark of every assistant turn, in code points."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.char_length(_head(turn))
        end = start + F.char_length(_body(turn))
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: F.array_join(state["spans"], ","))


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """(key, n_prompt_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask) for every key with both conversations; the tables hold
    (key, turn, role, text).

    The prompt is the longest common prefix of turns with equal role and text,
    nulls equal to nulls, rendered once. It is empty where the first turns
    differ, and a conversation that is a prefix of the other has an empty
    completion. Null texts and roles render as empty; rows without key, and
    keys on one side only, have no pair. Repeated rows are repeated turns."""
    sides = (turn_lists(chosen.where(F.col(key).isNotNull()), key).withColumnRenamed("turns", "c")
             .join(turn_lists(rejected.where(F.col(key).isNotNull()), key).withColumnRenamed("turns", "r"), key))
    return format_lists(sides, key)


def format_lists(sides: DataFrame, key: str) -> DataFrame:
    """What `format_pairs` gives, from pairs that hold both conversations as
    arrays of turns: (key, c, r)."""
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    shorter = F.least(F.size("c"), F.size("r"))
    common = F.when(first > 0, F.least(first.cast("int") - 1, shorter)).otherwise(shorter)
    cut = sides.withColumn("n", common)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    cut = cut.select(key, "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(key, F.col("n").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"),
                      render(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"))


def neighbours(keys: DataFrame, key: str) -> DataFrame:
    """(key, next, previous) in the order of the distinct `keys`, null at the
    ends. Keys are dealt by ranges, and only the first and last of every range,
    one row each, meet in one window."""
    placed = cut_lineage(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "order")
    own, ends = Window.partitionBy("_part").orderBy(key), Window.orderBy("_part")
    edges = placed.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    edges = edges.select("_part", F.lead("_low").over(ends).alias("_next"), F.lag("_high").over(ends).alias("_previous"))
    inside = placed.withColumns({"next": F.lead(key).over(own), "previous": F.lag(key).over(own)}).join(edges, "_part")
    return inside.select(key, F.coalesce("next", "_next").alias("next"), F.coalesce("previous", "_previous").alias("previous"))


def mismatched_pairs(turns: DataFrame) -> DataFrame:
    """Pairs (conv_id, c, r) from plain conversations (conv_id, turn, role,
    text): the chosen one ends with the last reply of the assistant, and the
    rejected one has the last reply of the next conversation in its place, or
    of the one before where the next has none. Next and before are those in the
    order of ids, whatever lies between them. Without a reply or a neighbour
    with one there is no pair.

    Rows without id have no part; null texts are empty replies; equal turn
    numbers go by role and text; repeated rows are repeated turns; an empty
    table has no pairs. Only the four columns are read."""
    lists = turn_lists(turns.select("conv_id", "turn", "role", "text").where("conv_id is not null"), "conv_id")
    lists = cut_lineage(lists, "lists")
    reply = lambda t: t["role"].eqNullSafe("assistant")
    back = F.array_position(F.transform(F.reverse("turns"), reply), F.lit(True)).cast("int")
    ended = lists.withColumn("last", F.size("turns") - back + 1).where(back > 0)
    ended = ended.select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("turns"), F.get("turns", F.col("last") - 1)["text"].alias("reply"))
    replies = ended.select(F.col("conv_id").alias("own"), F.col("reply").alias("other"), F.lit(True).alias("there"))
    near = (ended.join(neighbours(lists.select("conv_id"), "conv_id").withColumnsRenamed({"next": "n", "previous": "p"}), "conv_id")
            .join(replies.withColumnsRenamed({"own": "o1", "other": "next", "there": "t1"}), F.col("n") == F.col("o1"), "left")
            .join(replies.withColumnsRenamed({"own": "o2", "other": "previous", "there": "t2"}), F.col("p") == F.col("o2"), "left")
            .where("t1 or t2"))
    other = F.when(F.col("t1"), F.col("next")).otherwise(F.col("previous"))
    last = F.get("turns", F.size("turns") - 1)
    swapped = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1),
                       F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), other.alias("text"))))
    return near.select("conv_id", F.col("turns").alias("c"), swapped.alias("r"))
