"""Operator 2: preference formatting.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once, as the prompt; what follows in each is rendered as a completion
with the spans that a loss may count: the text and end mark of assistant turns.
A turn can't forge another: the start of a mark in its role or text is taken
apart by a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): the turns of each conversation in order of turn, then
    role and text; a null turn comes first, null role and text are empty, and
    marks in them are taken apart.  Rows with a null key are of no conversation
    and left out."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<|im _")).alias(c)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))
    return turns.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat('{START}', t.role, '\\n', t.text, '<|im_end|>\\n')), '')")


def _spans(turns: str) -> Column:
    """Where the loss counts in the rendered turns, in characters."""
    head = f"(char_length(t.role) + {len(START) + len(MIDDLE)})"
    size = f"(char_length(t.text) + {len(END)})"
    step = f"named_struct('at', acc.at + {head} + {size}, 'spans', if(t.role = 'assistant', array_append(acc.spans, named_struct('start', acc.at + {head}, 'length', {size})), acc.spans))"
    return F.expr(f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)), (acc, t) -> {step}, acc -> acc.spans)")


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """A row for each pair: pair_id, n_prompt_turns, prompt, chosen,
    chosen_spans, rejected, rejected_spans.

    Both tables hold turns (key, turn, role, text).  Turns are common if role
    and text are equal; their turn numbers may differ.  A pair that one table
    lacks has an empty conversation there.  Conversations that are equal to the
    end have empty completions.  Repeated turn rows are turns of their own;
    other columns are not used; empty tables give no rows.
    """
    a, b = conversations(chosen, key).withColumnRenamed("turns", "c"), conversations(rejected, key).withColumnRenamed("turns", "r")
    both = a.join(b, "pair_id", "full").select("pair_id", *[F.coalesce(x, F.expr(f"cast(array() as {_TURNS})")).alias(x) for x in ("c", "r")])
    return format_pairs(both)


def format_pairs(both: DataFrame) -> DataFrame:
    """``format_preferences`` of pairs of conversations: pair_id, c, r."""
    differs = F.expr("array_position(zip_with(c, r, (x, y) -> x is not null and y is not null and x.role = y.role and x.text = y.text), false)")
    both = both.withColumn("d", differs.cast("int")).withColumn("n", F.when(F.col("d") > 0, F.col("d") - 1).otherwise(F.size("c")))
    parts = both.select("pair_id", F.col("n").alias("n_prompt_turns"), F.expr("slice(c, 1, n)").alias("p"), F.expr("slice(c, n + 1, size(c))").alias("c"), F.expr("slice(r, n + 1, size(r))").alias("r"))
    return parts.select("pair_id", "n_prompt_turns", _rendered("p").alias("prompt"), _rendered("c").alias("chosen"), _spans("c").alias("chosen_spans"), _rendered("r").alias("rejected"), _spans("r").alias("rejected_spans"))


def swapped_endings(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs (pair_id, c, r) for a table that has no rejected conversations:
    each conversation with itself with its last assistant turn (by turn, then
    text; a null turn is before all others) replaced by that of its neighbour
    (the key, a long, with the lowest bit flipped), or without it if the
    neighbour has none.  Repeated rows of that turn are replaced alike.  Turns
    are grouped once; only the last texts move to their neighbours."""
    mine = conversations(turns, key).withColumn("l", F.expr("array_max(transform(filter(turns, t -> t.role = 'assistant'), t -> struct(t.turn as turn, t.text as text)))"))
    other = mine.filter("l is not null").select(F.expr("pair_id ^ 1L").alias("pair_id"), F.col("l.text").alias("o"))
    both = mine.join(other, "pair_id", "left")
    ending = "t.role = 'assistant' and t.turn <=> l.turn and t.text = l.text"
    kept = f"filter(turns, t -> o is not null or l is null or not ({ending}))"
    made = f"sort_array(transform({kept}, t -> named_struct('turn', t.turn, 'role', t.role, 'text', if(l is not null and {ending}, o, t.text))))"
    return both.select("pair_id", F.col("turns").alias("c"), F.expr(made).alias("r"))
