"""Cumulative-snapshot collapse of logged conversations, and their rendering as chat text.

A chat log often holds the same conversation once per turn, each entry a prefix of the next. The hash of a prefix is the
running XOR of 128 bits of (turn, role, text), so a conversation is a prefix of a longer one if its last hash is a hash
within that one. Conversations that are prefixes go by an anti-join; of equal ones the smallest conv_id stays.

Edge cases: a null role or text counts as the empty string but differs from it in the hash. Rows with a null conv_id form
one conversation. Rows that repeat a whole turn count once; several different rows of one turn number belong to that turn
and are rendered in order of role and text. A null turn comes first. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, prepare, table

HASH = ["a", "b"]
#: Running hashes go over blocks of so many turn numbers, so that one huge conversation is not one task's work.
BLOCK = 1024


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, last): the running hash after each turn."""
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).alias("block")
    one = turns.groupBy("conv_id", "turn", F.xxhash64("turn", F.isnull("role"), "role", F.isnull("text"), "text").alias("a"), F.xxhash64(F.lit(7), "text", F.isnull("role"), "role", "turn").alias("b")).agg(F.lit(1).alias("one"))
    cells = one.groupBy("conv_id", block, "turn").agg(*(F.bit_xor(h).alias(h) for h in HASH))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("conv_id", "block").agg(*(F.bit_xor(h).alias(f"{h}_sum") for h in HASH))
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("k"), *(F.coalesce(F.bit_xor(f"{h}_sum").over(before), F.lit(0)).alias(f"{h}_before") for h in HASH),
        (F.lead("block").over(Window.partitionBy("conv_id").orderBy("block")).isNull()).alias("last_block"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first())
    run = cells.select(
        "conv_id", "block", "turn", *(F.bit_xor(h).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(h) for h in HASH), F.lead(F.lit(1)).over(inside).isNull().alias("ends"),
    )
    both = run.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    return both.select("conv_id", "turn", *(F.col(h).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in HASH), (F.col("ends") & F.col("last_block")).alias("last"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_logged): the maximal conversations and how many equal entries each stands for."""
    scratch = Scratch(turns.sparkSession, "conversations")
    p = scratch.write(prefixes(turns), "prefixes")
    whole = p.where("last").groupBy(*HASH).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    inner = p.where("NOT last").select(*HASH).distinct()
    return whole.join(inner, HASH, "left_anti").select("conv_id", "n_logged")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def render_maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_logged, n_turns, chat) of the maximal conversations."""
    prepare(turns.sparkSession)
    turns = turns.select("conv_id", "turn", "role", "text")
    keep = collapse(turns).withColumnRenamed("conv_id", "kept")
    kept = turns.join(keep, F.col("conv_id").eqNullSafe(F.col("kept"))).distinct()
    parts = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"))))
    chat = F.array_join(F.transform(parts, lambda s: rendered(s["r"], s["x"])), "")
    return kept.groupBy("conv_id", "n_logged").agg(F.count("*").alias("n_turns"), chat.alias("chat"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_maximal(table(spark, sf_dir, "conversations")).select("conv_id", "n_logged", "n_turns", "chat")


ORACLE_SQL = r"""
WITH p AS (
  SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS top,
         string_agg(turn || chr(1) || role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix
  FROM conversations),
f AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_logged FROM p WHERE turn = top GROUP BY prefix),
k AS (SELECT f.* FROM f WHERE prefix NOT IN (SELECT prefix FROM p WHERE turn < top))
SELECT c.conv_id, k.n_logged, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS chat
FROM conversations c JOIN k ON c.conv_id = k.conv_id GROUP BY c.conv_id, k.n_logged
"""
