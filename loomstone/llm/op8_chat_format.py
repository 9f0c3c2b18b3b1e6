"""Chat formatting with cumulative-snapshot collapse, with DataFrame functions only.

A chat log often holds a conversation once after every turn, each snapshot a prefix of the next. Each turn's digest
covers its place, role and text; the running exclusive-or of two such 64-bit
digests over a conversation's turns is a rolling hash of its prefixes. A conversation whose whole hash occurs, at the same length, as a proper prefix of some conversation is a
snapshot that a longer one contains; an anti-join drops it. Of equal conversations the one with the smallest id stays.
What is maximal is rendered.

Hashes are aggregated per (length, hash) before they are compared, so that a first turn or a whole conversation which a
third of the log shares counts once a task. Only the turns of one conversation meet in a row, as they do in the output.

Defined results: turns are in the order of turn (null first), role, text; a row repeated within a conversation counts
once; a null role is rendered as ``unknown`` and a null or empty text as nothing between the marks; marks inside a text
are broken by a space; rows without a conv_id belong to no conversation and are left out; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm.common import Scratch, table

START, END, NO_ROLE = "<|im_start|>", "<|im_end|>", "unknown"
SEEDS = (42, 4242)


def ordered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its distinct ``turns`` in order."""
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(NO_ROLE)).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    t = conversations.select(F.col(id_col).alias("conv_id"), turn.alias("turn")).where(F.col("conv_id").isNotNull())
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("turns"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """For each conversation (of n turns) and each k: the rolling hash (h1, h2) of its first k turns."""
    digests = F.transform("turns", lambda x, i: F.struct(*[F.xxhash64(F.lit(s), i, F.length(x["role"]), x["role"], x["text"]).alias(f"h{j}") for j, s in enumerate(SEEDS, 1)]))
    p = turns.select("conv_id", F.size("turns").alias("n"), F.posexplode(digests).alias("k", "d"))
    upto = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return p.select("conv_id", "n", (F.col("k") + 1).alias("k"), F.bit_xor("d.h1").over(upto).alias("h1"), F.bit_xor("d.h2").over(upto).alias("h2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """The ids of conversations that are no proper prefix of another; of equal ones the smallest."""
    whole = hashes.where("k = n").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = hashes.where("k < n").select("k", "h1", "h2").distinct()
    return whole.join(proper, ["k", "h1", "h2"], "left_anti").select("conv_id")


def rendered(turns: str, start: str = START, end: str = END) -> Column:
    """The chat template: start mark, role, line break, text, end mark, line break."""
    clean = lambda c: F.replace(F.replace(c, F.lit(start), F.lit(start[:1] + " " + start[1:])), F.lit(end), F.lit(end[:1] + " " + end[1:]))
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(start), clean(x["role"]), F.lit("\n"), clean(x["text"]), F.lit(end + "\n"))), "")


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_chars and the rendered text."""
    scratch = scratch or Scratch(conversations.sparkSession, "chat")
    names = (id_col, turn_col, role_col, text_col)
    hashes = scratch.cut(prefix_hashes(ordered(conversations, *names)), "prefixes")
    kept = maximal(hashes).withColumnRenamed("conv_id", "kept_id")
    left = conversations.select(*names)
    left = left.join(kept, left[id_col] == kept["kept_id"], "left_semi")
    out = ordered(left, *names).select("conv_id", F.size("turns").alias("n_turns"), rendered("turns").alias("text"))
    return out.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), "text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
proper AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id FROM c WHERE turns NOT IN (SELECT turns FROM proper) GROUP BY turns),
r AS (SELECT conv_id, len(turns) AS n_turns, array_to_string([concat('<|im_start|>', replace(replace(x.role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), chr(10),
  replace(replace(x.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), '<|im_end|>', chr(10)) FOR x IN turns], '') AS text FROM c WHERE conv_id IN (SELECT conv_id FROM kept))
SELECT conv_id, CAST(n_turns AS INTEGER) AS n_turns, CAST(length(text) AS BIGINT) AS n_chars, text FROM r
"""
QUERIES = {"op8_chat_format": op8_chat_format}
ORACLE_SQL = {"op8_chat_format": SQL}
