"""Chat formatting after a cumulative-snapshot collapse.

Loggers often store a conversation again after each turn, so that one log row set is a prefix of a longer one.  A
rolling hash marks every turn prefix: the XOR of a hash of (position, role, text) over the turns so far, two
independent 64-bit ones, built by a window function over narrow rows (the text itself isn't sorted).  Equal
conversations keep the smallest conv_id; a conversation whose whole hash is a proper prefix of another one is dropped
by an anti-join; the others are rendered.  Only DataFrame functions are used.

Turns are in the order of turn, role and text hash.

Defined results: null roles and texts count as empty; null turns come first; rows without conv_id form a
conversation of their own; repeated rows are turns of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no proper prefix of another and no later copy of one."""
    turns = _turns(conversations).select("conv_id", "turn", "role", F.xxhash64("text", F.lit(1)).alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "t1", "t2")
    numbered = turns.select("*", F.row_number().over(order).alias("i"), F.lead(F.lit(1)).over(order).isNull().alias("whole"))
    sofar = order.rowsBetween(W.unboundedPreceding, 0)
    prefixes = numbered.select("conv_id", "i", "whole", F.bit_xor(F.xxhash64("i", "role", "t1")).over(sofar).alias("p1"), F.bit_xor(F.xxhash64("t2", "role", "i")).over(sofar).alias("p2"))
    prefixes = common.materialize(prefixes, "chat-prefixes")
    key = ["i", "p1", "p2"]
    whole = prefixes.filter("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.filter("not whole").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("i").cast("long").alias("n_turns"))


def render(conversations: DataFrame, header: str = "<|{role}|>\n", footer: str = "<|end|>\n") -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations: each turn as header, text and footer."""
    before, after = header.split("{role}")
    turns = _turns(conversations)
    piece = F.struct("turn", "role", F.xxhash64("text", F.lit(1)).alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"), "text")
    kept = maximal(conversations)
    own = turns.join(kept.select(F.col("conv_id").alias("kept_id"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("kept_id")))
    grouped = own.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(footer)))
    return grouped.select("conv_id", "n_turns", F.array_join(shown, "").alias("rendered"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the rendered maximal conversations."""
    return render(common.table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations
), p AS (
  SELECT conv_id, i, md5(string_agg(md5(role) || md5(text), ' ') OVER (PARTITION BY conv_id ORDER BY i)) AS h,
         i = count(*) OVER (PARTITION BY conv_id) AS whole
  FROM t
), w AS (
  SELECT i, h, min(conv_id) AS conv_id FROM p WHERE whole GROUP BY i, h
), kept AS (
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT p.whole AND p.i = w.i AND p.h = w.h)
)
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY t.i) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
