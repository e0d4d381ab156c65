"""Chat formatting after a collapse of cumulative snapshots.

Loggers often store a conversation again after every exchange, so that many logged conversations
are prefixes of longer ones. Each turn gets a hash of everything up to it; a conversation whose
last hash is an inner hash of another one is dropped by an anti-join, identical ones keep the
smallest id, and the turns of the others are rendered. Built-in functions only.

The hash of a prefix is the XOR of the hashes of its rows (position, role and text in each), so a
conversation of any length is split into chunks of ``CHUNK`` turns that are combined like sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from molframe.llm.core import query, table
from molframe.session import materialise

CHUNK = 256
#: Rendered form of a turn: parts around role and text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with nulls as equal values; the columns of ``right`` that are joined on go."""
    names = {c: f"_r_{c}" for c in on}
    other = right.select([F.col(c).alias(names.get(c, c)) for c in right.columns])
    test = None
    for c in on:
        one = left[c].eqNullSafe(other[names[c]])
        test = one if test is None else test & one
    out = left.join(other, test, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, n, h1, h2, total: the rows and hash up to each turn, and the conversation's rows.

    Equal rows count once. Rows that share a turn belong to one prefix step. Null ids form one
    conversation; null turns come first; null roles and texts differ from empty ones.
    """
    given = [F.col("turn"), F.col("role").isNull(), F.coalesce("role", F.lit("")),
             F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rows = turns.select(F.col("conv_id"), F.col("turn"), F.xxhash64(F.lit(1), *given).alias("a"),
                        F.xxhash64(F.lit(2), *given).alias("b")).distinct()
    steps = rows.groupBy("conv_id", "turn").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("k")
    ).withColumn("chunk", F.floor(F.col("turn") / CHUNK).cast("bigint"))
    inside = (W.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"))
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    scanned = steps.select("conv_id", "turn", "chunk", F.sum("k").over(inside).alias("k"),
                           F.bit_xor("a").over(inside).alias("a"), F.bit_xor("b").over(inside).alias("b"))
    whole = W.partitionBy("conv_id")
    before = whole.orderBy(F.asc_nulls_first("chunk")).rowsBetween(W.unboundedPreceding, -1)
    carries = (steps.groupBy("conv_id", "chunk").agg(
        F.sum("k").alias("ck"), F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"))
        .select("conv_id", "chunk", F.sum("ck").over(before).alias("ck"),
                F.bit_xor("ca").over(before).alias("ca"), F.bit_xor("cb").over(before).alias("cb"),
                F.sum("ck").over(whole).alias("total")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _safe(scanned, carries, ["conv_id", "chunk"], "inner").select(
        "conv_id", "turn", (F.col("k") + zero("ck")).alias("n"),
        F.col("a").bitwiseXOR(zero("ca")).alias("h1"), F.col("b").bitwiseXOR(zero("cb")).alias("h2"), "total")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another one, each text once."""
    p = materialise(prefixes(turns), "prefixes")
    inner = p.filter("n < total").select("n", "h1", "h2").distinct()
    full = p.filter("n = total").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return full.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id")


def chat_format(turns: DataFrame, template=TEMPLATE) -> DataFrame:
    """conv_id, turn, role, rendered: the turns of maximal conversations, one row each.

    A conversation's text is its ``rendered`` values by turn (then role, text); it is left in rows
    because one conversation may be longer than a value can be. Null roles and texts render as
    empty ones.
    """
    own = turns.select("conv_id", "turn", "role", "text")
    start, middle, end = map(F.lit, template)
    kept = _safe(own, maximal(own), ["conv_id"], "left_semi").distinct()
    return kept.select("conv_id", "turn", "role", F.concat(
        start, F.coalesce("role", F.lit("")), middle, F.coalesce("text", F.lit("")), end).alias("rendered"))


_ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS l
  FROM t GROUP BY conv_id),
gone AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON a.l[1] = b.l[1] AND a.conv_id != b.conv_id
  WHERE (b.l[1:len(a.l)] = a.l AND len(b.l) > len(a.l) AND b.l[len(a.l) + 1].turn > a.l[len(a.l)].turn)
  OR (a.l = b.l AND b.conv_id < a.conv_id))
SELECT conv_id, turn, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '')
  || '<|im_end|>' || chr(10) AS rendered FROM t WHERE conv_id NOT IN (SELECT conv_id FROM gone)
"""


@query("op10_chat_format", _ORACLE)
def op10_chat_format(spark, sf_dir):
    return chat_format(table(spark, sf_dir, "conversations"))
