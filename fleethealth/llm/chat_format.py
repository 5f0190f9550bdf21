"""Preference formatting of chosen and rejected conversations.

Method. Turns of a side are put in order once; the longest common turn prefix of both sides is
rendered once as the prompt, the rest of each side as its completion. A completion's mask lists
the character spans that are trained on: assistant turns with their end mark.

Defined results: a null role or text counts as empty; turns with the same number are ordered by
role and text, and repeated turns stay; a missing side is an empty conversation; a null pair key is
a pair of its own, and rows with a null conversation id are one conversation; a conversation is one row, so very
long texts and conversations are kept whole in it; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rendering of one turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turn_array(rows: DataFrame, key: str) -> DataFrame:
    """key, turns: each conversation's turns in order, as an array of (role, text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(F.col(key).cast("long").alias(key)).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns that both arrays start with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def spans(turns: Column) -> Column:
    """(start, length) in characters of what is trained on in the rendered turns."""
    head = lambda t: F.length(t["role"]) + len(OPEN + MIDDLE)
    body = lambda t: F.length(t["text"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, t: F.struct((a["at"] + head(t) + body(t)).alias("at"), F.when(t["role"] == "assistant", F.array_append(a["spans"], F.struct((a["at"] + head(t)).alias("start"), body(t).alias("length")))).otherwise(a["spans"]).alias("spans"))
    return F.aggregate(turns, start, step)["spans"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """prompt, n_prompt_turns, chosen, chosen_spans, rejected, rejected_spans of each row.

    ``pairs`` has a key column ``pair_id`` and turn arrays ``chosen`` and ``rejected``."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    both = both.withColumn("p", common_prefix(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(F.col(c), F.col("p") + 1, F.greatest(F.size(c) - F.col("p"), F.lit(0)))
    cut = both.select("pair_id", F.col("p").alias("n_prompt_turns"), F.slice("c", 1, F.col("p")).alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select("pair_id", "n_prompt_turns", render(F.col("prompt")).alias("prompt"), render(F.col("c")).alias("chosen"), spans(F.col("c")).alias("chosen_spans"), render(F.col("r")).alias("rejected"), spans(F.col("r")).alias("rejected_spans"))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: neighbours 2k and 2k+1 lend each other their last answer.

    A conversation is the chosen side of its own pair. Its rejected side keeps the turns before its
    last assistant turn and ends with the neighbour's; without a neighbour that answers, it just
    stops there. Conversations without an answer are rejected from their first turn on."""
    turns = turn_array(conversations, "conv_id")
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == "assistant")), True).cast("int") + 1
    found = F.exists("turns", lambda t: t["role"] == "assistant")
    cut = turns.select("conv_id", "turns", F.when(found, F.slice("turns", 1, last - 1)).otherwise(F.slice("turns", 1, 0)).alias("head"), F.when(found, F.slice("turns", last, 1)).alias("answer"))
    own = cut.withColumn("mate", F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1))
    other = cut.select(F.col("conv_id").alias("mate"), F.col("answer").alias("theirs"))
    none = F.slice("head", 1, 0)
    return own.join(other, "mate", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat("head", F.coalesce("theirs", none)).alias("rejected"))


def span_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")


SQL = """
WITH t AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations GROUP BY conv_id),
p AS (SELECT *, len(turns) - coalesce(nullif(list_position(list_transform(list_reverse(turns), lambda x: x.role = 'assistant'), true), 0), NULL) + 1 AS last FROM t),
c AS (SELECT conv_id, turns, CASE WHEN last IS NULL THEN turns[1:0] ELSE turns[1:last - 1] END AS head, CASE WHEN last IS NULL THEN turns[1:0] ELSE turns[last:last] END AS answer FROM p),
j AS (SELECT a.conv_id AS pair_id, a.turns AS chosen, list_concat(a.head, coalesce(b.answer, a.turns[1:0])) AS rejected FROM c a LEFT JOIN c b ON b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END),
k AS (SELECT *, coalesce((SELECT min(i) - 1 FROM generate_series(1, greatest(len(chosen), len(rejected))::BIGINT) AS g(i) WHERE chosen[i] IS DISTINCT FROM rejected[i]), len(chosen)) AS n FROM j),
s AS (SELECT pair_id, n::INTEGER AS n_prompt_turns, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM k)
SELECT pair_id, n_prompt_turns,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_filter(list_transform(c, lambda t, i: CASE WHEN t.role = 'assistant' THEN
    (coalesce(list_sum(list_transform(c[1:i - 1], lambda u: length(u.role) + length(u.text) + 13)), 0) + length(t.role) + 5)::BIGINT || ':' || (length(t.text) + 8) END), lambda x: x IS NOT NULL), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_filter(list_transform(r, lambda t, i: CASE WHEN t.role = 'assistant' THEN
    (coalesce(list_sum(list_transform(r[1:i - 1], lambda u: length(u.role) + length(u.text) + 13)), 0) + length(t.role) + 5)::BIGINT || ':' || (length(t.text) + 8) END), lambda x: x IS NOT NULL), ','), '') AS rejected_spans
FROM s
"""
