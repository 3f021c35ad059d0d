"""Preference formatting of conversations: a common prompt, two completions and their loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonflow.llm.common import cut
from photonflow.llm.ordered import with_guards


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order; nulls are empty, equal numbers go by role and text."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with equal roles and texts."""
    same = F.zip_with(a, b, lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def mask(turns: Column) -> Column:
    """``start-stop`` character spans, comma-separated, of what an assistant says in the rendering, end mark included."""
    text = lambda t: F.concat(t["text"], F.lit("<|end|>\n"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        stop = acc["at"] + F.length(_turn(t))
        span = F.concat((stop - F.length(text(t))).cast("string"), F.lit("-"), stop.cast("string"))
        return F.struct(stop.alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, add)["spans"], ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs(chosen_id, rejected_id, chosen, rejected)`` with arrays of turns -> prompt and masked completions.

    The longest common prefix of turns is rendered once as ``prompt``; what is left of each
    conversation is its completion. Equal conversations leave two empty completions; without a
    common turn the prompt is empty.
    """
    n = pairs.withColumn("n_prompt", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_prompt") + 1, F.greatest(F.size(c) - F.col("n_prompt"), F.lit(0)))
    return n.select(
        "chosen_id", "rejected_id", "n_prompt", render(F.slice("chosen", 1, F.col("n_prompt"))).alias("prompt"),
        render(rest("chosen")).alias("chosen"), render(rest("rejected")).alias("rejected"), mask(rest("chosen")).alias("chosen_mask"), mask(rest("rejected")).alias("rejected_mask"),
    )


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Each conversation up to its last reply as chosen; as rejected the same with the next conversation's last reply in its place.

    A reply is an assistant's turn, or the last turn of a conversation that has none. Conversations follow each other
    by id, a null id (one conversation) last; the last is followed by the first, and a single one by itself.
    """
    whole = cut(conversations(turns), "conversations")
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    ended = whole.withColumn("turns", F.slice("turns", 1, F.coalesce(last, F.size("turns"))))
    key = F.coalesce(F.hex(F.col("conv_id").bitwiseXOR(F.lit(-(1 << 63)))), F.lit("~"))
    keyed = ended.withColumns({"key": F.when(F.col("conv_id").isNull(), key).otherwise(F.lpad(key, 16, "0")), "reply": F.element_at("turns", -1)})
    following = W.partitionBy("_run").orderBy("_guard", "key")
    nexts = with_guards(keyed, "key", []).withColumn("next", F.lead(F.struct("conv_id", "reply")).over(following)).where("not _guard")
    rejected = F.concat(F.slice("turns", 1, F.size("turns") - 1), F.array("next.reply"))
    return nexts.select(F.col("conv_id").alias("chosen_id"), F.col("next.conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op3(turns: DataFrame) -> DataFrame:
    """One row per conversation: its id and that of the rejected reply, number of common turns, prompt, completions and masks.

    Rows that repeat a turn are turns of their own. Two equal replies leave two empty completions. An empty table gives no rows.
    """
    return format_pairs(reply_pairs(turns))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations),
c AS (SELECT conv_id, list(struct_pack(role := role, txt := txt) ORDER BY turn, role, txt) AS turns FROM t GROUP BY conv_id),
o AS (SELECT conv_id, turns[1:coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), len(turns))] AS turns FROM c),
f AS (SELECT conv_id AS chosen_id, turns AS a,
         CASE WHEN count(*) OVER w2 = count(*) OVER () THEN first_value(conv_id) OVER w ELSE lead(conv_id) OVER w END AS rejected_id,
         coalesce(lead(turns[-1]) OVER w, first_value(turns[-1]) OVER w) AS reply
  FROM o WINDOW w AS (ORDER BY conv_id NULLS LAST), w2 AS (ORDER BY conv_id NULLS LAST ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, list_concat(a[1:len(a) - 1], [reply]) AS b FROM f),
n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n_prompt FROM p),
r AS (SELECT *, a[1:n_prompt] AS pre, a[n_prompt + 1:] AS ra, b[n_prompt + 1:] AS rb FROM n),
s AS (
  SELECT *, list_transform(ra, lambda t: '<|' || t.role || '|>' || chr(10) || t.txt || '<|end|>' || chr(10)) AS ta,
         list_transform(rb, lambda t: '<|' || t.role || '|>' || chr(10) || t.txt || '<|end|>' || chr(10)) AS tb
  FROM r
)
SELECT chosen_id, rejected_id, CAST(n_prompt AS INTEGER) AS n_prompt,
  coalesce(array_to_string(list_transform(pre, lambda t: '<|' || t.role || '|>' || chr(10) || t.txt || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(ta, ''), '') AS chosen, coalesce(array_to_string(tb, ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ra) + 1), lambda i: ra[i].role = 'assistant'),
    lambda i: (length(array_to_string(ta[1:i], '')) - length(ra[i].txt) - 8) || '-' || length(array_to_string(ta[1:i], ''))), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(rb) + 1), lambda i: rb[i].role = 'assistant'),
    lambda i: (length(array_to_string(tb[1:i], '')) - length(rb[i].txt) - 8) || '-' || length(array_to_string(tb[1:i], ''))), ','), '') AS rejected_mask
FROM s
"""
