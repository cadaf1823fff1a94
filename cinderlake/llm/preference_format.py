"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once, as the prompt. What each side goes on with is a
completion with its mask: the spans of characters that a loss may count, those of assistant replies and
their closing marks. All of it is array functions on one row a pair; a pair's turns meet by its key and
nothing else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id_col, turns array<struct<role, text>> in the order of turn, then role and text; nulls come first.

    A null role or text is empty. Repeated turns are kept. Rows with a null id belong to no conversation
    that could be told: each is one of its own. Other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    whole = F.sort_array(F.collect_list(one))
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    told = turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.transform(whole, plain).alias("turns"))
    alone = turns.filter(F.col(id_col).isNull()).select(F.col(id_col), F.array(plain(one)).alias("turns"))
    return told.unionByName(alone)


def with_stale_reply(convs: DataFrame) -> DataFrame:
    """convs with chosen (turns) and rejected: the same turns, but the last reply is the one before it.

    A conversation with one reply is rejected with an empty one; without replies both sides are equal.
    """
    place = F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED_ROLE, i + 1))
    places = F.filter(place, lambda p: p.isNotNull())
    convs = convs.withColumn("replies", places)
    last, stale = F.get("replies", F.size("replies") - 1), F.get("replies", F.size("replies") - 2)
    text = F.coalesce(F.get("turns", stale - 1)["text"], F.lit(""))
    swapped = F.transform("turns", lambda t, i: F.when(i + 1 == last, F.struct(t["role"].alias("role"), text.alias("text"))).otherwise(t))
    return convs.withColumns({"chosen": F.col("turns"), "rejected": swapped}).drop("replies")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """The number of turns that both begin with: equal roles and texts."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _plain(text: Column) -> Column:
    """text in which no mark of a turn is left to read."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit(CLOSE + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """[start, end) in code points of each learned body within the rendered turns."""
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == LEARNED_ROLE).alias("learned"), F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body")))
    span = lambda a, x: F.struct((a["at"] + x["head"]).alias("start"), (a["at"] + x["head"] + x["body"]).alias("end"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, x: F.struct((a["at"] + x["head"] + x["body"]).alias("at"), F.when(x["learned"], F.concat(a["spans"], F.array(span(a, x)))).otherwise(a["spans"]).alias("spans"))
    return F.aggregate(sizes, start, step, lambda a: a["spans"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """pairs with n_prompt_turns, prompt, and for each side its completion and mask spans.

    chosen_col and rejected_col are array<struct<role, text>>. Adds chosen_completion,
    rejected_completion, and chosen_mask and rejected_mask, array<struct<start, end>> in code points of
    the completion. Equal sides have all turns as prompt and empty completions, sides that differ from
    the first turn an empty prompt. A null side counts as no turns. Marks of turns inside a text are
    broken, so that a text cannot forge a turn. Columns of these names are replaced.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = {"__chosen": F.coalesce(F.col(chosen_col), none), "__rejected": F.coalesce(F.col(rejected_col), none)}
    out = pairs.withColumns(sides).withColumn("n_prompt_turns", common_turns(F.col("__chosen"), F.col("__rejected")))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    out = out.withColumns({"prompt": _rendered(F.slice("__chosen", 1, F.col("n_prompt_turns"))), "__chosen": rest("__chosen"), "__rejected": rest("__rejected")})
    out = out.withColumns({"chosen_completion": _rendered(F.col("__chosen")), "chosen_mask": _spans(F.col("__chosen")), "rejected_completion": _rendered(F.col("__rejected")), "rejected_mask": _spans(F.col("__rejected"))})
    return out.drop("__chosen", "__rejected")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the whole table conversations. Null ids, roles and texts as in conversations; see format_preferences."""
    out = format_preferences(with_stale_reply(conversations(read_table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


def _side(name: str) -> str:
    return f"""
  SELECT conv_id,
    coalesce(string_agg(head || {name}_body, '' ORDER BY k) FILTER (WHERE k > n_prompt), '') AS {name}_completion,
    coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length({name}_body))::VARCHAR, ',' ORDER BY k)
             FILTER (WHERE k > n_prompt AND role = 'assistant'), '') AS {name}_mask
  FROM (SELECT *, coalesce(sum(CASE WHEN k > n_prompt THEN length(head) + length({name}_body) END) OVER
                           (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM sized) GROUP BY conv_id"""


_BROKEN = "replace(replace({}, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')"
OP2_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations
), replies AS (
  SELECT conv_id, max(k) AS last, max(k) FILTER (WHERE k < m) AS stale
  FROM (SELECT *, max(k) OVER (PARTITION BY conv_id) AS m FROM turns WHERE role = 'assistant') GROUP BY conv_id
), sides AS (
  SELECT t.conv_id, t.k, t.role, t.text AS chosen,
         CASE WHEN t.k = r.last THEN coalesce(s.text, '') ELSE t.text END AS rejected
  FROM turns t LEFT JOIN replies r ON r.conv_id = t.conv_id LEFT JOIN turns s ON s.conv_id = t.conv_id AND s.k = r.stale
), cut AS (
  SELECT *, coalesce(min(CASE WHEN chosen <> rejected THEN k - 1 END) OVER c, count(*) OVER c) AS n_prompt
  FROM sides WINDOW c AS (PARTITION BY conv_id)
), sized AS (
  SELECT conv_id, k, n_prompt, role, '<|im_start|>' || {_BROKEN.format("role")} || chr(10) AS head,
         {_BROKEN.format("chosen")} || '<|im_end|>' || chr(10) AS chosen_body,
         {_BROKEN.format("rejected")} || '<|im_end|>' || chr(10) AS rejected_body
  FROM cut
), prompts AS (
  SELECT conv_id, any_value(n_prompt)::INT AS n_prompt_turns,
         coalesce(string_agg(head || chosen_body, '' ORDER BY k) FILTER (WHERE k <= n_prompt), '') AS prompt
  FROM sized GROUP BY conv_id
), c AS ({_side("chosen")}
), r AS ({_side("rejected")}
)
SELECT conv_id, n_prompt_turns, prompt, chosen_completion, rejected_completion, chosen_mask, rejected_mask
FROM prompts JOIN c USING (conv_id) JOIN r USING (conv_id)
"""
