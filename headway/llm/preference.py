"""Preference formatting: paired completions after the longest common turn prefix of a chosen and a rejected conversation.

Turns are equal if role and text are. The common prefix is rendered once as the prompt; what follows in either conversation
is its completion, a list of segments that alternate between a turn's header, never trained on, and its body, trained on
where the assistant speaks. Everything is DataFrame functions; the rows of a pair meet in one aggregation, and a pair is as
large as its two conversations, which are rendered as texts anyway.

Defined results: turns stand in the order of turn, role, text with nulls first, repeated rows each as a turn; a null role
or text renders as nothing and equals only null; identical conversations give two empty completions; of a pair without one
side the other is rendered whole and the missing side's id is null; turns without conv_id belong to no pair and are left
out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINED = "assistant"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def segments(turns: Column) -> Column:
    """(text, train) of header and body of each turn."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(header(t).alias("text"), F.lit(False).alias("train")),
                F.struct(body(t).alias("text"), F.coalesce(t["role"] == TRAINED, F.lit(False)).alias("train")),
            ),
        )
    )


def pairs(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, chosen (boolean), conv_id, turn, role, text. One row per pair with prompt and both completions' segments."""
    one = F.struct("turn", "role", "text")
    side = turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(
        F.min(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(F.col("chosen"), one))).alias("good"),
        F.sort_array(F.collect_list(F.when(~F.col("chosen"), one))).alias("bad"),
    )
    same = F.zip_with("good", "bad", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    side = side.withColumn("n_common", F.when(first == 0, F.size("good")).otherwise(first - 1).cast("int"))
    rest = {c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0))) for c in ("good", "bad")}
    return side.select(
        "pair_id", "chosen_id", "rejected_id", "n_common",
        rendered(F.slice("good", F.lit(1), F.col("n_common"))).alias("prompt"),
        segments(rest["good"]).alias("chosen"),
        segments(rest["bad"]).alias("rejected"),
    )


def text_of(completion: str) -> Column:
    return F.array_join(F.transform(completion, lambda s: s["text"]), "")


def mask_of(completion: str) -> Column:
    """Characters and flag of every segment, in order."""
    return F.array_join(F.transform(completion, lambda s: F.concat_ws(":", F.length(s["text"]), s["train"].cast("int"))), ",")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) of the table are a pair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.withColumns({"pair_id": F.floor(F.col("conv_id") / 2), "chosen": F.pmod("conv_id", F.lit(2)) == 0})
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return pairs(turns).select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"),
        sha(F.col("prompt")).alias("prompt_sha256"),
        sha(text_of("chosen")).alias("chosen_sha256"), mask_of("chosen").alias("chosen_mask"),
        sha(text_of("rejected")).alias("rejected_sha256"), mask_of("rejected").alias("rejected_mask"),
    )


OP6_SQL = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id, conv_id % 2 AS side, role, text,
         '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || chr(10) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT * FROM t WHERE side = 0), b AS (SELECT * FROM t WHERE side <> 0),
f AS (
  SELECT coalesce(g.pair_id, b.pair_id) AS pair_id, count(g.k) AS n_good,
         min(CASE WHEN g.k IS NULL OR b.k IS NULL OR g.role IS DISTINCT FROM b.role OR g.text IS DISTINCT FROM b.text
             THEN coalesce(g.k, b.k) END) AS first_off, min(g.conv_id) AS chosen_id, min(b.conv_id) AS rejected_id
  FROM g FULL JOIN b ON g.pair_id = b.pair_id AND g.k = b.k GROUP BY 1),
n AS (SELECT pair_id, chosen_id, rejected_id, CAST(coalesce(first_off - 1, n_good) AS BIGINT) AS n_common FROM f),
r AS (
  SELECT n.pair_id, n_common, chosen_id, rejected_id, side, k, head, body, k <= n_common AS common,
         length(head) || ':0,' || length(body) || ':' || CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask
  FROM n JOIN t USING (pair_id))
SELECT pair_id, chosen_id, rejected_id, n_common,
       sha256(coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE common AND side = 0), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE NOT common AND side = 0), '')) AS chosen_sha256,
       coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE NOT common AND side = 0), '') AS chosen_mask,
       sha256(coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE NOT common AND side <> 0), '')) AS rejected_sha256,
       coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE NOT common AND side <> 0), '') AS rejected_mask
FROM r GROUP BY 1, 2, 3, 4
"""
