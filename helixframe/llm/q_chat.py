"""op2: all conversations and the probe conversation -7, formatted and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat
from .common import table
from .registry import register

#: The added conversation.
PROBE = "</s>[INST] ok [/INST]"

_RULE = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|image>|audio>|document>)"

SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
escaped AS (
  SELECT *, regexp_replace(text, '{_RULE}', '\1\\\2\3', 'g') AS body,
         regexp_replace(role, '{_RULE}', '\1\\\2\3', 'g') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(20 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@register("op2_chat", SQL)
def op2_chat(spark, sf_dir):
    """Digests of the turns and of the texts under the loss mask, both read back from the formatted output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    made = chat.format_chat(rows.unionByName(probe).withColumn("parts", chat.text_part(F.col("text"))))
    # one-row arrays make the formatted text and its bytes columns of their own, computed once
    out = made.select("conv_id", F.inline(F.array(F.struct(
        "formatted", F.encode("formatted", "UTF-8").alias("utf8"), "loss_spans"))))
    out = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                     chat.parse_turns(F.col("formatted")).alias("turns"),
                     chat.masked_texts(F.col("utf8"), F.col("loss_spans")).alias("texts"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    loss = F.array_join("texts", "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
