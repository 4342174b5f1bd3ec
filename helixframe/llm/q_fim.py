"""op13: every document cut between lines and put in fill-in-the-middle order, then restored."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fim
from .common import table
from .registry import register

SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS lines,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS i,
  greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS j FROM u),
p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, array_to_string(lines[1:i], '') AS pre,
  array_to_string(lines[i + 1:j], '') AS mid, array_to_string(lines[j + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@register("op13_fim", SQL)
def op13_fim(spark, sf_dir):
    """Per document: lines, form, lengths, digest of the output and of the text rebuilt from it."""
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                       F.sha2(F.encode(fim.restore(), "UTF-8"), 256).alias("restored_sha256"))
