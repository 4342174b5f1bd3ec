"""op4: language of every document, learned from three quarters of the labelled ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language
from .common import table
from .registry import register


@register("op4_language")
def op4_language(spark, sf_dir):
    """doc_id, whether it was held out from learning, predicted language and its share of the letters."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = language.learn(docs.where(~F.col("held_out")))
    got = language.identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", "score")
