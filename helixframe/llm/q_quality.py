"""op5: quality of every document, learned from four fifths of the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality
from .common import table
from .registry import register


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@register("op5_quality")
def op5_quality(spark, sf_dir):
    """doc_id, whether its label was held out from learning, score and decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    model = quality.learn(docs, labels)
    got = quality.score(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "score", "predicted")
