"""K6: padding to the longest sequence of a batch, without a global row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PAD


def batch_of(df: DataFrame, row_id: str = "row_id", size: int = 32) -> DataFrame:
    """Append ``batch``: the rows whose ids lie in one range of ``size``.

    Row ids number the rows of a split, so this is the loader's batch; where ids have gaps a batch is smaller, never
    larger. It depends on the row alone, so no order over all rows is made."""
    return df.withColumn("batch", F.floor(F.col(row_id) / F.lit(size)).cast("bigint"))


def pad_batches(df: DataFrame, ids: str = "ids", row_id: str = "row_id", size: int = 32) -> DataFrame:
    """Replace ``ids`` by the list padded to its batch's longest, and append ``batch``, ``longest`` and
    ``attention_mask``. Lengths alone are aggregated (one row a batch); the lists move once, to their batch's length."""
    rows = batch_of(df, row_id, size)
    longest = rows.groupBy("batch").agg(F.max(F.size(ids)).alias("longest"))
    j = rows.join(longest, "batch")
    fill = F.col("longest") - F.size(ids)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill))
    return j.withColumn("attention_mask", mask).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(PAD), fill))).select(
        *df.columns, "batch", "longest", "attention_mask")
