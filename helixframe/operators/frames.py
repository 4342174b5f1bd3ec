"""Frame plumbing: projections, position joins, overwrites, unions, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the named columns in the given order."""
    return df.select(*cols)


def keep_correct(df: DataFrame, y: str = "y", y_orig: str = "y_orig") -> DataFrame:
    """Rows the model originally got right."""
    return df.where(F.col(y) == F.col(y_orig))


def copy_column(target: DataFrame, source: DataFrame, col: str, key: str = "row_id") -> DataFrame:
    """Take ``col`` from an aligned table by row position (``key``); missing -> null."""
    return target.drop(col).join(source.select(key, col), key, "left")


def align(*frames: DataFrame, key: str = "row_id") -> DataFrame:
    """Inner join on the position key (``zip`` stops at the shortest)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "inner")
    return out


def overwrite(base: DataFrame, patch: DataFrame, key: str = "row_id",
              cols: list[str] | None = None) -> DataFrame:
    """Rows (or the listed cells) of ``patch`` replace those of ``base`` with the same key.

    A flag column tells a patched null from an absent patch.
    """
    cols = cols or [c for c in patch.columns if c != key]
    p = patch.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    j = base.join(p, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in base.columns])


def append_rows(base: DataFrame, extra: DataFrame | None, order: str = "row_id",
                aug_order: str | None = None) -> DataFrame:
    """Bag union by column name (missing columns -> null); the extra rows come after the base
    rows: their ``order`` is offset past the base's maximum (a one-row aggregate, broadcast). P9: an
    augmentation that is switched off (``None``) leaves the base as it is."""
    if extra is None:
        return base
    top = base.agg(F.max(order).alias("_top"))
    aug_key = aug_order or order
    e = extra.crossJoin(F.broadcast(top)).withColumn(order, F.col("_top") + 1 + F.col(aug_key))
    e = e.drop("_top", *([aug_key] if aug_key != order else []))
    return base.unionByName(e, allowMissingColumns=True)


def row_counts(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``count(*)`` (per group)."""
    return df.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"))
