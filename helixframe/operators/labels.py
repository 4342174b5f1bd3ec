"""Label dictionaries, encoders, class weights and metadata predicates.

Dictionaries are built from *distinct* labels, so the only global (one-task)
step - numbering the labels - runs over a handful of rows, never fact rows.
Position semantics of the reference (first appearance, last wins) become
``min`` / ``max_by`` over an explicit ``row_id``.

Joins with a dictionary carry no hint: the planner broadcasts it if the size it
knows is below ``spark.sql.autoBroadcastJoinThreshold`` (written dictionaries
have a known size), and joins by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import materialize

SENTINEL = "not applicable"  # fixed value


def ids_by_first_appearance(df: DataFrame, label: str, order: str = "row_id",
                            id_col: str = "id") -> DataFrame:
    """L1: ``{label: i for i, label in enumerate(unique())}`` -> ``(label, id)``; a null label is a label."""
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    w = Window.orderBy("_first")  # distinct labels only
    return first.select(label, (F.row_number().over(w) - 1).cast("int").alias(id_col))


def pair_dictionary(df: DataFrame, label: str, name: str, order: str = "row_id") -> DataFrame:
    """L2: dictionary from existing ``(label, name)`` pairs -> ``(name, label)``.

    Distinct pairs keep their first row; per label the pair seen last wins; the
    label order is its first appearance; inverting, per name the label that
    comes last in that order wins.
    """
    pairs = df.groupBy(label, name).agg(F.min(order).alias("_first"))
    per_label = pairs.groupBy(label).agg(
        F.max_by(name, "_first").alias(name), F.min("_first").alias("_label_first"))
    return per_label.groupBy(name).agg(F.max_by(label, "_label_first").alias(label))


def inverse(dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """L3: a one-to-one dictionary read the other way: ``(value, key)``."""
    return dictionary.select(value, key)


def encode_strict(df: DataFrame, dictionary: DataFrame, name: str, id_col: str = "id",
                  out: str = "y") -> DataFrame:
    """Name -> id; an unknown name raises (like a missing dictionary key)."""
    d = dictionary.select(F.col(name).alias("_k"), F.col(id_col).alias("_id"), F.lit(True).alias("_known"))
    j = df.join(d, df[name].eqNullSafe(F.col("_k")), "left")
    checked = F.when(F.col("_known").isNull(),
                     F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(name).cast("string"),
                                                                                F.lit("null"))))
                     ).otherwise(F.col("_id"))
    # a filter on the same test, so that the error does not depend on whether ``out`` is read
    j = j.where(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(
        F.col(name).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True)))
    return j.withColumn(out, checked.cast("int")).drop("_k", "_id", "_known")


def encode_lenient(df: DataFrame, dictionary: DataFrame, name: str, id_col: str = "id",
                   out: str = "y") -> DataFrame:
    """Name -> id; an unknown name gives null."""
    d = dictionary.select(F.col(name).alias("_k"), F.col(id_col).alias(out))
    return df.join(d, df[name] == F.col("_k"), "left").drop("_k")


def decode(df: DataFrame, dictionary: DataFrame, name: str, id_col: str = "id",
           cols: tuple[str, ...] = ("y", "y_hat"), suffix: str = "_name") -> DataFrame:
    """Id -> name for each listed column (one join per column on the same small dimension)."""
    for c in cols:
        d = dictionary.select(F.col(id_col).alias(f"_{c}_id"), F.col(name).alias(f"{c}{suffix}"))
        df = df.join(d, df[c] == F.col(f"_{c}_id"), "left").drop(f"_{c}_id")
    return df


def text_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """The string-typed columns, from the schema alone (no data scan)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def label_encode(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """L4: each text column -> its code in sorted order of the distinct values; missing -> ``'nan'``.

    Spark's string order is code-point order, as in the reference's sorter.
    With an empty ``suffix`` the code replaces the column.
    """
    out = df
    for c in cols:
        filled = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        codes = numbered(df.select(filled.alias("_v")).distinct(), [F.col("_v")], "_code")
        out = out.withColumn("_v", filled).join(codes, "_v", "left").drop("_v")
        if not suffix:
            out = out.drop(c)
        out = out.withColumnRenamed("_code", c + suffix)
    return out


def numbered(values: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Append each row's 0-based rank in ``order``, without a one-task window: range partitions are numbered on their
    own and shifted by the counts of the partitions before them (one row per partition)."""
    ranged = values.repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("_p", F.spark_partition_id()), "values")  # the partitioning must not move
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.select(*values.columns, "_p", rank.alias("_r")).join(F.broadcast(before), "_p").select(
        *values.columns, (F.col("_r") + F.col("_before")).cast("int").alias(out))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """A5: number of distinct labels, counting a missing label once (as ``unique()`` does)."""
    return df.agg((F.countDistinct(label) + F.max(F.col(label).isNull().cast("int"))).cast("bigint")
                  .alias("n_labels"))


def distinct_rows(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Full-row distinct (all columns but ``order``), keeping the first copy's ``order``.

    Hashes of the rows are counted first; only rows whose hash occurs more than once are compared as a whole, so
    unique rows are not shuffled (the few repeated hashes are joined back, by broadcast while they are few). A collision
    of hashes costs a comparison, not a row.
    """
    keys = [c for c in df.columns if c != order]
    d = df.withColumn("_h", F.xxhash64(*keys))
    repeated = d.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    copies = d.join(repeated, "_h", "left_semi").groupBy(*keys).agg(F.min(order).alias(order))
    return d.join(repeated, "_h", "left_anti").select(*keys, order).unionByName(copies)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` -> ``(label, n_c, weight)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(tot)).select(  # one-row side: a proven bound
        label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))


def neg_pos_ratio(df: DataFrame, label: str) -> DataFrame:
    """``count(y = 0) / count(y = 1)`` (null when there is no positive)."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"),
                               F.count_if(F.col(label) == 1).cast("double")).alias("ratio"))


def exclude_sentinel(df: DataFrame, col: str, sentinel: str = SENTINEL) -> DataFrame:
    """Drop rows equal to the sentinel; missing values are kept."""
    return df.where(~F.col(col).eqNullSafe(F.lit(sentinel)))


def to_double(col: str, strict: bool = True) -> Column:
    """Text -> double; strict raises on bad text (ANSI cast), lenient gives null."""
    return F.col(col).cast("double") if strict else F.expr(f"try_cast(`{col}` AS DOUBLE)")


def threshold_label(x: Column, threshold: float = 0.3) -> Column:
    """P5: 1 if ``x > threshold`` else 0; missing and NaN -> 0 (Spark would call NaN large)."""
    clean = F.nanvl(x, F.lit(None).cast("double"))
    return F.when(clean > F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def presence_label(col: str, sentinel: str = SENTINEL) -> Column:
    """0 for the sentinel, 1 for anything else (missing included)."""
    return F.when(F.col(col).eqNullSafe(F.lit(sentinel)), F.lit(0)).otherwise(F.lit(1))


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.na.drop(how="any", subset=cols)
