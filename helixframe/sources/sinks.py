"""Writers (S6-S8): result tables, attack snapshots, metric reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import run_stamp
from ..operators.labels import numbered
from ..operators.pooling import expand_vector
from ..session import materialize


def write_table(df: DataFrame, path: str, fmt: str = "parquet", vec: str | None = None,
                dim: int | None = None) -> None:
    """Write a result; for CSV an array column of the declared width is expanded to ``emb_i`` columns."""
    if fmt == "csv" and vec is not None:
        if dim is None:
            raise ValueError("a CSV vector column needs its width: dim")
        df = expand_vector(df, vec, dim, digits=None)
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_snapshots(df: DataFrame, path: str) -> None:
    """One table partitioned by ``iteration`` and ``rate`` (the true iteration, not x10)."""
    df.write.mode("overwrite").partitionBy("iteration", "rate").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """``metric: value`` lines (4 decimals) under a run stamp, appended as text."""
    lines = metrics.select(F.concat_ws("\t", run_stamp(), F.format_string("%s: %.4f", "metric", "value"))
                           .alias("value"))
    lines.coalesce(1).write.mode("append").text(path)


_PART_NUMBERS, _PART_LINES = 1 << 25, 1 << 17  # of one part of a BIOM text: numbers of dense rows, other lines
_PARTS = 90_000  # the text writer numbers files in five digits


def dense_rows(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``(r, c, xs)``: every row with its cells ``(c, x)`` in order, null where it has none; c is 0."""
    of_row = cells.groupBy("r").agg(F.array_sort(F.collect_list(F.struct(
        F.col("c").cast("int").alias("c"), F.col("abundance").cast("string").alias("x")))).alias("xs"))
    return rows.join(of_row, "r", "left").select(F.col("r").cast("bigint").alias("r"), F.lit(0).alias("c"), "xs")


def dense_line(xs: str, n_cols: int, zero: str) -> Column:
    """A row's numbers as text: its cells and the zeros between them, which are put down a gap at a time."""
    of = F.col(xs)
    before = lambda i: F.coalesce(F.get(of, i - 1)["c"], F.lit(-1))
    zeros = lambda n, text: F.repeat(F.lit(text), n)
    cell = lambda e, i: F.when(before(i) != e["c"], F.concat(
        zeros(e["c"] - before(i) - 1, f"{zero},"), F.coalesce(e["x"], F.lit(zero))))  # of a cell given twice one counts
    none = F.concat(zeros(F.lit(n_cols - 1), f"{zero},"), F.lit(zero if n_cols else ""))
    return F.when(F.coalesce(F.size(of), F.lit(0)) <= 0, none).otherwise(F.concat(
        F.array_join(F.transform(of, cell), ","), zeros(n_cols - 1 - F.element_at(of, -1)["c"], f",{zero}")))


def dense_lines(rows: DataFrame, cells: DataFrame, n_cols: int, zero: str = "0.0") -> DataFrame:
    """``(r, c, t)``: every row's numbers as text, zeros where it has no cell. Only the cells are joined and grouped."""
    return dense_rows(rows, cells).select("r", "c", dense_line("xs", n_cols, zero).alias("t"))


def biom_matrix(triples: DataFrame, otu_ids: DataFrame, sample_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, cols, cells)`` of a BIOM text: both axes numbered in the order of their ids, the cells ``(r, c, abundance)``."""
    rows, cols = (numbered(d.select(F.col(c).cast("string").alias("id")), [F.col("id")], "k")
                  for d, c in ((otu_ids, "otu_id"), (sample_ids, "sample_id")))
    cells = triples.select(F.col("otu_id").cast("string").alias("o"), F.col("sample_id").cast("string").alias("s"),
                           "abundance").join(rows.select(F.col("id").alias("o"), F.col("k").alias("r")), "o").join(
        cols.select(F.col("id").alias("s"), F.col("k").alias("c")), "s").select("r", "c", "abundance")
    return rows, cols, materialize(cells, "cells")


def write_biom_json(triples: DataFrame, otu_ids: DataFrame, sample_ids: DataFrame, path: str, dense: bool = False,
                    compression: str | None = None, matrix: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> None:
    """A BIOM 1.0 text of the cells ``(otu_id, sample_id, abundance)`` and both axes (all-zero ones included).

    The format is one JSON text. A long one is written in parts by many tasks: the files of the folder, in the order of their
    names, are the text, and each ends with a line. A dense row is put down where its part is written and is not shuffled.
    ``compression`` is a codec of Spark's text writer; ``matrix`` is ``biom_matrix`` of the three frames, if it is at hand.
    """
    rows, cols, cells = matrix or biom_matrix(triples, otu_ids, sample_ids)
    n_rows, n_cols = rows.count(), cols.count()
    if dense:
        data, first = dense_rows(rows.select(F.col("k").alias("r")), cells), (0, 0)
        text = lambda comma: F.concat(comma, F.lit("["))
    else:
        data = cells.withColumn("xs", F.lit(None).cast("array<struct<c:int,x:string>>"))
        *first, n_lines = cells.agg(F.min(F.struct("r", "c")).alias("m"), F.count("*").alias("n")).select(
            "m.r", "m.c", "n").first()
        text = lambda comma: F.concat(comma, F.lit("["), F.concat_ws(
            ",", "r", "c", F.col("abundance").cast("string")), F.lit("]"))
    comma = lambda is_first: F.when(is_first, "").otherwise(",")
    entry = F.concat(comma(F.col("k") == 0), F.lit('{"id": '), F.regexp_extract(
        F.to_json(F.struct("id")), r'(?s)^\{"id":(.*)\}$', 1), F.lit(', "metadata": null}'))
    kind = "dense" if dense else "sparse"
    spark = triples.sparkSession
    fixed = spark.createDataFrame([
        (0, 0, 0, f'{{"id": null, "format": "Biological Observation Matrix 1.0.0", "type": "OTU table", '
                  f'"matrix_type": "{kind}", "matrix_element_type": "float", "shape": [{n_rows}, {n_cols}],'),
        (1, 0, 0, '"rows": ['), (3, 0, 0, '], "columns": ['), (5, 0, 0, '], "data": ['), (7, 0, 0, "]}")],
        "section int, a int, b int, value string")
    at = lambda n, a, b: [F.lit(n).alias("section"), F.col(a).alias("a"), b.alias("b")]
    lines = fixed.unionByName(rows.select(*at(2, "k", F.lit(0)), entry.alias("value")))
    lines = lines.unionByName(cols.select(*at(4, "k", F.lit(0)), entry.alias("value")))
    is_first = (F.col("r") == first[0]) & (F.col("c") == first[1]) if first[0] is not None else F.lit(True)
    lines = lines.unionByName(data.select(*at(6, "r", F.col("c")), text(comma(is_first)).alias("value"), "xs"),
                              allowMissingColumns=True)
    order = ["section", "a", "b"]
    if dense:  # all lines have one length, so their parts are known; the axes' lines are dealt out apart
        of_part = max(_PART_NUMBERS // max(n_cols, 1), -(-n_rows // _PARTS), 1)
        axes = (n_rows + n_cols) // _PART_LINES
        begin, last = axes + (n_rows > of_part), max(n_rows - 1, 0) // of_part
        line = F.when(F.col("section") < 2, 0).when(F.col("section") == 2, F.col("a")).when(
            F.col("section") < 5, F.col("a") + n_rows).otherwise(n_rows + n_cols)
        part = F.when(F.col("section") < 6, F.floor(line / _PART_LINES)).when(
            F.col("section") == 6, begin + F.floor(F.col("a") / of_part)).otherwise(begin + last)
        lines = lines.repartitionById(begin + last + 1, part.cast("int"))
        value = F.when(F.col("section") == 6, F.concat("value", dense_line("xs", n_cols, "0"), F.lit("]"))).otherwise(
            F.col("value"))
    else:
        parts = min(max(-(-(n_rows + n_cols + n_lines) // _PART_LINES), 1), _PARTS)
        lines, value = lines.repartitionByRange(parts, *order), F.col("value")
    lines = lines.sortWithinPartitions(*order).select(value.alias("value"))
    writer = lines.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)
