"""File readers for the reference's inputs.

Schemas are declared (no inference); missing-value spellings are normalised
to NULL after reading as text, then cast; columns are found by their header
names, and rows get a unique ``row_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.labels import numbered
from ..session import materialize
from .number_lists import CELLS, LISTS, list_cells, number_lists

# The text spellings pandas' CSV reader treats as missing.
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Label column per training target (drug class, gene family, resistance mechanism).
TARGET_COLUMNS = {"dc": "Drug Class", "gf": "Gene Family", "rm": "Resistance Mechanism"}


def _na_to_null(c: Column) -> Column:
    return F.when(c.isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def _named(raw: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns by header name, with missing spellings as NULL; other columns are left out."""
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the header has {raw.columns}")
    return raw.select(*[_na_to_null(F.col(f"`{c}`")).alias(c) for c in columns])


def read_sequences(spark: SparkSession, paths: dict[str, str], columns: list[str],
                   key: str | None = None) -> DataFrame:
    """S1 + U3: labelled sequence CSVs (one per split) -> one table tagged by ``split``.

    ``paths`` maps split name -> CSV path. Columns are taken by header name and
    read as text; NA spellings become NULL. ``row_id`` is the ``key`` column if
    one is given; else it numbers the rows of all splits together in scan order
    (splits in turn, unique however many scan tasks there are).
    """
    out = None
    for name, path in paths.items():
        raw = spark.read.option("header", True).option("multiLine", False).csv(path)
        d = _named(raw, list(dict.fromkeys([*columns, *([key] if key else [])]))).withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("row_id", F.col(f"`{key}`").cast("bigint") if key else F.monotonically_increasing_id())


def target_column(target: str) -> str:
    """Label column for a target code ``dc`` / ``gf`` / ``rm``."""
    return TARGET_COLUMNS[target]


def read_metadata(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """Tab-separated sample metadata. Every column is read as text, NA spellings become
    NULL (``'not applicable'`` is *not* one), and the listed numeric columns are cast."""
    raw = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
    cols = []
    for c in raw.columns:
        v = _na_to_null(F.col(f"`{c}`"))
        cols.append((v.cast("double") if c in numeric else v).alias(c))
    return raw.select(*cols)


def read_wide_embeddings(spark: SparkSession, path: str, dim: int = 768, key: str = "sample_name",
                         weight: str = "abundance") -> DataFrame:
    """S3: CSV with ``emb_0 .. emb_{dim-1}`` -> ``(key, weight, emb array<float>)`` (index order kept)."""
    raw = spark.read.option("header", True).option("maxColumns", max(20480, 2 * dim)).csv(path)
    raw = _named(raw, [key, weight, *(f"emb_{i}" for i in range(dim))])
    emb = F.array(*[F.col(f"emb_{i}").cast("float") for i in range(dim)])
    return raw.select(key, F.col(weight).cast("double").alias(weight), emb.alias("emb"))


# A BIOM 1.0 text is read as records between closing brackets, which Spark's text source deals out by byte ranges (of a
# compressed text: by its parts), so many tasks read one text and no task holds it: a cell of the sparse form, a row of the
# dense form and a list inside an axis entry's metadata are a record each.
_KEY = r'(?s)^.*(?<!\\)"%s"\s*:\s*\['
_ID = r'\{\s*"id"\s*:\s*("(?:[^"\\]|\\.)*")'

_CUT_ID = r'\{\s*"id"\s*:\s*"(?:[^"\\]|\\.)*$'


def _biom_records(spark: SparkSession, path: str) -> DataFrame:
    """``(value, at)``: the texts between closing brackets with their place in the file's order (a folder's files by name)."""
    raw = spark.read.option("lineSep", "]").text(path)
    return raw.select("value", F.struct(F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("line")).alias("at"))


def _place(at) -> Column:
    return F.struct(*[F.lit(at[k]).alias(k) for k in ("file", "block", "line", "sub")])


def _axis(records: DataFrame, name: str, marks: dict, n: int | None) -> DataFrame:
    """``(place, id)`` of the entries of ``rows`` or ``columns``, numbered from 0 in file order."""
    begin = marks[name]
    later = [marks[m] for m in ("rows", "columns", "data") if marks[m] and marks[m] > begin]
    inside = F.col("at") >= _place(begin)
    if later:
        inside &= F.col("at") < _place(min(later))
    body = F.when(F.col("at") == _place(begin), F.regexp_replace("value", _KEY % name, "")).otherwise(F.col("value"))
    # few and long records: dealt out anew, and looked through once
    spark = records.sparkSession
    entries = records.where(inside).repartition(spark.sparkContext.defaultParallelism, "at")
    entries = materialize(entries.select("at", F.regexp_extract_all(body, F.lit(_ID), 1).alias("q"),
                                         body.rlike(_CUT_ID).alias("cut")), name)
    if not entries.where("cut").isEmpty():
        raise ValueError(f"{name}: an id holds a closing bracket, which separates the records")
    ids = entries.select("at", F.posexplode("q").alias("k", "q"))
    ids = ids.select("at", "k", F.get_json_object(F.concat(F.lit('{"x":'), "q", F.lit("}")), "$.x").alias("id"))
    axis = numbered(ids, [F.col("at"), F.col("k")], "place").select("place", "id")
    if n is not None and axis.count() != n:
        raise ValueError(f"{name}: {axis.count()} ids of the form {{\"id\": ..., the shape says {n}")
    return axis


def read_biom_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """BIOM 1.0 JSON, sparse or dense -> ``(triples, otu_ids, sample_ids)``.

    ``triples(otu_id, sample_id, abundance)`` holds the non-zero cells; the two
    axis lists keep all-zero rows and columns. Keys may stand in any order; an axis entry begins with its id, which
    holds no closing bracket. A file
    without ``data``, ``rows`` or ``columns``, of another matrix type (sparse if none is named), or whose axes differ
    from its shape, if it has one, raises.
    """
    # one pass over the text, however long its lists of zeros are: what is kept are other records and the non-zero numbers
    read = _biom_records(spark, path).select("value", "at.*").mapInArrow(number_lists, LISTS)
    read = materialize(read, "biom").withColumn("at", F.struct("file", "block", "line", "sub"))
    records = read.where("value IS NOT NULL").select("value", "at")
    v = F.col("value")
    has = lambda key, found: F.when(v.contains(f'"{key}"'), found)  # noqa: E731  (an axis' text is long to search by pattern)
    kind = F.regexp_extract(v, r'(?<!\\)"matrix_type"\s*:\s*"(\w+)"', 1)
    size = lambda i: F.regexp_extract(v, r'(?s)(?<!\\)"shape"\s*:\s*\[\s*(\d+)\s*,\s*(\d+)\s*$', i)
    marks = records.agg(*[F.min(has(m, F.when(v.rlike(_KEY % m), F.col("at")))).alias(m) for m in ("rows", "columns", "data")],
                        F.coalesce(F.max(has("matrix_type", kind)), F.lit("")).alias("kind"), F.max(has("shape", size(1))).alias("r"),
                        F.max(has("shape", size(2))).alias("c")).first().asDict()
    missing = [m for m in ("rows", "columns", "data") if not marks[m]]
    if missing or marks["kind"] not in ("sparse", "dense", ""):
        raise ValueError(f"not a BIOM 1.0 text: without {missing}, matrix type {marks['kind']!r}")
    rows, cols = (_axis(records, m, marks, int(marks[n]) if marks[n] else None) for m, n in (("rows", "r"), ("columns", "c")))
    begin, dense = _place(marks["data"]), marks["kind"] == "dense"
    lists = read.where(F.col("n").isNotNull() & (F.col("at") > begin))
    end = records.where(F.col("at") > begin).agg(F.min("at").alias("end")).first()["end"]
    lists = lists.where(F.col("at") < _place(end)) if end else lists
    if not dense and not lists.where("least < 3").isEmpty():
        raise ValueError("data: a sparse cell is not of the form [row, column, value]")
    # a run's first list is numbered by the lists of its file's block before it and those of all blocks before
    block = lists.groupBy("file", "block").agg(F.sum("n").alias("_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    block = block.select("file", "block", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("file", "block"))),
                                                     F.lit(0)).alias("_before"))  # one row per block of the text
    within = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("file", "block").orderBy("line", "sub"))), F.lit(0))
    lists = lists.withColumn("_within", within).join(F.broadcast(block), ["file", "block"])
    cells = lists.select((F.col("_within") + F.col("_before")).alias("first"), "counts", "places", "numbers")
    cells = cells.mapInArrow(list_cells(dense), CELLS)
    triples = cells.join(rows.select(F.col("place").alias("r"), F.col("id").alias("otu_id")), "r").join(
        cols.select(F.col("place").alias("c"), F.col("id").alias("sample_id")), "c")
    return (triples.select("otu_id", "sample_id", "abundance"), rows.select(F.col("id").alias("otu_id")),
            cols.select(F.col("id").alias("sample_id")))
