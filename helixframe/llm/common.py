"""Helpers shared by the operators: table access, batch mapping, written intermediates, block hashes."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written intermediates in the shared folder of ``spark.checkpoint.dir``.

    ``keep`` writes a frame and reads it back: its lineage is cut, a lost
    executor re-runs only its own tasks, and the shuffles behind it can go.
    ``drop`` deletes what is no longer needed; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_folder(spark, label)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        # shuffle files of the finished job go once the driver's garbage collector has seen their last reference
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(rows: DataFrame, group: str, column: str, n: int) -> DataFrame:
    """About ``n`` to ``2 n`` distinct values of the hash ``column`` for each value of ``group``, or all if fewer.

    The least hashes are taken, by a share of the hash range that follows from an approximate distinct count (one
    partial aggregate), so nothing is sorted or gathered and copies of one value count once. ``group`` must have few
    values: its counts are broadcast, one row each.
    """
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(column, 0.02).alias("_distinct"))
    share = F.pmod(F.col(column), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (rows.join(F.broadcast(sizes), group).where(share * F.col("_distinct") <= 1.5 * n).drop("_distinct"))


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Cut a batch into runs of rows with about ``limit`` bytes of ``column`` each (one row at least)."""
    col = batch.column(column)
    n = batch.num_rows
    if n == 0 or col.nbytes <= limit:
        yield batch
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    run = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def map_columns(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], start, limit: int = 16 << 20,
                keep: list[str] | None = None) -> DataFrame:
    """Append ``fields`` computed batch by batch from the string or binary ``column``.

    ``start()`` runs once per task and returns ``fn(batch) -> list of arrays``,
    one per field. Columns in ``keep`` (default: all) pass through; an input
    column named like a new field is replaced by it. A task holds one run of
    about ``limit`` bytes at a time.
    """
    names = {n for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*dict.fromkeys([*kept, column]))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        fn = start()
        for batch in batches:
            for part in slices(batch, column, limit):
                made = fn(part)
                arrays = [part.column(c).cast(arrow.field(c).type) for c in kept]
                arrays += [a.cast(arrow.field(n).type) if isinstance(a, pa.Array) else pa.array(a, arrow.field(n).type)
                           for (n, _), a in zip(fields, made, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


# --- hashes of substrings -------------------------------------------------
# H(s) = sum_j r[s_j] * B^j over 64-bit wrap-around, r a table of random words, B odd.
# With prefix sums P, H(text[a:b]) = (P[b] - P[a]) * B^-a, so any substring costs two look-ups.

BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class Substrings:
    """64-bit hashes of substrings of byte strings, equal for equal bytes wherever they stand."""

    def __init__(self):
        self.table = np.random.Generator(np.random.PCG64(20240607)).integers(
            0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
        self.up = _powers(BASE, 1 << 12)
        self.down = _powers(pow(BASE, -1, 1 << 64), 1 << 12)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """P[0..n] of the bytes in ``data`` (uint8)."""
        n = len(data)
        self._grow(n + 1)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mixed hashes of text[a:b] for arrays of bounds."""
        return mix((prefix[b] - prefix[a]) * self.down[a])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Mixed hashes of every substring of ``width`` bytes, by start."""
        n = len(prefix) - width
        return mix((prefix[width:] - prefix[:n]) * self.down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser of a public-domain mixer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
