"""op12: the periodic runs of every document, a tenth of which get a repeated tail first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs
from .common import table
from .registry import register


def planted(docs: DataFrame) -> DataFrame:
    """The texts, those whose key's checksum ends in 0 with their words repeated from a drawn place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    some = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, w))
    some = (some.withColumn("_n", F.size("_w"))
            .withColumn("_a", F.expr("CASE WHEN _n > 0 THEN (_h div 10) % _n END"))
            .withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)")))
    tail = F.expr("transform(sequence(0L, _n - _a - 1), i -> _w[int(_a + i % _p)])")
    new = F.array_join(F.concat(F.expr("slice(_w, 1, int(_a))"), tail), " ")
    return some.withColumn("text", F.when(F.col("_n") > 0, new).otherwise(F.col("text"))).drop(
        "_h", "_w", "_n", "_a", "_p")


def lines(found: str = "runs") -> Column:
    """Every run as ``start,length,period`` and a line break."""
    return F.array_join(F.transform(found, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


@register("op12_runs")
def op12_runs(spark, sf_dir):
    """Per document: number of runs, the run of the greatest exponent, digests of all runs and of the kept words."""
    docs = planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = runs.detect(docs, keep=["doc_id"])
    return got.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.encode(lines(), "UTF-8"), 256).alias("runs_sha256"),
                      F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
