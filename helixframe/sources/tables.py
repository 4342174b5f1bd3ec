"""Driver tables.

Each driver table is one parquet file with one row group, so a scan yields one
partition (and small intermediate tables read back from parquet coalesce into
one partition too). CPU-heavy operators (per-base mutation, k-mer scoring) would then
run in one task; ``spread`` hash-partitions such a scan by its key so work is
spread over the cluster *and* later ``groupBy(key, ...)`` reuse the
partitioning without another exchange. When a scan already has enough
partitions (the cluster case: many files), nothing is added.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Hash-partition a *scan* by ``key`` when it has fewer partitions than the shuffle parallelism.

    Apply it to file scans only: there the partition count is planning metadata
    (file listing), while on a plan with exchanges adaptive execution would have
    to run the stages to know it.
    """
    spark = df.sparkSession
    target = min_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
