"""Incremental M8 scoring of sequence files as they arrive (Structured Streaming + ``foreachBatch``).

Each micro-batch is scored by the batch operator (``kmer_logits``) and
appended to a parquet table; the checkpoint location makes the query restart
exactly where it stopped, and ``foreachBatch`` writes are idempotent per epoch
because each epoch writes its own ``epoch=`` partition in overwrite mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scoring import kmer_logits, predict


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, weights: DataFrame,
                 n_classes: int, out_dir: str, checkpoint_dir: str, seq: str = "dna",
                 key: str = "row_id", k: int = 3, available_now: bool = True):
    """Start a stream that scores every new parquet file under ``source_dir``; returns the query."""
    src = spark.readStream.schema(schema).parquet(source_dir)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        lg = kmer_logits(batch, seq, [key], weights, n_classes, k)
        out = lg.select(key, predict("logits").alias("y_hat"), "logits").withColumn("epoch", F.lit(epoch))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(out_dir))

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
