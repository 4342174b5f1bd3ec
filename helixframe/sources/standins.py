"""Stand-in views: the driver's tables reshaped into the reference's inputs.

The driver data has no biology, so each view derives a biological-looking
the whole table; the matching DuckDB text lives in ``plans/views.py``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table

ALPHABET_FROM = "abcdefghijklmnopqrstuvwxyz"
ALPHABET_TO = "ACGT" * 6 + "AC"  # letter i -> base i mod 4
BASES = bytes.maketrans((ALPHABET_FROM + ALPHABET_FROM.upper()).encode(), (ALPHABET_TO * 2).encode())
OTHERS = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())


def text_to_dna(text: Column) -> Column:
    """Letters only, either case, letter i of the alphabet -> 'ACGT'[i % 4]; a null text stays null.

    One pass over the bytes of a text, in Arrow batches: matching and replacing character by character in the JVM
    costs more than the k-mer counts and draws behind it.
    """
    @F.arrow_udf("string")
    def bases(texts: pa.Array) -> pa.Array:
        raw = (t.as_py() for t in texts.cast(pa.large_binary()))
        return pa.array([None if t is None else t.translate(BASES, OTHERS) for t in raw], pa.string())

    return bases(text)


def split_of(row_id: Column) -> Column:
    """Seeded 70/10/20 train/valid/test tag from the md5 of the row id (partition independent)."""
    bucket = F.conv(F.substring(F.md5(row_id.cast("string")), 1, 8), 16, 10).cast("bigint") % 10
    return (F.when(bucket < 7, F.lit("train"))
            .when(bucket == 7, F.lit("valid"))
            .otherwise(F.lit("test")))


def seqs(spark: SparkSession, sf_dir: str, parallel: bool = True, raw: bool = False) -> DataFrame:
    """``seqs(row_id, dna, label_name, split)`` from ``documents``: one sequence per document.

    ``parallel`` spreads the scan by ``doc_id`` for the CPU-heavy per-base work;
    light uses (dictionaries, counts) read the scan as it is. With ``raw`` the text stands in place of ``dna``,
    for plans that drop rows by a join before they turn the rest into bases.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    if parallel:
        docs = spread(docs, "doc_id")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        (F.col("text") if raw else text_to_dna(F.col("text"))).alias("dna"),
        F.col("lang").alias("label_name"),
        split_of(F.col("doc_id")).alias("split"),
    )


def logits(spark: SparkSession, sf_dir: str, width: int = 10, twist=0) -> DataFrame:
    """``logits(row_id, y, z)`` from ``embeddings``: all values folded into ``width`` sums, x 10.

    Position ``j`` (0-based) goes to sum ``(j + twist * (j div width)) mod width``; a ``twist`` gives another folding
    of the same values.
    """
    emb = table(spark, sf_dir, "embeddings")
    z = folded(F.col("embedding"), width, twist)
    return emb.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"), z.alias("z"))


def folded(v: Column, width: int = 10, twist=0) -> Column:
    t = twist if isinstance(twist, Column) else F.lit(twist)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(
        F.filter(v, lambda x, j: (j + t * F.floor(j / F.lit(width))) % F.lit(width) == i),
        F.lit(0.0), lambda a, x: a + x.cast("double")) * F.lit(10.0))


def otu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``otu(sample_name, otu_id, abundance)``: supplier = sample, part = OTU, quantity = abundance.

    Every 50th supplier is forced to abundance 0 so that all-zero samples exist.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    g = li.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return g.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample_name"),
        F.col("l_partkey").alias("otu_id"),
        F.when(F.col("l_suppkey") % 50 == 0, F.lit(0.0)).otherwise(F.col("q")).alias("abundance"),
    )


def otu_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``otu_emb(sample_name, otu_id, abundance, emb)``: each OTU gets embedding ``otu_id mod n``."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vec = emb.agg(F.count(F.lit(1)).alias("n_vec"))  # one row: a proven broadcast
    o = otu(spark, sf_dir).crossJoin(F.broadcast(n_vec))
    o = o.withColumn("vec_id", F.pmod(F.col("otu_id"), F.col("n_vec")))
    return o.join(emb, "vec_id").select(
        "sample_name", "otu_id", "abundance", F.col("embedding").alias("emb"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``meta``: sample metadata with a sentinel column, missing numbers and missing text.

    ``co_occur`` holds 'not applicable', NULL or a number as text.
    """
    cust = table(spark, sf_dir, "customer")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    k = F.col("c_custkey")
    co = (F.when(k % 10 == 0, F.lit("not applicable"))
          .when(k % 10 == 1, F.lit(None).cast("string"))
          .otherwise(F.concat(F.lit("0."), F.lpad((k % 100).cast("string"), 2, "0"))))
    j = cust.join(nat, cust.c_nationkey == nat.n_nationkey)
    return j.select(
        k.alias("row_id"),
        co.alias("co_occur"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal") / 1000.0).alias("ph"),
        F.col("n_regionkey").cast("double").alias("depth"),
        F.col("c_nationkey").cast("double").alias("elevation"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("env_biome"),
        F.col("n_name").alias("geo_loc_name"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labelled(row_id, quality, toxic)``: binary, imbalanced labels."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), "quality", "toxic")
