"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1. quality: documents that the nearest-neighbour vote rejects go;
2. near_dedup: one document of each near-duplicate component stays;
3. suffix_dedup: bytes under a 100-byte string that stands earlier are cut out of the texts;
4. decontaminate: documents with benchmark passages go;
5. bpe: the remaining texts as token ids.

Stages 1 to 4 return the columns of their input. SQL cannot express stage 1 (or
the token ids), so the whole is tested against a plain version instead.
Defined cases are those of the operators; empty tables give empty results, and
input columns that are named like an operator's results are set aside and put
back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, decontaminate, minhash, quality, suffixes
from helixframe.llm.common import Scratch, table
from helixframe.llm.q_bpe import vocabulary_path
from helixframe.llm.q_quality import held_out

KEY, TEXT = "doc_id", "text"


def _aside(docs: DataFrame, names: list[str], fn) -> DataFrame:
    """Apply ``fn`` with clashing columns renamed, and return the columns of ``docs`` in order."""
    away = {c: f"_aside_{c}" for c in docs.columns if c in names}
    out = fn(docs.withColumnsRenamed(away)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in away.items()}).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    labels = table(spark, sf_dir, "labels").select(KEY, "quality").where(~held_out())
    model = quality.learn(docs, labels)
    return _aside(docs, ["score", "predicted"], lambda d: quality.score(d, model).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every near-duplicate component."""
    return minhash.keep_one(docs, TEXT, KEY)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated strings out of the texts; ``n_chars`` follows."""
    others = [c for c in docs.columns if c not in (KEY, TEXT)]
    away = {c: f"_aside_{c}" for c in others}
    cut = suffixes.remove_repeats(docs.withColumnsRenamed(away), KEY, TEXT, keep=list(away.values()), as_text=True)
    out = cut.withColumnRenamed("kept", TEXT).select(KEY, TEXT, *away.values())
    out = out.withColumnsRenamed({v: k for k, v in away.items()})
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length(TEXT).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark passages."""
    names = [n for n, _ in decontaminate.FIELDS]
    bad = decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))
    return _aside(docs, names, lambda d: decontaminate.scan(d, table(spark, sf_dir, "benchmark"), TEXT).where(~bad))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed little-endian unsigned 32-bit) with the document's key, language and source."""
    keep = [c for c in (KEY, "lang", "source") if c in docs.columns]
    return bpe.encode(docs, bpe.Vocabulary(vocabulary_path()), TEXT, keep=keep)


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontaminate", drop_contaminated), ("bpe", tokenize)]

#: SQL has no nearest-neighbour vote over a learned space; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder before the next stage reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
