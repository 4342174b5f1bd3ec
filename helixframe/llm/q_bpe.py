"""op1: every document through the BPE encoder and decoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe
from .common import table
from .registry import register

TOKENIZER = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@register("op1_bpe")
def op1_bpe(spark, sf_dir, path: str | None = None):
    """Per document: number of ids, digest of the packed ids, digest of the decoded text."""
    vocabulary = bpe.Vocabulary(path or vocabulary_path())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, vocabulary, "text", keep=["doc_id"])
    back = bpe.decode(ids.select("doc_id", "n_tokens", "token_ids"), vocabulary)
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
