"""op10: metadata and conversion records of every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import warc
from .common import table
from .registry import register


# SQL has no table of the HTML5 references; tests/llm/test_warc.py has a plain version.
@register("op10_warc")
def op10_warc(spark, sf_dir):
    """The derived records of all pages, by digests of their blocks; headers are read from the records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = warc.derive_pages(pages)
    head = lambda name: warc.header(F.col("headers"), name)
    return made.select("page_id", F.col("type").alias("record_type"), head("WARC-Record-ID").alias("record_id"),
                       head("WARC-Refers-To").alias("refers_to"),
                       F.coalesce(head("WARC-Target-URI"), F.lit("")).alias("target_uri"),
                       head("WARC-Source-Payload-Digest").alias("source_digest"),
                       head("Content-Length").cast("long").alias("block_bytes"),
                       F.substring_index(head("WARC-Block-Digest"), ":", -1).alias("block_sha256"))
