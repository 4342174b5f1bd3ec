"""op8: the main text of every page."""

from __future__ import annotations

from . import extract
from .common import table
from .registry import register


@register("op8_extract")
def op8_extract(spark, sf_dir):
    """page_id, url, text and its length."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, keep=["page_id", "url"])
