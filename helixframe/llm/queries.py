"""Imports every query module of this subpackage so that the registry is complete."""

from . import q_bpe, q_chat, q_decontaminate, q_extract, q_fim, q_language, q_minhash, q_quality, q_runs, q_sharding, q_suffixes, q_topk, q_warc  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
