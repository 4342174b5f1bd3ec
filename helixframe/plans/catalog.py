"""Imports every query module so that the registry is complete."""

from . import q_attack, q_labels, q_metrics, q_ml, q_pooling, q_reports, q_sequence, q_tokens  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
