"""The registered queries and their SQL."""

from __future__ import annotations

from millrace.plans import q_build, q_chat, q_contamination, q_dedup, q_mixture, q_order, q_samples, q_text  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
