"""Imports every module that registers queries."""

from routescope.plans import q_correlate, q_features, q_hijack, q_joins, q_leak, q_scalar, q_sources, q_streaming, q_traffic  # noqa: F401
from routescope.plans.registry import QUERIES, oracles  # noqa: F401
