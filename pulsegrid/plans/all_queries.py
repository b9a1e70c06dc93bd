"""Imports every query module so that the registry is complete."""

from pulsegrid.plans import (  # noqa: F401
    q_aggregate, q_evaluate, q_joins, q_labels, q_models, q_ordered, q_reshape, q_rows,
)
from pulsegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
