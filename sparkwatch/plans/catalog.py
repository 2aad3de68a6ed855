"""Imports every query module so that all queries are registered."""

from . import q_drift, q_feedback, q_io, q_ml, q_monitor, q_stream  # noqa: F401
from .registry import REGISTRY  # noqa: F401
