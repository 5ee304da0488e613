"""Registered query plans.  Importing this package fills the registry."""

from . import q_classify, q_core, q_dist, q_extract, q_filters, q_groups, q_stats  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
