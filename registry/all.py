"""Imports every module that registers queries."""

from registry import activity_queries, command_queries, masking_queries, sql_queries  # noqa: F401
from registry.base import QUERIES, oracles  # noqa: F401
