"""All queries by name, with the SQL that gives the same rows where there is one."""

from . import codecs, dag, graphs, learning, lifecycle, memory, policies, revisions, routing, store, telemetry, types  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
