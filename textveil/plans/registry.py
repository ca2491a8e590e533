"""Named queries over the driver tables and their SQL counterparts."""

from textveil.plans.oracle import ORACLE_SQL
from textveil.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
