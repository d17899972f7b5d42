"""Queries over derived clinical tables, each with an equivalent SQL statement."""

from staycohort.checks.operator_queries import OPERATOR_QUERIES
from staycohort.checks.oracles import ORACLE_SQL

__all__ = ["OPERATOR_QUERIES", "ORACLE_SQL"]
