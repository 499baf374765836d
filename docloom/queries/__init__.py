"""Registered queries over the driver's tables, each with the SQL that gives its rows."""

from docloom.queries import documents, editing, expressions, relational, replicas, schemas
from docloom.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "documents", "editing", "expressions", "relational", "replicas", "schemas"]
