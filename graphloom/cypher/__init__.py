"""A Cypher subset compiled to DataFrame plans."""

from graphloom.cypher.binder import CypherError, query, register_aggregate, register_function

__all__ = ["CypherError", "query", "register_aggregate", "register_function"]
