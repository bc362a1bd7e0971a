"""Property-graph queries, graph analytics and data-preparation operators as Spark plans."""
