"""SQL twins of the registered queries, written apart from the Spark code."""
