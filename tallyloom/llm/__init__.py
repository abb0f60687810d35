"""Operators for large training-data pipelines, with their queries and SQL. Nothing outside imports this subpackage."""
