"""Queries over the given tables, one for each operator, with their SQL counterparts."""
