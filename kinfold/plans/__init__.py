"""Fixtures over the given tables, registered queries and end-to-end chains."""
