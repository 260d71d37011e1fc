"""Registered queries: each has a Spark plan and, where SQL can express it, an ANSI-SQL twin."""
