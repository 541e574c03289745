"""Pipelines, and the registered queries with the SQL they are compared with."""
