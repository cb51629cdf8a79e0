"""Importing the package registers the queries of all its modules."""

from corvane.plans import documents, evaluations, extraction, feeds, graphs, planning, queries, search, states  # noqa: F401
