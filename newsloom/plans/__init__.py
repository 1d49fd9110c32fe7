"""Registered queries; importing this package registers them all."""

from newsloom.plans import domain_queries, maintenance_queries, read_queries, report_queries, state_queries  # noqa: F401
