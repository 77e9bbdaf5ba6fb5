"""Pipelines, reports and the registered queries."""
