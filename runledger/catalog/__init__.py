"""The checked queries, by topic."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("reshaping", "filtering", "aggregation", "ordering", "scalars", "testing", "dashboard", "planning", "intake")


def load():
    """Import every topic; returns the registry module."""
    for topic in TOPICS:
        import_module(f"runledger.catalog.{topic}")
    return import_module("runledger.catalog.registry")
