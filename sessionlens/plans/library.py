"""Imports every module that registers queries."""

from sessionlens.plans import ingest, relational, search, sessions  # noqa: F401
