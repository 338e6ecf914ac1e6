"""Imports every module that registers queries."""

from . import history, lexical, ranking, reports, streams, texts, usage  # noqa: F401
