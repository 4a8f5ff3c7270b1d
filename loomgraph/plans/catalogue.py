"""The catalogue of the engine's own queries: each operator over the relational tables, with its SQL."""

from __future__ import annotations

from . import catalogue_checks, catalogue_graph, catalogue_parse, catalogue_search, catalogue_stream, catalogue_text


def _all() -> dict:
    return {**catalogue_graph.CATALOGUE, **catalogue_text.CATALOGUE, **catalogue_search.CATALOGUE, **catalogue_parse.CATALOGUE, **catalogue_checks.CATALOGUE, **catalogue_stream.CATALOGUE}


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
