"""All registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from cadaspark.plans.fixtures import sql

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, **views: str) -> Callable:
    """Register a function (spark, sf_dir) under its own name, with DuckDB SQL for its rows."""

    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = sql(oracle, **views)
        return f

    return register


def _load() -> None:
    from cadaspark.plans import q_blocks, q_cells, q_comparison, q_coverage, q_evidence, q_layers, q_logs, q_regions, q_rules, q_saving, q_scoring, q_shapes, q_streams, q_tiles, q_topology, q_zonal  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
