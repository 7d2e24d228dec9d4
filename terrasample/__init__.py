"""Raster statistics for tables of points, and the data work around them, on Spark."""

from __future__ import annotations

import importlib
from typing import Any

# Public names and the modules that have them, loaded on first use: executors import parts of the package only.
_HOMES = {
    "CatalogError": "plans.catalog", "catalog_table": "plans.catalog", "list_datasets": "plans.catalog", "reset_catalog": "plans.catalog", "update_catalog": "plans.catalog",
    "ProgressEvent": "plans.progress", "Raster": "sources.raster", "extract": "plans.extract", "Requests": "plans.requests", "init_remote": "plans.remote", "list_reducers": "functions.reducers", "register_reducer": "functions.reducers", "ArrowReducer": "functions.reducers", "register_arrow_reducer": "functions.reducers", "register_source": "sources.raster",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str) -> Any:
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"terrasample.{_HOMES[name]}"), name)
