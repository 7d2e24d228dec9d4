"""Run configurations: parsing and every rule of their validation (all failures are ValueError)."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from terrasample.functions import reducers

DERIVED = ("slope", "aspect")
FORMATS = ("csv", "parquet", "dataframe")
KINDS = ("continuous", "categorical")


@dataclass(frozen=True)
class Selection:
    """A dataset of a run, with the call's own bands and derived bands where it names them."""

    name: str
    bands: list[str | int] | None = None
    derived: list[str] = field(default_factory=list)
    listed: bool = False

    @property
    def keeps_source(self) -> bool:
        """Whether source bands stand beside the derived ones: those that the call lists, or the catalog's."""
        return bool(self.bands) or not self.listed


@dataclass(frozen=True)
class Run:
    """One validated configuration."""

    batch_id: str
    datasets: list[Selection]
    output_type: str
    output_file_format: str
    windows: list[int]
    min_coverage_pct: float
    statistics: list[str] | dict[str, list[str]]
    resample_m: float | None
    raw: dict[str, Any]
    approximate: bool = False

    def statistics_for(self, name: str, kind: str) -> list[str]:
        """The reducers for a dataset of a kind."""
        if isinstance(self.statistics, list):
            return self.statistics
        kind = kind if kind in KINDS else "continuous"
        if kind not in self.statistics:
            raise ValueError(f"Output {self.batch_id!r}: no statistics for {kind} data, which {name!r} is")
        return self.statistics[kind]


def configs(config: dict | list | str | Path) -> list[dict[str, Any]]:
    """A list of mappings from a mapping, a list or a YAML file."""
    if isinstance(config, (str, Path)):
        config = yaml.safe_load(Path(config).read_text())
    out = config if isinstance(config, list) else [config]
    if not out or not all(isinstance(c, dict) for c in out):
        raise ValueError("a run configuration is a mapping or a list of mappings")
    return out


def _selection(entry: Any, batch: str, catalog: dict[str, Any]) -> Selection:
    if isinstance(entry, str):
        name, chosen = entry, None
    elif isinstance(entry, dict) and len(entry) == 1:
        name, chosen = next(iter(entry.items()))
    else:
        raise ValueError(f"Output {batch!r}: a dataset is a name or a mapping of one name, not {entry!r}")
    if not isinstance(name, str) or not name:
        raise ValueError(f"Output {batch!r}: empty dataset name")
    if name not in catalog:
        raise ValueError(f"Output {batch!r}: unknown dataset {name!r}")
    if isinstance(chosen, dict):
        if unknown := set(chosen) - {"bands"}:
            raise ValueError(f"Output {batch!r}: unknown settings {sorted(unknown)} of {name!r}")
        chosen = chosen.get("bands")
    spec = catalog[name]
    if chosen is not None:
        if not isinstance(chosen, list):
            raise ValueError(f"Output {batch!r}: bands of {name!r} must be a list")
        if not chosen:
            raise ValueError(f"Output {batch!r}: bands of {name!r} must not be empty")
    derived = [b for b in chosen or [] if b in DERIVED]
    if not derived:  # the catalog's own, which must be allowed as well
        own = spec.get("derived_bands") or []
        derived = [own] if isinstance(own, str) else list(own)
    if derived:
        if spec.get("data_source") in ("local", "geotiff"):
            raise ValueError(f"Output {batch!r}: {name!r} is a local raster, which has no derived bands")
        allowed = spec.get("supported_derived_bands") or []
        if bad := sorted({b for b in derived if b not in allowed}):
            raise ValueError(f"Output {batch!r}: {name!r} doesn't support derived bands {bad}; it supports {sorted(allowed)}")
        if bad := sorted({b for b in derived if b not in DERIVED}):
            raise ValueError(f"Output {batch!r}: unknown derived bands {bad}; known: {', '.join(DERIVED)}")
    return Selection(name, [b for b in chosen or [] if b not in DERIVED] or None, derived, chosen is not None)


def _statistics(raw: Any, batch: str) -> list[str] | dict[str, list[str]]:
    def checked(names: Any) -> list[str]:
        if not isinstance(names, list) or not names:
            raise ValueError(f"Output {batch!r}: statistics must be a non-empty list")
        known = {*reducers.list_reducers(), reducers.POINT}
        if bad := [n for n in names if n not in known]:
            raise ValueError(f"Output {batch!r}: unknown statistics {bad}; known: {', '.join(sorted(known))}")
        return list(dict.fromkeys(names))

    if not raw:
        raise ValueError(f"Output {batch!r}: statistics are missing")
    if isinstance(raw, list):
        return checked(raw)
    if not isinstance(raw, dict):
        raise ValueError(f"Output {batch!r}: statistics must be a list or a mapping")
    if bad := set(raw) - set(KINDS):
        raise ValueError(f"Output {batch!r}: unknown kinds of data {sorted(bad)}")
    return {k: checked(v) for k, v in raw.items()}


def parse(config: dict[str, Any], index: int, catalog: dict[str, Any], defaults: dict[str, Any]) -> Run:
    """One configuration, validated."""
    batch = config.get("batch_id") or f"output{index + 1}"
    if not config.get("datasets"):
        raise ValueError(f"Output {batch!r}: datasets are missing")
    selected = [_selection(e, batch, catalog) for e in config["datasets"]]
    settings = config.get("settings")
    if not settings:
        raise ValueError(f"Output {batch!r}: settings are missing")
    kind = settings.get("output_type")
    if kind not in ("tabular", "raster"):
        raise ValueError(f"Output {batch!r}: output_type must be tabular or raster, not {kind!r}")
    step = settings.get("resample_m")
    if step is not None and kind == "tabular":
        raise ValueError(f"Output {batch!r}: resample_m is for raster output")
    if step is not None and step <= 0:
        raise ValueError(f"Output {batch!r}: resample_m must be positive")
    form = settings.get("output_file_format", defaults["output_file_format"])
    if form not in FORMATS:
        raise ValueError(f"Output {batch!r}: unknown output_file_format {form!r}")
    least = settings.get("min_coverage_pct", defaults["min_coverage_pct"])
    if not 0 <= least <= 100:
        raise ValueError(f"Output {batch!r}: min_coverage_pct must be from 0 to 100")
    if kind == "raster" and settings.get("statistics"):
        raise ValueError(f"Output {batch!r}: raster output has no statistics")
    stats = _statistics(settings.get("statistics"), batch) if kind == "tabular" else []
    window = settings.get("window_size_m", defaults["window_size_m"])
    windows = list(window) if isinstance(window, (list, tuple)) else [window]
    if not windows or any(isinstance(w, bool) or not isinstance(w, int) or w <= 0 for w in windows):
        raise ValueError(f"Output {batch!r}: window_size_m must be a positive integer or a list of them")
    quantiles = settings.get("quantiles", "exact")
    if quantiles not in ("exact", "approximate"):
        raise ValueError(f"Output {batch!r}: quantiles must be exact or approximate, not {quantiles!r}")
    return Run(batch, selected, kind, form, list(dict.fromkeys(windows)), least, stats, step, config, quantiles == "approximate")
