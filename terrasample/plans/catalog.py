"""The dataset catalog: built-in entries, entries added for the session, and their listing."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession


class CatalogError(ValueError):
    """A catalog that can't be used."""


# Names, remote paths, kinds, periods and resolutions of the built-in datasets.
# name | path | data type | resolution | time step | range | bands | date policy
_BUILTIN = """
dem_copernicus_glo30 | COPERNICUS/DEM/GLO30 | continuous | 30 meters | static | n/a | DEM |
climate_worldclim_v1_bioclim | WORLDCLIM/V1/BIO | continuous | 927 meters | static | average over 1960-1990 | |
climate_era5_monthly | ECMWF/ERA5/MONTHLY | continuous | 27830 meters | monthly | 1979-present | | contains
climate_terraclimate_monthly | IDAHO_EPSCOR/TERRACLIMATE | continuous | 4638 meters | monthly | 1958-present | | contains
lulc_worldcover_2021 | ESA/WorldCover/v200 | categorical | 10 meters | static | 2021 | |
lulc_copernicus_lc100 | COPERNICUS/Landcover/100m/Proba-V-C3/Global | categorical | 100 meters | annual | 2015-2019 | discrete_classification |
lulc_naturallands_2020 | WRI/SBTN/naturalLands/v1_1/2020 | categorical | 30 meters | static | 2020 | |
sr_landsat_8day | LANDSAT/COMPOSITES/C02/T1_L2_8DAY | continuous | 30 meters | 8 days | 1984-present | | contains
sr_landsat_32day | LANDSAT/COMPOSITES/C02/T1_L2_32DAY | continuous | 30 meters | 32 days | 1984-present | | contains
sr_landsat_annual | LANDSAT/COMPOSITES/C02/T1_L2_ANNUAL | continuous | 30 meters | annual | 1984-present | | contains
ndvi_landsat_8day | LANDSAT/COMPOSITES/C02/T1_L2_8DAY_NDVI | continuous | 30 meters | 8 days | 1984-present | | contains
ndvi_landsat_32day | LANDSAT/COMPOSITES/C02/T1_L2_32DAY_NDVI | continuous | 30 meters | 32 days | 1984-present | | contains
ndvi_landsat_annual | LANDSAT/COMPOSITES/C02/T1_L2_ANNUAL_NDVI | continuous | 30 meters | annual | 1984-present | | contains
evi_landsat_8day | LANDSAT/COMPOSITES/C02/T1_L2_8DAY_EVI | continuous | 30 meters | 8 days | 1984-present | | contains
evi_landsat_annual | LANDSAT/COMPOSITES/C02/T1_L2_ANNUAL_EVI | continuous | 30 meters | annual | 1984-present | | contains
npp_modis_terra | MODIS/061/MOD17A3HGF | continuous | 500 meters | annual | 2001-2024 | | contains
agb_esa_cci | ESA/CCI/Above_Ground_Biomass/V6_0 | continuous | 100 meters | irregular (selected years) | 2007, 2010, 2015-2022 | |
human_impact_index | projects/HII/v1/hii | continuous | 300 meters | annual | 2001-2020 | |
hii_driver_infrastructure | projects/HII/v1/driver/infrastructure | continuous | 300 meters | annual | 2001-2020 | |
hii_driver_land_use | projects/HII/v1/driver/land_use | continuous | 300 meters | annual | 2001-2020 | |
hii_driver_population_density | projects/HII/v1/driver/population_density | continuous | 300 meters | annual | 2001-2020 | |
hii_driver_power | projects/HII/v1/driver/power | continuous | 300 meters | annual | 2001-2020 | |
hii_driver_railways | projects/HII/v1/driver/railways | continuous | 300 meters | annual | 2001-2020 | |
hii_driver_roads | projects/HII/v1/driver/roads | continuous | 300 meters | annual | 2001-2020 | |
hii_driver_water | projects/HII/v1/driver/water | continuous | 300 meters | annual | 2001-2020 | |
aef_satellite_embeddings | GOOGLE/SATELLITE_EMBEDDING/V1/ANNUAL | continuous | 10 meters | annual | 2017-2025 | | contains
"""
#: Where the remote catalog describes a public asset, by its path.
SOURCE_PAGE = "https://developers.google.com/earth-engine/datasets/catalog/"
DEFAULTS: dict[str, Any] = {"output_file_format": "csv", "window_size_m": 500, "min_coverage_pct": 0, "max_workers": 20, "stats_output_decimals": 5}


def builtin() -> dict[str, dict[str, Any]]:
    """The built-in datasets; they are remote, so they open only through a registered source or a mirror."""
    out = {}
    for line in _BUILTIN.strip().splitlines():
        name, path, kind, resolution, step, span, bands, policy = (x.strip() for x in line.split("|"))
        about = {
            "description": f"{name.replace('_', ' ')}: {kind} data, {resolution}, {step} ({span})",
            "ee_source_url": SOURCE_PAGE + path.replace("/", "_"), "spatial_resolution": resolution,
            "temporal_resolution": step, "temporal_range": span
        }
        spec: dict[str, Any] = {"data_source": "earth_engine", "path": path, "data_type": kind, "dataset_information": about}
        if bands:
            spec["bands"] = bands.split(",")
        extra = {"collection_date_policy": policy} if policy else {}
        if "LANDSAT" in path:
            extra["native_scale_m"] = 30
        if "EMBEDDING" in path:
            extra["use_utm_zone"] = True
        if extra:
            spec["dataset_spec"] = extra
        if name.startswith("dem_"):
            spec["supported_derived_bands"] = ["slope", "aspect"]
        out[name] = spec
    return out


_session: dict[str, dict[str, Any]] = {}


def validate(catalog: Any) -> dict[str, dict[str, Any]]:
    """The datasets of a catalog mapping; CatalogError where it isn't one."""
    if not isinstance(catalog, dict) or not isinstance(catalog.get("datasets"), dict) or not catalog["datasets"]:
        raise CatalogError("a catalog is a mapping with a non-empty 'datasets' mapping")
    for name, spec in catalog["datasets"].items():
        if not isinstance(spec, dict):
            raise CatalogError(f"dataset {name!r} must be a mapping")
        for key in ("data_source", "path"):
            if not isinstance(spec.get(key), str) or not spec[key]:
                raise CatalogError(f"dataset {name!r} needs a text {key!r}")
        if spec["data_source"] == "earth_engine" and spec.get("data_type") not in ("continuous", "categorical"):
            raise CatalogError(f"dataset {name!r} needs data_type continuous or categorical")
    return catalog["datasets"]


def update_catalog(source: str | Path | dict[str, Any]) -> None:
    """Add datasets from a mapping or a YAML file, over earlier ones of the same names."""
    if not isinstance(source, dict):
        path = Path(source)
        if not path.exists():
            raise CatalogError(f"Catalog file not found: {path}")
        try:
            source = yaml.safe_load(path.read_text())
        except yaml.YAMLError as e:
            raise CatalogError(f"{path} isn't YAML: {e}") from e
    _session.update(validate(source))


def reset_catalog() -> None:
    """Forget all that update_catalog added."""
    _session.clear()


def datasets() -> dict[str, dict[str, Any]]:
    """All datasets by name; the session's over the built-in ones."""
    return {**builtin(), **_session}


def list_datasets(verbosity: str = "names") -> list[str] | list[dict[str, Any]]:
    """Sorted names; records of what is known about each ("info"); or whole entries with their names ("full")."""
    every = dict(sorted(datasets().items()))
    if verbosity == "names":
        return list(every)
    if verbosity == "info":
        about = lambda v: v.get("dataset_information") or {}
        return [
            {
                "name": k, "data_source": v.get("data_source"), "data_type": v.get("data_type"),
                **{f: about(v).get(f) for f in ("description", "citation", "ee_source_url", "source_url")}
            } for k,
            v in every.items()
        ]
    if verbosity == "full":
        return [{"name": k, **v} for k, v in every.items()]
    raise ValueError(f"verbosity must be names, info or full, not {verbosity!r}")


def catalog_table(spark: SparkSession) -> DataFrame:
    """The catalog as a table: name, data_source, path, data_type, spatial_resolution, temporal_resolution."""
    rows = [
        (
            k, v["data_source"], v["path"], v.get("data_type"),
            (i := v.get("dataset_information", {})).get("spatial_resolution"), i.get("temporal_resolution")
        ) for k,
        v in sorted(datasets().items())
    ]
    return spark.createDataFrame(
        rows,
        "name string, data_source string, path string, data_type string, spatial_resolution string, temporal_resolution string"
    )
