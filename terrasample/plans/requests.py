"""What is wanted of several datasets, gathered and turned into the fewest run configurations.

Datasets that share their windows and statistics go into one run, whose points are
then read, checked and written once; each run is named after what its datasets share.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.functions import crs, reducers
from terrasample.plans import catalog
from terrasample.plans import extract as runs
from terrasample.sources import points as point_source

#: Metres of a resampled tile's pixels, where nothing else is asked for.
PIXEL = 10


def reducers_for(data_type: str | None) -> list[str]:
    """The reducers that suit a kind of data, as their own warnings tell; all for an unknown kind."""
    return [n for n in reducers.list_reducers() if not reducers.type_warnings([n], data_type or "")]


def metres(sizes: int | str | Iterable[int]) -> tuple[int, ...]:
    """Distinct window sizes, rising, from a number, some numbers, or a text of numbers apart by commas, semicolons or blanks."""
    found = re.split(r"[\s,;]+", sizes.strip(" ,;\n\t")) if isinstance(sizes, str) else [sizes] if isinstance(sizes, int) else list(sizes)
    try:
        out = sorted({int(x) for x in found if not isinstance(x, (bool, float))})
    except ValueError:
        out = []
    if len(set(map(str, found))) != len(out) or not out or out[0] <= 0:
        raise ValueError(f"window sizes are positive whole numbers, not {sizes!r}")
    return tuple(out)


@dataclass
class Requests:
    """Wishes for one kind of output ("tabular" or "raster"); ``settings`` hold for all runs."""

    output_type: str
    settings: dict[str, Any] = field(default_factory=dict)
    wanted: dict[tuple[tuple[int, ...], tuple[str, ...]], list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.output_type not in ("tabular", "raster"):
            raise ValueError(f"output is tabular or raster, not {self.output_type!r}")

    def add(self, dataset: str, windows: int | str | Iterable[int], statistics: Iterable[str] | None = None) -> Requests:
        """Want a dataset's windows; without ``statistics`` a table has the usual ones of its kind of data: what is common, and how it spreads."""
        entry = catalog.datasets().get(dataset)
        names: tuple[str, ...] = ()
        if self.output_type == "tabular":
            suited = reducers_for((entry or {}).get("data_type", "continuous"))
            names = tuple(dict.fromkeys(statistics)) if statistics is not None else tuple(n for n in ("mean", "std", "mode", "class_fraction") if n in suited)
            if not names:
                raise ValueError(f"no statistics are wanted of {dataset!r}")
        same = self.wanted.setdefault((metres(windows), names), [])
        if dataset not in same:
            same.append(dataset)
        return self

    def configs(self) -> list[dict[str, Any]]:
        """The runs, as extract() takes them."""
        if not self.wanted:
            raise ValueError("nothing is wanted yet")
        out = []
        for (windows, names), datasets in self.wanted.items():
            shape = {"statistics": list(names)} if self.output_type == "tabular" else {"resample_m": PIXEL}
            code = hashlib.md5(repr((windows, names, datasets)).encode()).hexdigest()[:6]
            batch = f"{self.output_type}-{'-'.join(f'{w}m' for w in windows)}-{code}"
            out.append({"batch_id": batch, "datasets": list(datasets), "settings": {"output_type": self.output_type, "window_size_m": list(windows), **shape, **self.settings}})
        return out

    def run(self, points: DataFrame, output_dir: str, input_crs: str | int | None = None, **more: Any) -> Any:
        """extract() for all runs over a table of occurrences, whose coordinates may be texts; ``more`` goes to extract().

        A table without rows, or with coordinates that are no numbers, is a ValueError that says how many.
        """
        place = [more.get(k, d) for k, d in (("latitude_column", "decimalLatitude"), ("longitude_column", "decimalLongitude"))]
        point_source.require_columns(points, place)
        number = {c: F.col(f"`{c}`").cast("string").try_cast("double") for c in place}
        rows, odd = points.agg(F.count("*"), F.count_if(number[place[0]].isNull() | number[place[1]].isNull())).first()
        if not rows or odd:
            raise ValueError(f"{odd} of {rows} rows have no number for a coordinate" if odd else "the table has no rows")
        return runs.extract(points.withColumns(number), self.configs(), output_dir=output_dir, input_crs=crs.normalize(input_crs), **more)
