"""Named reducers as aggregate columns, and a registry for more.

Every reducer sees finite values only (see :func:`finite`) and is null over none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names: quantiles and classes of reducers.
QUANTILES = {"q05": 0.05, "q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q95": 0.95}
CLASS_REDUCERS = ("class_count", "class_fraction")
POINT = "point"
CONTINUOUS_ONLY = frozenset(["mean", "median", "min", "max", "sum", "std", "var", *QUANTILES])
CATEGORICAL_ONLY = frozenset(["mode", *CLASS_REDUCERS])


def finite(v: Column) -> Column:
    """``v``, or null where it isn't a finite number."""
    d = v.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def masked(v: Column, nodata: float | None) -> Column:
    """``v`` without the nodata value (which may be NaN) and without what isn't finite."""
    out = finite(v)
    return out if nodata is None or nodata != nodata else F.when(out != F.lit(float(nodata)), out)


def quantile(q: float) -> Callable[[Column], Column]:
    """A linearly interpolated, exact quantile reducer."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile must be between 0 and 1, not {q}")
    return lambda v: F.percentile(v, F.lit(q))


_scalar: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": lambda v: F.nullif(F.count(v), F.lit(0)),
    "mode": lambda v: F.mode(v, True),
    **{name: quantile(q) for name, q in QUANTILES.items()},
}


_builtin = dict(_scalar)


def register_reducer(name: str, reducer: Callable[[Column], Column]) -> None:
    """Add a scalar reducer: a function from the values' column to an aggregate column."""
    key = name.lower()
    if key == POINT or key in CLASS_REDUCERS:
        raise ValueError(f"{name} is reserved")
    _scalar[key] = reducer


@dataclass(frozen=True)
class ArrowReducer:
    """A reducer that no aggregate column expresses, in three parts over NumPy arrays.

    ``partial`` makes a state (an array of numbers of any length) of some values, ``merge`` one of two, ``finish`` the
    result (None for none).  Values are finite; a state is made of a window's values in one tile, so all
    that is held at once is a tile's values and two states, however large the window and however many
    windows are at one place.
    """

    partial: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float | None]


_arrow: dict[str, ArrowReducer] = {}


def register_arrow_reducer(name: str, reducer: ArrowReducer) -> None:
    """Add a reducer by its parts; in statistics it goes by its name like any other."""
    key = name.lower()
    if key == POINT or key in CLASS_REDUCERS or key in _scalar:
        raise ValueError(f"{name} is reserved")
    _arrow[key] = reducer


def arrow_reducer(name: str) -> ArrowReducer | None:
    return _arrow.get(name.lower())


def list_reducers() -> list[str]:
    """All names but point, sorted."""
    return sorted([*_scalar, *_arrow, *CLASS_REDUCERS])


def get(name: str) -> Callable[[Column], Column]:
    """A scalar reducer by its name, in any case."""
    if (key := name.lower()) not in _scalar:
        raise ValueError(f"Unknown reducer {name!r}. Available: {', '.join(list_reducers())}")
    return _scalar[key]


def share_of(name: str) -> float | None:
    """The share below a built-in quantile (of the median too); None for other and for replaced reducers."""
    key = name.lower()
    return {**QUANTILES, "median": 0.5}.get(key) if _scalar.get(key) is _builtin.get(key) else None


def is_scalar(name: str) -> bool:
    return name.lower() in _scalar


def is_builtin(name: str) -> bool:
    """Whether a scalar reducer is the package's own, not a caller's under its name."""
    return (key := name.lower()) in _builtin and _scalar.get(key) is _builtin[key]


def type_warnings(names: list[str], data_type: str) -> list[str]:
    """Reducers that don't suit a kind of data; they still run."""
    wrong = [n for n in names if n in (CONTINUOUS_ONLY if data_type == "categorical" else CATEGORICAL_ONLY if data_type == "continuous" else ())]
    return [f"reducer {n!r} isn't meant for {data_type} data" for n in wrong]


def round_half_even(c: Column, decimals: int) -> Column:
    """Scaled, rounded half to even and scaled back."""
    return F.rint(c * F.lit(10.0**decimals)) / F.lit(10.0**decimals)
