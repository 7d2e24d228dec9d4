"""Pixel grids: the affine header of a raster and index arithmetic as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    """x = a*col + b*row + c, y = d*col + e*row + f, of pixel corners; bands have names and nodata values."""

    width: int
    height: int
    a: float
    e: float
    c: float = 0.0
    f: float = 0.0
    b: float = 0.0
    d: float = 0.0
    crs: int | None = None
    bands: tuple[str, ...] = ("b1",)
    nodata: tuple[float | None, ...] = (None,)
    dtype: str = "float64"

    @property
    def rotated(self) -> bool:
        return bool(self.b or self.d)

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional row and column of a place."""
        det = self.a * self.e - self.b * self.d
        dx, dy = x - self.c, y - self.f
        return (dy * self.a - dx * self.d) / det, (dx * self.e - dy * self.b) / det

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        """x and y of a pixel's centre."""
        return self.a * (col + 0.5) + self.b * (row + 0.5) + self.c, self.d * (col + 0.5) + self.e * (row + 0.5) + self.f


def centres_between(low: Column, high: Column) -> tuple[Column, Column]:
    """First and last index whose centre (index + 0.5) lies in [low, high)."""
    return F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")


def touched_between(low: Column, high: Column) -> tuple[Column, Column]:
    """First and last index of the cells that an interval touches."""
    return F.floor(low).cast("int"), (F.ceil(high) - 1).cast("int")


def snap(x: Column, step: float) -> Column:
    """To a multiple of the step, halves up."""
    return F.floor(x / step + 0.5) * step


def snap_even(x: Column, step: float) -> Column:
    """To a multiple of the step, halves to even."""
    return F.rint(x / step) * step


def geometric_cells(window: float, native: float) -> int:
    """Cells that a window holds by its area; at least one."""
    return max(1, round((max(window, native) / native) ** 2))


def effective_window(window: int, native: float) -> int:
    """A window of less than a pixel grows to two pixels."""
    return int(native * 2) if window < native else window
