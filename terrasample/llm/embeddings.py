"""Embedding near-duplicates: spherical k-means cells, blocked cosines, one kept vector per group.

Only vectors of one length can link, so each length (there are few) has its own
cells.  Equal vectors are one class first, with its size.  Spherical k-means, fitted on a
bounded sample (``sample_rows``), gives the cells; every class goes to its nearest
centroid's cell (its home) and as a guest to other cells where a link could
cross the border: for unit vectors x (home a) and y (home b) with
|x - y| <= r = sqrt(2 - 2 * threshold), y . (c_b - c_a) <= r * |c_b - c_a| must hold, so
guests that fail it are not sent.  That makes the search exact, whatever the
centroids.  Of two cells only one receives the other's guests, so each pair of
classes is compared once and counts for both.

A block of homes meets a block of homes or guests of its cell in one task; blocks
are cut by a hash of the id to ``block_bytes``, so memory is bounded for a cell
of any size.  Within a task the vectors are rotated to the principal axes of the
sample, and the product of the leading components plus that of the rests' norms,
which no cosine exceeds, drops most pairs at a fraction of the work.  What is
left is computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._graph import components
from terrasample.llm._session import cut, discard, lean, shared_folder, ship

#: More than the error of a single-precision product of unit vectors of some thousand components.
MARGIN = 2e-4


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit vectors, from evenly spaced rows; empty cells keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def principal_axes(x: np.ndarray) -> np.ndarray:
    """The sample's axes as columns, the one with the most of the vectors' length first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def leading(dim: int) -> int:
    """How many rotated components bound a cosine before all are used."""
    return min(dim, max(16, dim // 4))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as double-precision unit vectors; their lengths are known to be ``dim``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def bounds_of(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The leading rotated components of unit vectors and the norm of the rest: their product is at least the cosine."""
    first = x @ axes[:, : leading(x.shape[1])]
    rest = np.sqrt(np.maximum(0, 1 - np.square(first).sum(1, keepdims=True)))
    return np.concatenate((first, rest), 1).astype(np.float32)


def links_of(home: np.ndarray, other: np.ndarray, threshold: float, home_bound: np.ndarray, other_bound: np.ndarray) -> np.ndarray:
    """Which rows of two sets of unit vectors have a cosine of ``threshold`` or more in double precision."""
    link = np.zeros((len(home), len(other)), bool)
    r, c = np.nonzero(home_bound @ other_bound.T >= threshold - MARGIN)
    if len(r) > link.size // 50:  # a dense group: all products are less work than so many single ones
        near = home.astype(np.float32) @ other.astype(np.float32).T
        link = near >= threshold + MARGIN
        r, c = np.nonzero((near >= threshold - MARGIN) & ~link)
    for i in range(0, len(r), 50_000):
        a, b = r[i : i + 50_000], c[i : i + 50_000]
        link[a, b] = np.einsum("ij,ij->i", home[a], other[b]) >= threshold
    return link


def spanning_edges(link: np.ndarray, home_id: np.ndarray, other_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``link`` connects: all of them where there are no more than vectors, else a breadth-first forest."""
    if np.count_nonzero(link) <= sum(link.shape):
        r, c = np.nonzero(link)
        return home_id[r], other_id[c]
    left, a, b = link.any(1), [], []
    while left.any():
        rows = np.zeros(len(left), bool)
        rows[left.argmax()] = True
        cols = np.zeros(link.shape[1], bool)
        new = rows
        while new.any():
            more = link[new].any(0) & ~cols
            cols |= more
            new = link[:, more].any(1) & ~rows if more.any() else np.zeros(len(rows), bool)
            rows = rows | new
        root = home_id[rows.argmax()]
        ids = np.concatenate((home_id[rows], other_id[cols]))
        a.append(np.full(len(ids), root)), b.append(ids)
        left &= ~rows
    return np.concatenate(a), np.concatenate(b)


def _receives(cell: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Of two different cells, whether the first gets the other's guests: so each cell gets those of about half of the others."""
    return np.where((cell + home) % 2 == 1, cell < home, cell > home)


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
    cell_rows: int = 4096, block_bytes: int = 8 << 20, max_cells: int = 4096, sample_rows: int = 20_000
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing, and so does a row with a null id (its component and kept are null
    and true).  Vectors link only with those of their own length.  Equal vectors link,
    and repeated rows are rows of one class.  Extra columns aren't read; an empty
    table gives an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    folder, partitions = shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("v")
    number = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # as it came: half the bytes to shuffle
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{number}>").alias("v"))
    finite = v.isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    ) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("id").isNotNull() & finite, F.lit(False))
    marked = rows.select("id", F.when(good, v).alias("v"))
    classes = cut(marked.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m")), folder, "classes")
    lengths = {r["d"]: r["count"] for r in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()}  # vectors have few lengths
    n_classes = sum(lengths.values())
    share = min(1.0, sample_rows / max(1, n_classes))
    sample = classes.where(
        F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    ).select("rep", "v").toArrow().sort_by("rep").column("v").combine_chunks()
    sizes = sample.value_lengths().to_numpy(zero_copy_only=False)
    centroids: dict[int, tuple[int, np.ndarray]] = {}  # of each length: the number of its first cell, and its cells
    axes: dict[int, np.ndarray] = {}
    for dim, n in lengths.items():
        cells = int(min(max(1, max_cells * n // n_classes), max(1, -(-n // cell_rows))))
        own = sample.take(pa.array(np.flatnonzero(sizes == dim)))
        unit = _unit(own, dim) if len(own) else np.full((1, dim), dim**-0.5)
        centroids[dim] = sum(len(c) for _, c in centroids.values()), spherical_kmeans(unit, min(cells, len(unit)))
        axes[dim] = principal_axes(unit)
    shared = spark.sparkContext.broadcast((centroids, axes))
    radius = math.sqrt(2 - 2 * threshold)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                first, c = shared.value[0][dim]
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                for i in range(0, len(own), 512):
                    part = own.slice(i, 512)
                    x = _unit(part.column("v"), dim)
                    dot = x @ c.T
                    home = dot.argmax(1)
                    gap = dot[np.arange(len(x)), home][:, None] - dot
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
                    row, cell = np.nonzero(gap <= radius * apart + 1e-9)
                    mine = home[row] == cell
                    some = mine | _receives(cell, home[row])
                    row, cell, mine = row[some], cell[some], mine[some]
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("rep").take(at), part.column("m").take(at),
                            pa.array((first + cell).astype(np.int32)), pa.array(mine), part.column("v").take(at)
                        ],
                        names=["rep", "m", "cell", "home", "x"]
                    )

    placed = cut(
        classes.select("rep", "m", "v").mapInArrow(lean(assign), f"rep bigint, m bigint, cell int, home boolean, x array<{number}>"),
        folder, "placed"
    )
    # so many rows that a block's double-precision vectors have block_bytes
    rows_in = F.greatest(F.lit(8), F.floor(F.lit(block_bytes) / (8 * F.first(F.size("x")))))
    count = placed.groupBy("cell").agg(
        F.ceil(F.count_if("home") / rows_in).alias("nh"), F.ceil(F.count_if(~F.col("home")) / rows_in).alias("ng")
    ).where("nh > 0")  # a row per cell, at most max_cells and one for each length
    where = placed.join(F.broadcast(count), "cell").withColumn("h", F.xxhash64("rep", F.lit(9)))
    # block i of the homes meets the homes' blocks j >= i (numbers from 0) and all guests' blocks (numbers from nh)
    mine, zero = F.pmod("h", F.col("nh")), F.lit(0).cast("bigint")
    left = where.where("home").select("cell", mine.alias("i"), "nh", "ng", "rep", "m", "x").select(
        "cell", "i", F.explode(F.sequence(F.col("i"), F.col("nh") + F.col("ng") - 1)).alias("j"),
        F.lit(True).alias("side"), "rep", "m", "x"
    )
    right = where.where("home").select("cell", mine.alias("j"), "rep", "m", "x").where("j > 0").select(
        "cell", F.explode(F.sequence(zero, F.col("j") - 1)).alias("i"), "j", F.lit(False).alias("side"), "rep", "m",
        "x"
    )
    guests = where.where("not home").select(
        "cell", F.explode(F.sequence(zero, F.col("nh") - 1)).alias("i"),
        (F.col("nh") + F.pmod("h", F.col("ng"))).alias("j"), F.lit(False).alias("side"), "rep", "m", "x"
    )

    def compare(table):
        side = table.column("side").to_numpy()
        x = table.column("x").combine_chunks()
        x = _unit(x, len(x[0]))  # a cell's vectors have one length
        rep, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
        bound = bounds_of(x, shared.value[1][x.shape[1]])
        alone = side.all()  # a block against itself
        other = np.flatnonzero(side if alone else ~side)
        total, a, b = np.zeros(len(rep), np.int64), [], []
        for i in range(0, int(side.sum()), 512):
            own = np.flatnonzero(side)[i : i + 512]
            for j in range(0, len(other), 16_384):
                those = other[j : j + 16_384]
                if alone:
                    those = those[those > own[0]] if len(own) else those
                link = links_of(x[own], x[those], threshold, bound[own], bound[those])
                if alone:
                    link &= own[:, None] < those[None, :]  # each pair once
                total[own] += link @ m[those]
                total[those] += m[own] @ link
                e = spanning_edges(link, rep[own], rep[those])
                a.append(e[0]), b.append(e[1])
        some = np.flatnonzero(total)
        edges = np.stack((np.concatenate(a), np.concatenate(b))) if a else np.zeros((2, 0), np.int64)
        is_count = np.arange(len(some) + edges.shape[1]) < len(some)
        first = np.concatenate((rep[some], edges[0])).astype(np.int64)
        second = np.concatenate((np.zeros(len(some), np.int64), edges[1])).astype(np.int64)
        return pa.table(
            {
                "a": first, "b": pa.array(second, mask=is_count),
                "n": pa.array(np.concatenate((total[some], np.zeros(edges.shape[1], np.int64))), mask=~is_count)
            }
        )

    found = cut(
        left.unionByName(right).unionByName(guests).groupBy("cell", "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint"),
        folder, "found"
    )
    discard(spark, folder, "placed")
    linked = components(found.where("b is not null").select("a", "b"), folder, "components")
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    done = classes.join(counts, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left").select(
        "v", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("c")
    )
    # rows meet their class by the vector's hash and the vector itself; those that link with nothing stay apart
    hashed = lambda d: d.withColumn("k", F.xxhash64("v"))
    some = hashed(marked.where("v is not null")).join(hashed(done), ["k", "v"]).select("id", "n_links", F.col("c").alias("component_id"))
    none = marked.where("v is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return some.unionByName(none).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept")
    )
