"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._session import cut, discard


def _with_least(edges: DataFrame, own: bool, dealt: bool, per_group: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (a, b) with m, the smallest neighbour of a (or a itself, with ``own``); and the table (a, m).

    The smallest comes from an aggregation with map-side combine.  ``dealt``: the
    edges meet it by the node and the number of a group, of which a hub has one for
    each ``per_group`` of its edges.
    """
    low = edges.groupBy("a").agg(
        (F.least(F.min("b"), F.col("a")) if own else F.min("b")).alias("m"),
        F.ceil(F.count("*") / per_group).cast("int").alias("groups")
    )
    if not dealt:
        return edges.join(low.drop("groups"), "a"), low.select("a", "m")
    hubs = low.where("groups > 1").select("a", "groups")  # as many as there are edges over per_group, at most
    numbered = edges.join(F.broadcast(hubs), "a", "left").select(
        "a", "b",
        F.when(F.col("groups") > 1, F.pmod(F.xxhash64("b"), F.col("groups"))).otherwise(0).cast("int").alias("part")
    )
    spread = low.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    return numbered.join(spread, ["a", "part"]).drop("part"), low.select("a", "m")


def components(edges: DataFrame, folder: str, name: str, max_rounds: int = 60, per_group: int = 1_000_000) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b: long), component = its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    node hooks its larger, then its smaller neighbours to the smallest one, so
    the number of rounds grows with the logarithm of the longest chain.  Where a
    node can have more than ``per_group`` edges, hubs' edges are dealt to groups of
    that size, so no node's neighbours are ever gathered in one place.  Each
    round is written to the shared folder.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now, folder, f"{name}-0")
    mark: tuple = (now.count(),)
    for k in range(max_rounds):
        dealt = mark[0] > per_group
        found, _ = _with_least(both(now), True, dealt, per_group)
        large = found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        found, low = _with_least(large, False, dealt, per_group)
        hooked = found.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = hooked.unionByName(low.select("a", F.col("m").alias("b"))).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
        now = cut(small, folder, f"{name}-{k + 1}")
        discard(edges.sparkSession, folder, f"{name}-{k}")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
