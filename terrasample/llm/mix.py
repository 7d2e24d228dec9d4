"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over
its share of the input.  A document's number of copies is the Poisson quantile
of a uniform number that a keyed hash of its id gives, so the same document
always gets the same copies, whatever the partitions.  Copies are exploded and
dealt out in the order of a second hash, which shuffles all sources together.

Only the counts of the named sources reach the driver, as many rows as there
are weights.  The dealing key is unique to a copy, so a source with most of the
rows doesn't skew it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that make the uniform number (exact in a double).
_BITS = 52


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:part:...); the same in any SQL engine with md5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << _BITS))


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until nothing measurable is left."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while k <= rate or total < 1 - 1e-15:
        total = min(1.0, total + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)))
        out.append(total)
        if k > rate + 12 * math.sqrt(rate) + 40:
            break
        k += 1
    return out


#: The largest mean of one Poisson draw; a greater rate is the sum of as many draws as it takes, whose counts are Poisson too.
LARGEST = 50.0


def draws(rate: float) -> int:
    return max(1, math.ceil(rate / LARGEST))


def rates(counts: Mapping[str | None, int], weights: Mapping[str, float], size: float = 1.0) -> dict[str | None, float]:
    """Mean repetitions of each source so that the output has about ``size`` times the input's rows in the target shares.

    Sources without a weight share what the named weights leave of 1, in
    proportion to their rows.  Named sources without rows are passed over.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must not be negative and must add up to at most 1")
    total = sum(counts.values())
    rest = sum(n for s, n in counts.items() if s not in weights)
    left = max(0.0, 1 - sum(weights.values()))
    return {s: (weights[s] / n if s in weights else left / rest) * total * size for s, n in counts.items() if n}


def poisson_mix(
    docs: DataFrame, weights: Mapping[str, float], *, size: float = 1.0, seed: str = "mix", id_col: str = "doc_id",
    source_col: str = "source", shuffle: bool = True, describe: bool = True
) -> DataFrame:
    """``docs`` with each row as often as the Poisson quantile says, shuffled.

    Adds (with ``describe``) rate, copies (the row's number of copies), copy
    (0-based) and position, the uniform number by which copies are dealt out
    and sorted within each partition.  Columns so named are replaced.

    Null source: one of the unnamed sources.  Null id: hashed as the text
    "null".  Rows with the same id get the same number of copies.  Texts aren't
    read, however long.  Repeated rows are each replicated.  An empty table gives an
    empty table.
    """
    named = F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")
    counts = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}
    rate_of = rates(counts, weights, size)
    rate, n_draws, cdf = F.lit(0.0), F.lit(1), F.array(F.lit(1.0))
    for s, r in sorted(rate_of.items(), key=lambda x: str(x[0])):
        is_s = named.eqNullSafe(F.lit(s))
        rate = F.when(is_s, F.lit(r)).otherwise(rate)
        n_draws = F.when(is_s, F.lit(draws(r))).otherwise(n_draws)
        cdf = F.when(is_s, F.array(*(F.lit(p) for p in poisson_cdf(r / draws(r))))).otherwise(cdf)
    own = [c for c in docs.columns if c not in ("rate", "copies", "copy", "position")]
    out = docs.select(
        *(f"`{c}`" for c in own), rate.alias("rate"), cdf.alias("__cdf"), n_draws.alias("__n"),
        uniform(seed, F.col(id_col)).alias("__u")
    )
    below = lambda u: F.size(F.filter("__cdf", lambda p: u >= p))
    copies = below(F.col("__u"))
    if any(draws(r) > 1 for r in rate_of.values()):  # further draws have their number in their seed
        numbered = F.transform(F.sequence(F.lit(1), F.col("__n") - 1), lambda k: uniform(seed, F.col(id_col), k))
        copies += F.when(F.col("__n") > 1, F.aggregate(numbered, F.lit(0), lambda s, u: s + below(u))).otherwise(0)
    out = out.withColumn("copies", copies.cast("bigint")).where("copies > 0").drop("__cdf", "__n", "__u")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    if shuffle or describe:
        out = out.withColumn("position", uniform(seed + "-order", F.col(id_col), F.col("copy")))
    if shuffle:
        # the position is uniform, so equal stretches of it are equal shares: no sampling pass over the texts
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.withColumn(
            "__part", F.floor(F.col("position") * n).cast("int")
        ).repartitionById(n, "__part").sortWithinPartitions("position", id_col).drop("__part")
    return out if describe else out.select(*(f"`{c}`" for c in own))
