"""As-of joins of dated rows with the images of a collection.

A sort-merge over range partitions: the distinct times of the rows and the images'
starts are dealt to ranges of key and time and written with their range's number.
Within a range a window finds the last start before and the first after each time;
what a range can't know is carried over from the ranges before and behind it, a row
for each key and range.  No task has a key's whole calendar, no row is compared with
more than its neighbours, and every row meets its time in one equi-join.

Times are whole microseconds: of dates (midnight), timestamps, or epoch milliseconds
where the column is an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasample.functions import dates
from terrasample.sources.shared import cut, shared_folder, sized

#: The columns that a match adds.
PICKED = ("image_id", "image_time_start", "image_time_end", "date_clamped", "date_source")
POLICIES = ("nearest", "contains")
#: Columns of an image's footprint, in degrees; a west beyond the east crosses the antimeridian.
FOOTPRINT = ("west", "south", "east", "north")
#: The finest level of footprint cells: 360 degrees halved so many times.
FINEST = 16
#: Times of rows and images in a range, about.
TIMES_A_RANGE = 1 << 18


def _kinds(rows: DataFrame, images: DataFrame, date_col: str) -> tuple[str, str, str]:
    """Types of the images' starts and ends, and that in which the rows' dates are compared: days with days."""
    own = dict(images.dtypes)
    asked = dict(rows.dtypes)[date_col]
    start = own["time_start"]
    return start, own["time_end"], "date" if start == "date" or not asked.startswith("timestamp") else asked


def _starts(images: DataFrame, key: Column, kinds: tuple[str, str, str]) -> DataFrame:
    """k, and lo and hi, the first and last by end and id of the images of one start: structs s, e, i."""
    v = F.struct(
        dates.micros(F.col("time_start"), kinds[0]).alias("s"), dates.micros(F.col("time_end"), kinds[1]).alias("e"), F.col("image_id").alias("i")
    )
    return images.where("time_start is not null").select(key.alias("k"), v.alias("v")).groupBy("k", F.col("v.s").alias("s")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")
    )


def _neighbours(asked: DataFrame, starts: DataFrame) -> DataFrame:
    """For each distinct k and t of ``asked``: prev_lo and prev_hi (started by t), next (after it), first, second (a start) and last of all of k.

    Written to the shared folder once; null where there is none, and for a null t all but first, second and last.
    """
    spark = asked.sparkSession
    none = F.lit(None).cast(starts.schema["lo"].dataType)
    both = starts.select("k", F.col("s").alias("t"), F.lit(0).alias("asked"), "lo", "hi").unionByName(
        asked.select("k", "t").distinct().select("k", "t", F.lit(1).alias("asked"), none.alias("lo"), none.alias("hi"))
    )
    # written first: dealing to ranges samples it, and its size gives their number, so that no task's times grow with the rows
    folder = shared_folder(spark)
    both = cut(both, folder, "times")
    times = both.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), times // TIMES_A_RANGE + 1)
    # written with its range's number, which is then the same for all that follows
    laid = cut(both.repartitionByRange(n, "k", "t").withColumn("range", F.spark_partition_id()), folder, "as-of")
    laid = laid.repartition(n, "k", "range")
    each = Window.partitionBy("k", "range")
    own = each.orderBy("t", "asked")  # images before the rows of their time: "by t" has both
    # what lies behind is what came before in the opposite order: a frame that only grows, its value is carried on, while one that shrinks is read anew for each row
    behind = each.orderBy(F.desc("t"), F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1)
    found = laid.select(
        "k", "range", "t", "asked", F.last("lo", True).over(own).alias("lo"), F.last("hi", True).over(own).alias("hi"),
        F.last("lo", True).over(behind).alias("next")
    ).where("asked = 1")
    edge = laid.groupBy("k", "range").agg(F.min("lo").alias("least"), F.max("lo").alias("most_lo"), F.max("hi").alias("most_hi"))
    along = Window.partitionBy("k")  # a key has a row in each range at most
    before = along.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    after = along.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select(
        F.col("k").alias("_k"), F.col("range").alias("_range"), F.max("most_lo").over(before).alias("from_lo"), F.max("most_hi").over(before).alias("from_hi"),
        F.min("least").over(after).alias("to"), F.min("least").over(along).alias("first"), F.max("most_hi").over(along).alias("last"),
    )
    low = edge.groupBy(F.col("k").alias("_k1")).agg(F.min("least.s").alias("s0"))
    second = laid.where("asked = 0").join(low, F.col("k") == F.col("_k1")).where("t > s0").groupBy(F.col("k").alias("_k2")).agg(F.min("t").alias("second"))
    # rows have their range's number, and each task its ranges: merged where they lie
    carried = sized(carried.join(second, F.col("_k") == F.col("_k2"), "left"), times)
    known = F.col("t").isNotNull()
    return found.join(carried, (F.col("k") == F.col("_k")) & (F.col("range") == F.col("_range"))).select(
        "k", "t", F.when(known, F.coalesce("lo", "from_lo")).alias("prev_lo"), F.when(known, F.coalesce("hi", "from_hi")).alias("prev_hi"),
        F.when(known, F.coalesce("next", "to")).alias("next"), "first", "second", "last"
    )


def _decided(near: DataFrame, policy: str, kinds: tuple[str, str, str]) -> DataFrame:
    """``near`` (t and what :func:`_neighbours` finds) with the columns of PICKED by a policy."""
    t = F.col("t")
    if policy == "nearest":
        later = F.col("next.s") - t <= t - F.col("prev_lo.s")
        found = F.when(F.col("prev_lo").isNull() | later, F.coalesce("next", "prev_lo")).otherwise(F.col("prev_lo"))
        clamped, inside = (t < F.col("first.s")) | (t > F.col("last.s")), "nearest_to_sample"
    else:
        found = F.coalesce("prev_hi", "first")
        clamped, inside = (t <= F.col("first.s")) | (t >= F.col("last.s")), "contains_sample_date"
    source = F.when(F.col("last").isNull(), None).when(t.isNull(), "most_recent_no_date").when(clamped, "clamped_to_nearest").otherwise(inside)
    v = F.when(t.isNull(), F.col("last")).otherwise(found)
    after = F.when(t.isNull(), None).when(F.col("prev_hi").isNull(), F.col("second")).otherwise(F.col("next.s"))
    end = v["e"] if policy == "nearest" else F.coalesce(v["e"], after, v["s"] + dates.DAY)
    return near.withColumns({
        "image_id": v["i"], "image_time_start": dates.of_micros(v["s"], kinds[0]), "image_time_end": dates.of_micros(end, kinds[1]),
        "date_clamped": F.coalesce(clamped, F.lit(False)), "date_source": source,
    })


def _checked(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"Unknown date policy {policy!r}: use nearest or contains")


def _key(keys: tuple[str, ...]) -> Column:
    """A row's key as one value that nulls are equal in."""
    return F.struct(*(F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))


def match_images(rows: DataFrame, images: DataFrame, policy: str = "nearest", date_col: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with image_id, image_time_start, image_time_end, date_clamped and date_source.

    nearest: the image that starts closest (a tie: the later); before the first
    or after the last start it is clamped.  contains: the last image that starts
    by the date; at the bounds and beyond it counts as clamped.  Rows without a
    date get the most recent image.  image_time_end is the image's own end; for
    contains without one, the next image's start or a day after its own.

    Starts and ends are dates, timestamps or epoch milliseconds (integers).  With dates rows are
    matched by their day; else timestamps to the microsecond and dates by their midnight, so of several
    images of a day the right one is taken.  The added times have the images' types,
    timestamps for milliseconds.

    ``keys`` are columns of both tables: a row is matched only with images of its
    own key (tiles of a collection by their zone), null with null.  Images without a start can't be
    matched; where none has one, or there are no images, all rows stay and these columns are null
    (date_clamped false).  Eager: the distinct times are written to the shared folder.
    """
    _checked(policy)
    kinds = _kinds(rows, images, date_col)
    asked = rows.withColumns({"_k": _key(keys), "_t": dates.micros(F.col(date_col).cast(kinds[2]), kinds[2])})
    near = _neighbours(asked.select(F.col("_k").alias("k"), F.col("_t").alias("t")), _starts(images, _key(keys), kinds))
    found = _decided(near, policy, kinds).select(F.col("k").alias("_fk"), F.col("t").alias("_ft"), *PICKED)
    own = [c for c in rows.columns if c not in PICKED]
    mine = asked.select("_k", "_t", *(F.col(f"`{c}`") for c in own))
    joined = mine.join(found, (F.col("_k") == F.col("_fk")) & F.col("_t").eqNullSafe(F.col("_ft")), "left")
    return joined.select(
        *(F.col(f"`{c}`") for c in own), "image_id", "image_time_start", "image_time_end",
        F.coalesce("date_clamped", F.lit(False)).alias("date_clamped"), "date_source"
    )


def footprint_cells(feet: DataFrame) -> DataFrame:
    """``feet`` with a row (level, cx, cy) for each cell that a footprint touches: four at most, eight across the antimeridian.

    A footprint is in the cells of the level whose cells are just larger than it, so a
    global one has a single cell and a tiny one doesn't stand among all others.
    """
    span = F.when(F.col("west") <= F.col("east"), F.col("east") - F.col("west")).otherwise(F.col("east") - F.col("west") + 360)
    side = F.greatest(span, F.col("north") - F.col("south"), F.lit(360.0 / (1 << FINEST)))
    level = F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(360.0) / side)))).cast("int")
    piece = lambda west, east: F.struct(west.cast("double").alias("w"), east.cast("double").alias("e"))
    pieces = F.when(F.col("west") <= F.col("east"), F.array(piece(F.col("west"), F.col("east")))).otherwise(
        F.array(piece(F.col("west"), F.lit(180)), piece(F.lit(-180), F.col("east")))
    )
    cells = feet.withColumn("level", level).withColumn("_p", F.explode(pieces))
    each = lambda lo, hi: F.explode(F.sequence(lo, hi))
    cells = cells.withColumn("cx", each(_cell(F.col("_p.w"), 180, F.col("level")), _cell(F.col("_p.e"), 180, F.col("level"))))
    cells = cells.withColumn("cy", each(_cell(F.col("south"), 90, F.col("level")), _cell(F.col("north"), 90, F.col("level"))))
    return cells.drop("_p").distinct()


def _cell(degrees: Column, shift: int, level: Column) -> Column:
    return F.floor((degrees + shift) / (F.lit(360.0) / F.pow(F.lit(2.0), level))).cast("int")


def covering(rows: DataFrame, images: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (with lat and lon) times the distinct footprints that hold them (and share ``keys``), as a column footprint.

    Rows meet footprints by the cells of :func:`footprint_cells`: an equi-join in which a row has a
    key for each level that there is.
    """
    name = F.concat_ws(",", *(F.col(c).cast("string") for c in FOOTPRINT))
    feet = images.select(*FOOTPRINT, *keys).distinct().withColumn("footprint", name)
    cells = footprint_cells(feet).select("level", "cx", "cy", "footprint", *FOOTPRINT, _key(keys).alias("_fk"))
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # FINEST + 1 at most
    placed = rows.withColumn("level", F.explode(F.array(*(F.lit(x) for x in sorted(levels))).cast("array<int>")))
    placed = placed.withColumns({"cx": _cell(F.col("lon"), 180, F.col("level")), "cy": _cell(F.col("lat"), 90, F.col("level")), "_rk": _key(keys)})
    lon = F.col("lon")
    across = F.when(F.col("west") <= F.col("east"), lon.between(F.col("west"), F.col("east"))).otherwise((lon >= F.col("west")) | (lon <= F.col("east")))
    held = placed.join(cells, ["level", "cx", "cy"]).where(across & F.col("lat").between(F.col("south"), F.col("north")) & (F.col("_rk") == F.col("_fk")))
    # a footprint across the antimeridian has cells on both sides, a row at a cell's edge is in one: no pair comes twice
    return held.select(*(F.col(f"`{c}`") for c in rows.columns), "footprint")


def _covered(rows: DataFrame, images: DataFrame, keys: tuple[str, ...], folder: str) -> tuple[DataFrame, DataFrame]:
    """Places of ``rows`` that an image covers, as _at and _set, and the sets of footprints that hold them: _set, _k (a footprint and its keys).

    Both written to the shared folder; places in the same footprints share a set.
    """
    place = ("lat", "lon", *keys)
    held = covering(rows.select(*place).distinct(), images, keys)
    at = cut(held.groupBy(*place).agg(F.sort_array(F.collect_set("footprint")).alias("feet")), folder, "held")
    # a running number is the same for all that follows once it is written
    sets = sized(cut(at.select("feet", *keys).distinct().withColumn("_set", F.monotonically_increasing_id()), folder, "sets"))
    numbered = at.select(_key(place).alias("_at"), _key(("feet", *keys)).alias("_own")).join(sets.select("_set", _key(("feet", *keys)).alias("_own")), "_own")
    members = sets.select("_set", F.explode("feet").alias("footprint"), *keys).select("_set", _key(("footprint", *keys)).alias("_k"))
    return sized(cut(numbered.select("_at", "_set"), folder, "places")), members


#: Pairs of a time and a footprint that a task puts together, about.
PAIRS_A_TASK = 1 << 18


def match_covering(
    rows: DataFrame, images: DataFrame, policy: str = "nearest", key: str = "_row", date_col: str = "date", keys: tuple[str, ...] = ()
) -> DataFrame:
    """:func:`match_images` among the images whose footprint holds the row's place (lat, lon); ``key``, a row's name, isn't looked at.

    Rows in the same footprints at the same time have the same match: it is made once for each distinct set of footprints
    and time, however many rows there are.  Of each footprint of a set the neighbouring starts are found, these are put
    together, and only then the policy is applied: clamping, source and end are those of all images that
    cover the row.  Rows that no image covers stay, with nulls.  ``keys`` as for match_images.
    """
    _checked(policy)
    kinds = _kinds(rows, images, date_col)
    spark = rows.sparkSession
    folder = shared_folder(spark)
    places, members = _covered(rows, images, keys, folder)
    own = [c for c in rows.columns if c not in PICKED]
    placed = rows.withColumns({"_at": _key(("lat", "lon", *keys)), "_t": dates.micros(F.col(date_col).cast(kinds[2]), kinds[2])})
    placed = placed.select(*(F.col(f"`{c}`") for c in own), "_at", "_t").join(places, "_at", "left")
    asked = cut(placed.where("_set is not null").select("_set", "_t").distinct(), folder, "asked")
    pairs = asked.join(members, "_set")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // PAIRS_A_TASK + 1)
    named = images.withColumn("footprint", F.concat_ws(",", *(F.col(c).cast("string") for c in FOOTPRINT)))
    near = _neighbours(pairs.select(F.col("_k").alias("k"), F.col("_t").alias("t")), _starts(named, _key(("footprint", *keys)), kinds))
    near = sized(cut(near.where("last is not null"), folder, "near"))
    # what doesn't depend on the time is put together for each set alone
    ends = members.join(near.select(F.col("k").alias("_k"), "first", "second", "last").distinct(), "_k").withColumn("_s0", F.min("first.s").over(Window.partitionBy("_set")))
    over = lambda c: F.when(F.col(c) > F.col("_s0"), F.col(c))
    ends = ends.groupBy(F.col("_set").alias("_es")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.least(F.min(over("first.s")), F.min(over("second"))).alias("second")
    )
    # partitions by what there is: a task's sorted pairs don't grow with the rows
    met = pairs.repartition(parts, "_k", "_t").join(near.select("k", "t", "prev_lo", "prev_hi", "next"), (F.col("_k") == F.col("k")) & F.col("_t").eqNullSafe(F.col("t")))
    lo = F.col("prev_lo")
    merged = met.select("_set", "t", "prev_lo", "prev_hi", "next").repartition(parts, "_set", "t").groupBy("_set", "t").agg(
        F.min_by(lo, F.when(lo.isNotNull(), F.struct(-lo["s"], lo["e"], lo["i"]))).alias("prev_lo"), F.max("prev_hi").alias("prev_hi"), F.min("next").alias("next")
    )
    best = _decided(merged.join(ends, F.col("_set") == F.col("_es")), policy, kinds).select(F.col("_set").alias("_bs"), F.col("t").alias("_bt"), F.struct(*PICKED).alias("_v"))
    # rows that nothing covers meet nothing: dealt out, as one key would put them into one task
    dealt = F.coalesce("_set", -1 - F.pmod(F.xxhash64("_at", "_t"), F.lit(1 << 20)))
    joined = placed.join(best, (dealt == F.col("_bs")) & F.col("_t").eqNullSafe(F.col("_bt")), "left")
    return joined.select(
        *(F.col(f"`{c}`") for c in own),
        *(F.coalesce("_v.date_clamped", F.lit(False)).alias(c) if c == "date_clamped" else F.col(f"_v.{c}").alias(c) for c in PICKED)
    )


def undated(images: DataFrame) -> bool:
    """Whether no image of a collection has a start: it can't be matched by date."""
    return images.where("time_start is not null").isEmpty()


def date_info(matched: DataFrame) -> DataFrame:
    """One row: how many rows per date_source and the distinct image date ranges used, sorted."""
    count = lambda s: F.count_if(F.col("date_source") == s).alias(f"n_{s}")
    start, end = F.col("image_time_start"), F.coalesce("image_time_end", "image_time_start")
    used = F.array_sort(F.collect_set(F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"))))).alias("image_date_ranges_used")
    return matched.agg(*(count(s) for s in ("nearest_to_sample", "clamped_to_nearest", "most_recent_no_date", "contains_sample_date")), used)
