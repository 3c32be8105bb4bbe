"""Exact quantiles of groups of any size by refined histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantjobs.sources.tables import scratch

#: Bins of a histogram, and rows of an interval that are sorted instead of counted again.
BINS, FEW = 1024, 10_000


def exact_quantiles(df: DataFrame, keys: list[str], col: str, wanted: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, one column for each of ``wanted`` name -> share): quantiles of the numbers that are neither null nor NaN, linear between neighbours.

    A group's wanted places start with the interval from its least to its greatest number. While an interval holds
    more than ``few`` rows and more than one number, its rows are counted in bins and the bin of the place, from its
    own least to its greatest number, becomes the next interval. What is left is sorted, at most ``few`` rows of a
    place in a task. Groups without numbers are left out. Without keys there is one group.
    """
    named = keys or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if not keys else df
    rows = rows.select(*named, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sizes = rows.groupBy(*named).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    at = [F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_n") - 1)).alias("h")) for name, p in wanted.items()]
    asked = sizes.withColumn("_a", F.explode(F.array(*at))).select(*named, "_low", "_high", F.col("_n").alias("_rows"), "_a.*")
    sides = F.array_distinct(F.array(F.floor("h"), F.ceil("h")))
    places = scratch(asked.select(*named, "_low", "_high", "_rows", F.explode(sides.cast("array<bigint>")).alias("_place")).distinct().withColumn("_below", F.lit(0).cast("bigint")), "places")
    asked = scratch(asked.select(*named, "name", "h"), "asked")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in named]

    def inside(state: DataFrame) -> DataFrame:
        r, s = rows.alias("r"), state.alias("s")
        cond = (F.col("r._x") >= F.col("s._low")) & (F.col("r._x") <= F.col("s._high"))
        for k in named:
            cond &= F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
        return r.join(s, cond).select(*[F.col(f"s.{k}").alias(k) for k in named], "s._place", "s._below", "s._low", "s._high", "r._x")

    wide = (F.col("_rows") > few) & (F.col("_low") < F.col("_high"))
    done, now = places.where(~wide), places.where(wide)
    while not now.isEmpty():
        share = (F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)  # halves, as a difference may overflow
        binned = inside(now).withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy(*named, "_place", "_below", "_bin").agg(F.count("*").alias("_rows"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*named, "_place").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most bins rows
        next_ = counts.withColumn("_first", F.col("_below") + before).where((F.col("_first") <= F.col("_place")) & (F.col("_place") < F.col("_first") + F.col("_rows")))
        now = scratch(next_.select(*named, "_low", "_high", "_rows", "_place", F.col("_first").cast("bigint").alias("_below")), "places")
        done, now = done.unionByName(now.where(~wide)), now.where(wide)
    flat = done.where("_low = _high").select(*named, "_place", F.col("_low").alias("_x"))
    order = Window.partitionBy(*named, "_place").orderBy("_x")  # at most `few` rows
    sorted_ = inside(done.where("_low < _high")).withColumn("_k", F.row_number().over(order) - 1).where(F.col("_k") == F.col("_place") - F.col("_below")).select(*named, "_place", "_x")
    found = flat.unionByName(sorted_)
    pairs = asked.alias("a").join(found.alias("f"), [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in named] + [(F.col("f._place") == F.floor("a.h")) | (F.col("f._place") == F.ceil("a.h"))])
    low, high = F.min_by("f._x", "f._place"), F.max_by("f._x", "f._place")
    part = F.col("h") - F.floor("h")
    each = pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in named], F.col("a.name").alias("name"), F.col("a.h").alias("h")).agg(low.alias("_l"), high.alias("_u")).withColumn("_q", F.when(part == 0, F.col("_l")).otherwise((1 - part) * F.col("_l") + part * F.col("_u")))
    out = each.groupBy(*named).agg(*[F.max(F.when(F.col("name") == name, F.col("_q"))).alias(name) for name in wanted])
    return out.select(*keys, *wanted)
