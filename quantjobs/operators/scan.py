"""Running sums, products, maxima and last values, and running affine maps, in two levels.

Rows of a key fall into calendar buckets. A bucket is scanned by itself, and what it adds up to is carried into the
later buckets of its key, of which there are as many as the calendar has. A key with most of the rows, or a table
without keys, is so spread over as many tasks as it has buckets, and no window spans more than a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Numbers of an ordering column that share a bucket.
NUMBERS = 4096


def bucket_of(df: DataFrame, order: str) -> Column:
    """The month of a date or timestamp, or a range of numbers, as a bigint that rises with the column."""
    kind = df.schema[order].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return (F.year(order) * 12 + F.month(order)).cast("bigint")
    if isinstance(kind, NumericType):
        return F.floor(F.col(order) / NUMBERS).cast("bigint")
    raise TypeError(f"{order} must be a date, a timestamp or a number")


def _filled(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.lit({"sum": 0, "product": 1.0}[kind]))


#: kind -> (aggregate of a bucket or of rows before it, combination of what is carried with what follows).
KINDS = {
    "sum": (F.sum, lambda a, b: _filled(a, "sum") + _filled(b, "sum")),
    "product": (F.product, lambda a, b: _filled(a, "product") * _filled(b, "product")),
    "max": (F.max, lambda a, b: F.greatest(a, b)),  # ignores nulls
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, keys: list[str], order: list[str], outs: dict[str, tuple[str, str]], before: bool = False) -> DataFrame:
    """``df`` with, for each name in ``outs`` of (column, kind), the running value up to each row, or up to the row before.

    Kinds: sum, product, max, last (the last value that is not null). Rows are ordered by ``order``, whose first column
    makes the buckets; its nulls come first. Null values change nothing; sums of none are 0, products 1, others null.
    Without keys the whole table is one sequence.
    """
    at = "_bucket"
    rows = df.withColumn(at, F.coalesce(bucket_of(df, order[0]), F.lit(-(2**62))))
    w = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    last_of = {out: (lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))) if kind == "last" else KINDS[kind][0] for out, (_, kind) in outs.items()}
    totals = rows.groupBy(*keys, at).agg(*[last_of[out](F.col(col)).alias(f"_c_{out}") for out, (col, _) in outs.items()])
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carried = totals.select(*keys, at, *[KINDS[kind][0](F.col(f"_c_{out}")).over(earlier).alias(f"_c_{out}") for out, (_, kind) in outs.items()])
    inside = rows.withColumns({f"_i_{out}": KINDS[kind][0](F.col(col)).over(w) for out, (col, kind) in outs.items()})
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*keys, at]])
    both = inside.alias("_l").join(carried.select(*keys, at, *[f"_c_{out}" for out in outs]).alias("_r"), same)
    kept = [F.col(f"_l.`{c}`") for c in df.columns if c not in outs]
    return both.select(*kept, *[KINDS[kind][1](F.col(f"_c_{out}"), F.col(f"_i_{out}")).alias(out) for out, (_, kind) in outs.items()])


def _folded(steps: Column, start: Column) -> Column:
    """The values of x -> m * x + a, step by step, after each of an array of (order, m, a)."""
    zero = F.struct(start.alias("x"), F.array().cast("array<double>").alias("xs"))

    def step(s: Column, t: Column) -> Column:
        x = t["m"] * s["x"] + t["a"]
        return F.struct(x.alias("x"), F.array_append(s["xs"], x).alias("xs"))

    return F.aggregate(steps, zero, step, lambda s: s["xs"])


def composed(steps: Column) -> Column:
    """(m, a): all of an array of maps x -> m * x + a, one after the other."""
    one = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("a"))
    return F.aggregate(steps, one, lambda s, t: F.struct((s["m"] * t["m"]).alias("m"), (t["m"] * s["a"] + t["a"]).alias("a")))


def affine(df: DataFrame, keys: list[str], order: str, m: str, a: str, out: str) -> DataFrame:
    """(keys, order, out): x after each date of a key, where x starts at 0 and a date maps it to m * x + a.

    ``df`` has one row a key and date. Dates are folded within months; a month's maps compose to one, and the months of
    a key are folded over these. No array is longer than a month, or than the months of the calendar.
    """
    step = F.struct(F.col(order).alias("d"), F.col(m).alias("m"), F.col(a).alias("a"))
    months = df.groupBy(*keys, bucket_of(df, order).alias("_bucket")).agg(F.array_sort(F.collect_list(step)).alias("_days"))
    whole = composed(F.col("_days"))
    runs = months.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_bucket").alias("d"), whole["m"].alias("m"), whole["a"].alias("a")))).alias("_months"))
    ends = runs.select(*keys, "_months", F.concat(F.array(F.lit(0.0)), _folded(F.col("_months"), F.lit(0.0))).alias("_x"))
    starts = ends.select(*keys, F.explode(F.arrays_zip(F.col("_months.d").alias("d"), F.slice("_x", F.lit(1), F.size("_months")).alias("x"))).alias("_s")).select(*keys, F.col("_s.d").alias("_bucket"), F.col("_s.x").alias("_start"))
    rows = months.join(starts, [*keys, "_bucket"]).select(*keys, F.explode(F.arrays_zip(F.col("_days.d").alias("d"), _folded(F.col("_days"), F.col("_start")).alias("x"))).alias("_s"))
    return rows.select(*keys, F.col("_s.d").alias(order), F.col("_s.x").alias(out))
