"""Run history and calibration of decisions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def history_per_date(h: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key and date by timestamp and run."""
    rest = [c for c in h.columns if c not in (*keys, "date")]
    return h.groupBy(*keys, "date").agg(F.max_by(F.struct(*rest), F.struct("timestamp", "run_id")).alias("_r")).select(*keys, "date", "_r.*")


def return_history(h: DataFrame) -> DataFrame:
    """Per run id the last line, with its numbers as a nested series."""
    g = h.groupBy("run_id").agg(F.max_by(F.struct("portfolio_id", "date", "decision", F.struct("gain", "hurdle", "turnover").alias("series")), "timestamp").alias("r"))
    return g.select("run_id", "r.*")


def _day(ret: str, bench: str) -> Column:
    """One day as a block: days, growth, highest and lowest value from a start of 1, deepest drawdown, sums of returns, benchmark."""
    v, one = F.coalesce(1 + F.col(ret), F.lit(1.0)), F.lit(1.0)
    high, low = F.greatest(v, one), F.least(v, one)
    r = F.col(ret)
    parts = {"n": F.lit(1), "g": v, "high": high, "low": low, "dd": 1 - low, "c": F.when(r.isNotNull(), 1).otherwise(0), "s": F.coalesce(r, F.lit(0.0)), "q": F.coalesce(r * r, F.lit(0.0)), "b": F.coalesce(1 + F.col(bench), one)}
    return F.struct(*[x.alias(k) for k, x in parts.items()])


def _after(x: Column, y: Column) -> Column:
    """Block ``x`` followed by block ``y``."""
    parts = {
        "n": x["n"] + y["n"],
        "g": x["g"] * y["g"],
        "high": F.greatest(x["high"], x["g"] * y["high"]),
        "low": F.least(x["low"], x["g"] * y["low"]),
        "dd": F.greatest(x["dd"], y["dd"], 1 - x["g"] * y["low"] / x["high"]),
        "c": x["c"] + y["c"],
        "s": x["s"] + y["s"],
        "q": x["q"] + y["q"],
        "b": x["b"] * y["b"],
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def range_blocks(daily: DataFrame, levels: int) -> DataFrame:
    """(idx, level, block): every run of 2 ** level trading days from day idx on, made of two runs of half the length.

    ``daily`` is (idx, ret, bench), a row a trading day; blocks that would reach beyond the last day are left out.
    """
    day = Window.orderBy("idx")  # trading days
    out = daily.select("idx", _day("ret", "bench").alias("b0"))
    for k in range(1, levels + 1):
        out = out.withColumn("_next", F.lead(f"b{k - 1}", 1 << (k - 1)).over(day)).withColumn(f"b{k}", F.when(F.col("_next").isNotNull(), _after(F.col(f"b{k - 1}"), F.col("_next")))).drop("_next")
    each = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"b{k}").alias("block")) for k in range(levels + 1)])
    return out.select("idx", F.explode(each).alias("e")).select("idx", "e.level", "e.block").where("block is not null")


def forward_outcomes(signals: DataFrame, daily: DataFrame, ks: tuple[int, ...] = (5, 21)) -> DataFrame:
    """(signal columns, k, port, bench, alpha, vol, drawdown) over the next k trading rows strictly after a signal's date.

    Null outcomes if fewer rows follow. ``daily`` is (date, ret, bench), one row a trading day. A window is put together
    from runs of days whose lengths are powers of two, one for each bit of k, instead of from its days.
    """
    rows = daily.withColumn("idx", F.row_number().over(Window.orderBy("date")))  # trading days
    dates = signals.select("date").distinct()
    # The next trading row of each date: one window over both, later rows first; no more rows than days.
    later = Window.orderBy(F.desc("date"), F.col("idx").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    both = dates.withColumn("idx", F.lit(None).cast("int")).unionByName(rows.select("date", "idx"))
    first = both.withColumn("i", F.min("idx").over(later)).where("idx is null and i is not null").select("date", "i")
    pieces = []
    for k in ks:
        at = 0
        for level in reversed(range(k.bit_length())):
            if k >> level & 1:
                pieces.append(F.struct(F.lit(k).alias("k"), F.lit(level).alias("level"), F.lit(at).alias("at")))
                at += 1 << level
    wanted = first.select("date", "i", F.explode(F.array(*pieces)).alias("p")).select("date", "p.k", "p.level", "p.at", (F.col("i") + F.col("p.at")).alias("idx"))
    blocks = range_blocks(rows.select("idx", "ret", "bench"), max(ks).bit_length() - 1)
    g = wanted.join(blocks, ["idx", "level"]).groupBy("date", "k").agg(F.array_sort(F.collect_list(F.struct("at", "block"))).alias("_p"))  # at most a block for each bit of k
    w = F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), F.col("_p")[0]["block"], lambda a, x: _after(a, x["block"]))
    g = g.select("date", "k", w.alias("w")).where("w.n = k")
    spread = F.greatest(F.col("w.q") - F.col("w.s") * F.col("w.s") / F.col("w.c"), F.lit(0.0))
    vol = F.when(F.col("w.c") > 1, F.sqrt(spread / (F.col("w.c") - 1)) * F.sqrt(F.lit(YEAR)))
    out = g.select("date", "k", (F.col("w.g") - 1).alias("port"), (F.col("w.b") - 1).alias("bench"), vol.alias("vol"), F.col("w.dd").alias("drawdown"))
    all_ = signals.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return all_.join(out, ["date", "k"], "left").withColumn("alpha", F.col("port") - F.col("bench"))


def set_stability(h: DataFrame, keys: list[str], col: str = "symbols") -> DataFrame:
    """jaccard (per cent) of each run's set with the last non-null one before it."""
    before = F.last(col, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("date", "run_id").rowsBetween(Window.unboundedPreceding, -1))
    d = h.withColumn("_b", before)
    return d.withColumn("jaccard", F.try_divide(F.size(F.array_intersect(col, "_b")), F.size(F.array_union(col, "_b"))) * 100).drop("_b")


#: The decision variants.
VARIANTS = ("official", "gated", "partial", "stable", "balanced")


def variant_signals(h: DataFrame, of: dict[str, tuple[Column, Column, Column, Column]]) -> DataFrame:
    """One row a run and variant: available, trade, turnover and gain. ``of`` maps a variant to these columns."""
    rows = [F.struct(F.lit(v).alias("variant"), *[c.alias(n) for c, n in zip(cols, ("available", "trade", "turnover", "gain"), strict=True)]) for v, cols in of.items()]
    return h.select("portfolio_id", "run_id", "date", F.explode(F.array(*rows)).alias("v")).select("portfolio_id", "run_id", "date", "v.*")


def _summary(d: DataFrame, keys: list[str]) -> DataFrame:
    on = F.col("available") & F.col("trade")
    return d.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        (F.avg(F.col("available").cast("int")) * 100).alias("coverage"),
        (F.avg(F.when(F.col("available"), F.col("trade").cast("int"))) * 100).alias("frequency"),
        F.avg(F.when(on, F.col("turnover_pct"))).alias("turnover"),
        (F.avg(F.when(on & F.col("alpha").isNotNull(), (F.col("alpha") <= 0).cast("int"))) * 100).alias("false_positive"),
        F.avg(F.when(on, F.col("port"))).alias("forward"),
        F.avg(F.when(on, F.col("alpha"))).alias("forward_alpha"),
        (F.avg(F.when(on & F.col("port").isNotNull(), (F.col("port") > 0).cast("int"))) * 100).alias("hit_rate"),
    )


def calibration_summary(variants: DataFrame, outcomes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Per variant (and regime) and span: coverage, frequency, turnover, false positives, forward means, deltas to official."""
    extra = extra or []
    d = variants.withColumnRenamed("turnover", "turnover_pct").join(outcomes.select("date", "k", "port", "alpha").distinct(), "date")
    s = _summary(d, ["variant", "k", *extra])
    base = s.where("variant = 'official'").select("k", *extra, F.col("forward").alias("_f"), F.col("turnover").alias("_t"))
    return s.join(F.broadcast(base), ["k", *extra], "left").withColumns({"forward_delta": F.col("forward") - F.col("_f"), "turnover_delta": F.col("turnover") - F.col("_t")}).drop("_f", "_t")


def calibration_by_regime(variants: DataFrame, outcomes: DataFrame) -> DataFrame:
    return calibration_summary(variants, outcomes, ["regime"])


def nearest_match(left: DataFrame, right: DataFrame, keys: list[str], minutes: int = 30) -> DataFrame:
    """(left run, nearest right run) strictly within the minutes, the smallest run among equals.

    Both sides are bucketed by the span; a left row looks in its bucket and the neighbouring ones.
    """
    span = minutes * 60 * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.select(*keys, F.col("run_id").alias("left_run"), micros("timestamp").alias("ta")).withColumn("b", F.explode(F.array(*[F.floor(F.col("ta") / span) + i for i in (-1, 0, 1)])))
    b = right.select(*keys, F.col("run_id").alias("right_run"), micros("timestamp").alias("tb")).withColumn("b", F.floor(F.col("tb") / span))
    gap = F.abs(F.col("ta") - F.col("tb"))
    near = a.join(b, [*keys, "b"]).where(gap < span)
    return near.groupBy(*keys, "left_run").agg(F.min_by("right_run", F.struct(gap, "right_run")).alias("right_run"), F.min(gap / 1_000_000).alias("seconds"))
