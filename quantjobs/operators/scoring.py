"""Scoring of a universe of instruments: upside, factor weights, regimes, target quality, selection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantjobs.operators import gram
from quantjobs.operators import timeseries as ts
from quantjobs.operators.quantiles import exact_quantiles
from quantjobs.sources.tables import scratch


@dataclass(frozen=True)
class QualityParams:
    """Fixed values of the target-quality and return-adjustment rules."""

    fallback_quality: float = 0.35
    extreme_upside_pct: float = 150.0
    reject_upside_pct: float = 300.0
    low_price: float = 1.0
    low_volume: float = 100_000.0
    stale_days: int = 45
    distressed_pct: float = -50.0
    cap_pct: float = 150.0
    floor_pct: float = -80.0
    base_pct: float = 0.0
    reject_base_pct: float = 0.0
    penalty_pct: float = 0.0


def sector_median_pe(instruments: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Median of the positive forward P/E of each sector."""
    return exact_quantiles(instruments.join(fundamentals, "symbol").where("forward_pe > 0"), ["sector"], "forward_pe", {"sector_pe": 0.5})


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def upside(df: DataFrame) -> DataFrame:
    """source, upside and target_price from the analysts' target, else from the sector's P/E."""
    target = (F.col("target_mean_price") > 0) & (F.col("price") > 0)
    fallback = F.col("sector_pe").isNotNull() & (F.col("forward_pe") != 0)
    source = F.when(target, "YahooFinance").when(fallback, "SectorPE_Fallback").otherwise("None")
    raw = F.when(target, F.col("target_mean_price") / F.col("price") - 1).when(fallback, F.try_divide("sector_pe", "forward_pe") - 1).otherwise(0.0)
    out = df.withColumn("source", source).withColumn("upside", clip(raw, -0.99, 10.0))
    return out.withColumn("target_price", F.when(F.col("source") == "YahooFinance", F.col("target_mean_price")).when(F.col("source") == "SectorPE_Fallback", F.col("price") * (1 + F.col("upside"))))


def per_run(df: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """``df`` beside its run's row of ``one``; without keys that is one row, which is broadcast."""
    if not by:
        return df.join(F.broadcast(one), F.lit(True))
    keys = one.select(*[F.col(k).alias(f"_by_{k}") for k in by], *[c for c in one.columns if c not in by])
    return df.join(keys, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by])).drop(*[f"_by_{k}" for k in by])


def minmax(df: DataFrame, *cols: str, by: list[str] | None = None) -> DataFrame:
    """<col>_norm: scaled to 0..1 over all rows, or those of a run (``by``); 0.5 without spread, nulls 0. A null run is a run."""
    stats = df.groupBy(*(by or [])).agg(*[f(c).alias(f"_{k}{c}") for c in cols for k, f in (("a", F.min), ("b", F.max))])
    out = per_run(df, stats, by or [])
    for c in cols:
        a, b = F.col(f"_a{c}"), F.col(f"_b{c}")
        out = out.withColumn(f"{c}_norm", F.when(F.col(c).isNull(), 0.0).when(a.isNull() | (a == b), 0.5).otherwise((F.col(c) - a) / (b - a)))
    return out.select(*df.columns, *[f"{c}_norm" for c in cols])


#: Tendencies and multipliers of the profiles for Sharpe ratio, upside and momentum.
PROFILES = {"conservador": ((0.50, 0.35, 0.15), (1.3, 0.9, 0.6)), "moderado": ((0.40, 0.35, 0.25), (1.0, 1.0, 1.0)), "agressivo": ((0.25, 0.40, 0.35), (0.7, 1.2, 1.3))}
FACTORS = ("sharpe", "upside", "momentum")


def factor_weights(scored: DataFrame, profile: str = "moderado", strength: float = 0.4, regime_mult: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """One row of weights, or one for each run (``by``): shares of the normalised factors' variances, drawn towards a profile."""
    s = min(1.0, strength * regime_mult)
    v = scored.groupBy(*(by or [])).agg(*[F.var_samp(f"{f}_norm").alias(f) for f in FACTORS])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(0.0)) for f in FACTORS])
    base = [F.when(total > 0, F.coalesce(F.col(f), F.lit(0.0)) / total).otherwise(d) for f, d in zip(FACTORS, (0.5, 0.5, 0.0), strict=True)]
    drawn = [(1 - s) * b + s * t * m for b, t, m in zip(base, *PROFILES[profile], strict=True)]
    return v.select(*(by or []), *[(d / reduce(lambda a, b: a + b, drawn)).alias(f"{f}_weight") for f, d in zip(FACTORS, drawn, strict=True)])


def composite_score(df: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """score, its rank (ties by symbol) and the weights used, from one row of weights, or that of the run (``by``)."""
    out = per_run(df, weights, by or []).withColumn("score", reduce(lambda a, b: a + b, [F.col(f"{f}_norm") * F.col(f"{f}_weight") for f in FACTORS]))
    if by:
        return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "symbol")))
    return rank_of(out)


def rank_of(scores: DataFrame, slices: int = 64) -> DataFrame:
    """Adds rank by score descending, symbol ascending (null scores last).

    Rows are ranked within slices between quantiles of the score, behind the rows of all higher slices, so that no
    task holds the whole table; rows of one score share a slice. The scores are written to the scratch folder once,
    and the quantiles are taken from there, before the ranks.
    """
    scores = scratch(scores, "scores")
    cuts = scores.agg(F.percentile_approx("score", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.when(F.col("score").isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("score"))))
    d = scores.withColumn("_slice", at)
    above = d.groupBy("_slice").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most slices + 1 rows
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(F.desc("score"), "symbol"))
    return d.join(F.broadcast(above.select("_slice", "_above")), "_slice").withColumn("rank", (place + F.col("_above")).cast("int")).drop("_slice", "_above")


def trend_regime(bench: DataFrame, lookback: int = 60, strong_bull: float = 0.2, bull: float = 0.1, bear: float = -0.1, strong_bear: float = -0.2, bear_vol: float = 0.8) -> DataFrame:
    """One row (trend, vol_percentile, regime) of a benchmark's (date, close): five levels, neutral with few rows."""
    day = Window.orderBy("date")  # one row a trading day
    back = Window.orderBy(F.desc("date"))
    rows = bench.withColumn("pos", F.row_number().over(back)).withColumn("r", F.col("close") / F.lag("close").over(day) - 1).where("r is not null or pos is not null")
    roll = day.rowsBetween(-(lookback - 1), 0)
    vols = rows.where("r is not null").withColumn("v", F.when(F.count("r").over(roll) == lookback, F.stddev_samp("r").over(roll) * F.sqrt(F.lit(252.0))))
    near = rows.where(F.col("pos") <= lookback)
    ends = near.agg(F.count("*").alias("n"), F.max_by("close", "date").alias("b"), F.min_by("close", "date").alias("a"), (F.stddev_samp(F.when(F.col("pos") < F.greatest(F.lit(lookback), F.lit(2)), F.col("r"))) * F.sqrt(F.lit(252.0))).alias("vol"))
    pct = vols.join(F.broadcast(ends.select("vol")), F.lit(True)).agg((F.count_if(F.col("v") < F.col("vol")) / F.count("*")).alias("p"))
    out = ends.join(pct, F.lit(True)).select("n", ((F.col("b") / F.col("a") - 1) * 252 / F.col("n")).alias("trend"), F.col("p").alias("vol_percentile"))
    t, p = F.col("trend"), F.col("vol_percentile")
    label = F.when(F.col("n") < 20, "neutral").when((t > strong_bull) & (p < 0.7), "strong_bull").when(t > bull, "bull").when((t < strong_bear) | (p > bear_vol), "strong_bear").when(t < bear, "bear").otherwise("neutral")
    return out.select("trend", "vol_percentile", label.alias("regime"))


def market_stress(bars: DataFrame, bench: DataFrame, instruments: DataFrame, m3: int = 63, m6: int = 126, drawdown: float = 10.0, negative: float = 60.0, broad: float = 45.0, asset: float = 20.0, vol: float = 25.0, dispersion: float = 35.0) -> DataFrame:
    """One row of a market's stress: benchmark, breadth, dispersion, worst sector, triggers, state and its impact."""
    one = bench.withColumn("symbol", F.lit("^BENCH"))
    b = [ts.window_return(one, n).select((F.col("ret") * 100).alias(f"bench_return_{k}")) for k, n in (("3m", m3), ("6m", m6))]
    b += [ts.window_drawdown(one, n).select((F.col("drawdown") * 100).alias(f"bench_drawdown_{k}")) for k, n in (("3m", m3), ("6m", m6))]
    r = ts.recent(one.withColumn("ret", F.col("close") / F.lag("close").over(ts.by("symbol")) - 1)).where(f"pos <= {m3} and ret is not null")
    b.append(r.agg(F.when(F.count("*") >= ts.least_rows(m3), F.stddev_samp("ret") * F.sqrt(F.lit(252.0)) * 100).alias("bench_vol")))
    r3, r6 = ts.window_return(bars, m3), ts.window_return(bars, m6)
    b.append(r3.agg((F.avg((F.col("ret") < 0).cast("int")) * 100).alias("negative_3m"), F.count("*").alias("_n3")))
    b.append(exact_quantiles(r3, [], "ret", {"_q9": 0.9, "_q1": 0.1}))
    b.append(r6.agg((F.avg((F.col("ret") < 0).cast("int")) * 100).alias("negative_6m")))
    b.append(ts.window_drawdown(bars, m6).agg((F.avg((F.col("drawdown") * 100 <= -asset).cast("int")) * 100).alias("drawdown_breadth")))
    sectors = exact_quantiles(r3.join(instruments, "symbol"), ["sector"], "ret", {"m": 0.5})
    b.append(sectors.agg(F.min_by("sector", F.struct("m", "sector")).alias("worst_sector"), (F.min("m") * 100).alias("worst_sector_return")))
    out = bars.agg(F.max("date").alias("as_of"))
    for part in b:  # each is one row; a missing one leaves nulls
        out = out.join(F.broadcast(part), F.lit(True), "left")
    out = out.withColumn("dispersion_3m", F.when(F.col("_n3") >= 10, (F.col("_q9") - F.col("_q1")) * 100)).drop("_n3", "_q9", "_q1")
    c = F.col
    checks = [("benchmark_drawdown_3m", c("bench_drawdown_3m") <= -drawdown), ("benchmark_drawdown_6m", c("bench_drawdown_6m") <= -drawdown), ("negative_breadth_3m", c("negative_3m") >= negative), ("broad_asset_drawdown", c("drawdown_breadth") >= broad), ("elevated_benchmark_volatility", c("bench_vol") >= vol), ("high_cross_sectional_dispersion", c("dispersion_3m") >= dispersion)]
    out = out.withColumn("triggers", F.array_compact(F.array(*[F.when(cond, name) for name, cond in checks])))
    stress = F.arrays_overlap("triggers", F.array(*[F.lit(n) for n, _ in checks[:4]]))
    state = F.when(F.size("triggers") == 0, "normal").when(stress, "stress").otherwise("volatile_watch")
    out = out.withColumn("state", state)
    pick = lambda a, b, c: F.when(F.col("state") == "normal", a).when(F.col("state") == "stress", c).otherwise(b)
    return out.withColumns({"shrinkage_mult": pick(1.0, 1.1, 1.25), "hurdle_addon": pick(0.0, 0.5, 1.0), "turnover_mult": pick(1.0, 0.85, 0.7)})


def root(symbol: Column) -> Column:
    """The letters that the share classes of a company have in common."""
    return F.regexp_replace(F.replace(F.upper(symbol), F.lit(".SA"), F.lit("")), r"[0-9]+$", "")


def class_mismatch(df: DataFrame, same_target: float = 0.15, price_ratio: float = 3.0) -> DataFrame:
    """(symbol, related): the first other symbol of the root with a like target and a very different price."""
    ok = df.where("target_price > 0 and price > 0").select("symbol", "price", "target_price", root(F.col("symbol")).alias("root"))
    other = ok.select("root", F.col("symbol").alias("related"), F.col("price").alias("p"), F.col("target_price").alias("t"))
    like = F.abs(F.col("target_price") - F.col("t")) / F.greatest("target_price", "t") <= same_target
    far = F.greatest("price", "p") / F.least("price", "p") >= price_ratio
    return ok.join(other, "root").where((F.col("symbol") != F.col("related")) & like & far).groupBy("symbol").agg(F.min("related").alias("related"))


def target_quality(df: DataFrame, mismatches: DataFrame, as_of: str, p: QualityParams = QualityParams()) -> DataFrame:
    """quality_score, quality_bucket, quality_flags and raw_upside_pct of each target, rules in their order."""
    d = df.join(mismatches, "symbol", "left")
    cur, tgt, c = F.col("price"), F.col("target_price"), F.col
    no_target, no_price = tgt.isNull() | (tgt <= 0), cur.isNull() | (cur <= 0)
    raw = F.when(~no_target & ~no_price, (tgt / cur - 1) * 100)
    extreme, reject = F.coalesce(raw >= p.extreme_upside_pct, F.lit(False)), F.coalesce(raw >= p.reject_upside_pct, F.lit(False))
    fallback, related = c("source") == "SectorPE_Fallback", c("related").isNotNull()
    cheap = F.coalesce(cur < p.low_price, F.lit(False))
    yes = lambda x: F.coalesce(x, F.lit(False))
    bad_pe, thin = yes(c("forward_pe") <= 0), yes(c("average_volume") < p.low_volume)
    stale, distressed = yes(F.datediff(F.lit(as_of).cast("date"), "last_updated") > p.stale_days), yes(c("annual_mean") * 100 <= p.distressed_pct)
    s = F.when(no_target, 0.0).otherwise(1.0)
    s = s - F.when(no_price, 0.35).otherwise(0.0)
    s = F.when(fallback, F.least(s, F.lit(p.fallback_quality))).otherwise(s)
    for cond, off in ((extreme, 0.25), (reject, 0.35), (bad_pe, 0.35), (cheap, 0.20), (thin, 0.15), (stale, 0.20)):
        s = s - F.when(cond, off).otherwise(0.0)
    s = F.when(related, F.least(s, F.lit(0.20))).otherwise(s)
    s = clip(s - F.when(distressed, 0.20).otherwise(0.0), 0.0, 1.0)
    forced = no_target | (reject & fallback) | (related & extreme)
    flags = [(no_target, "missing_target"), (no_price, "missing_current_price"), (fallback, "sector_pe_fallback"), (extreme, "extreme_upside"), (bad_pe, "negative_or_zero_forward_pe"), (cheap, "very_low_price"), (thin, "low_liquidity"), (stale, "stale_target"), (related, "target_class_mismatch_suspected"), (related, "unit_or_share_class_mismatch_suspected"), (related, "corporate_action_check_required"), (distressed | (cheap & reject), "distressed_price_action")]
    d = d.withColumn("quality_score", F.round(s, 4))
    q = F.round(s, 10)
    bucket = F.when(forced | (q <= 0.15), "reject").when(q <= 0.40, "low").when(q <= 0.70, "medium").otherwise("high")
    return d.withColumns({"quality_bucket": bucket, "quality_flags": F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(cond, name) for cond, name in flags])))), "raw_upside_pct": F.round(raw, 4)})


def adjusted_return(df: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """shrinkage, capped_pct, base_pct, penalty_pct and adjusted_pct: returns drawn to a base by quality."""
    rejected = F.col("quality_bucket") == "reject"
    s = F.when(rejected, 0.0).otherwise(clip(F.col("quality_score"), 0.0, 1.0))
    capped = clip(F.coalesce("raw_upside_pct", F.lit(0.0)), p.floor_pct, p.cap_pct)
    base = F.when(rejected, p.reject_base_pct).otherwise(p.base_pct)
    out = df.withColumns({"shrinkage": s, "capped_pct": capped, "base_pct": base}).withColumn("penalty_pct", p.penalty_pct * (1 - F.col("shrinkage")))
    return out.withColumn("adjusted_pct", F.col("shrinkage") * F.col("capped_pct") + (1 - F.col("shrinkage")) * F.col("base_pct") - F.col("penalty_pct"))


def eligible(scored: DataFrame, holdings: DataFrame) -> DataFrame:
    """Rows with a positive upside or that are held, and with positive price, target and forward P/E."""
    held = holdings.select("symbol").distinct().withColumn("_held", F.lit(True))
    return scored.join(held, "symbol", "left").where(((F.col("upside") > 0) | F.col("_held")) & (F.col("price") > 0) & (F.col("target_price") > 0) & (F.col("forward_pe") > 0)).drop("_held")


def top_n(scored: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n best rows of each run by score, ties by symbol."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "symbol")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def blended_returns(hist: DataFrame, signals: DataFrame, hist_weight: float = 0.5) -> DataFrame:
    """expected: historical mean and upside blended by the regime's weight; historical where there is no upside."""
    both = hist.join(signals, "symbol", "left")
    return both.withColumn("expected", F.when(F.col("upside").isNull(), F.col("annual_mean")).otherwise(hist_weight * F.col("annual_mean") + (1 - hist_weight) * F.col("upside")))


def correlation_pairs(returns: DataFrame, symbols: DataFrame) -> DataFrame:
    """(a, b, corr, n) of the chosen symbols, pairwise complete, both triangles and the diagonal."""
    own = returns.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return gram.both_ways(gram.pair_sums(own).select("a", "b", gram.correlation().alias("corr"), "n"))


def correlation_groups(bars: DataFrame, holdings: DataFrame, model: DataFrame, n: int = 252) -> DataFrame:
    """Correlations of held and model symbols with their groups and places in display order.

    Prices are cut to the last n dates on which any of the symbols closed, the last close is carried forward within these,
    and dates on which a return is missing are dropped. The order is: held only, both, model only, each by symbol.
    """
    sides = holdings.select("symbol", F.lit("holdings").alias("g")).unionByName(model.select("symbol", F.lit("model").alias("g"))).groupBy("symbol").agg(F.when(F.count_distinct("g") == 2, "both").otherwise(F.min("g")).alias("group"))
    own = bars.where("close is not null").join(sides.select("symbol"), "symbol", "left_semi")
    last = own.select("date").distinct().orderBy(F.desc("date")).limit(n)
    r = ts.daily_returns_padded(own.join(last, "date", "left_semi")).where("ret is not null")
    present = own.select("symbol").distinct()
    size = present.agg(F.count("*").alias("_k"))  # one row
    full = r.groupBy("date").agg(F.count("*").alias("c")).join(size, F.col("c") == F.col("_k")).select("date")
    pairs = correlation_pairs(r.join(full, "date", "left_semi"), sides)
    rank = F.when(F.col("group") == "holdings", 0).when(F.col("group") == "both", 1).otherwise(2)
    placed = sides.join(present, "symbol").withColumn("place", F.row_number().over(Window.orderBy(rank, "symbol")))  # a row a symbol
    named = lambda x: placed.select(F.col("symbol").alias(x), F.col("group").alias(f"group_{x}"), F.col("place").alias(f"place_{x}"))
    return pairs.join(named("a"), "a").join(named("b"), "b")


def avg_internal_corr(pairs: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Mean correlation of a portfolio's symbols over the strict upper triangle."""
    w = weights.where("weight > 0")
    a, b = w.select(*keys, F.col("symbol").alias("a")), w.select(*keys, F.col("symbol").alias("b"))
    return a.join(b, keys).where("a < b").join(pairs, ["a", "b"]).groupBy(*keys).agg(F.avg("corr").alias("avg_corr"), F.count("corr").alias("n_pairs"))


def published_targets(scored: DataFrame, prices: DataFrame, most: float = 11.0) -> DataFrame:
    """(key, target) of positive targets not above ``most`` times the price; keys are upper-case letters and digits."""
    ok = scored.where("target_price > 0").join(prices.select("symbol", F.col("price").alias("_p")), "symbol", "left")
    kept = ok.where(F.col("_p").isNull() | (F.col("target_price") <= most * F.col("_p")))
    return kept.select(F.regexp_replace(F.upper("symbol"), "[^A-Z0-9]", "").alias("key"), F.col("target_price").alias("target"))
