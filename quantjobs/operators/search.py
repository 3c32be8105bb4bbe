"""Portfolio search and composition. Weights are long rows (portfolio_id, symbol, weight)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantjobs.operators import gram
from quantjobs.sources.tables import scratch

YEAR = 252


def panel_stats(bars: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mean rows (symbol, mean), covariance rows (a, b, cov)), annual, of a pool's complete-case prices.

    Zero prices are gaps; dates on which any symbol of the pool has a gap are dropped before returns are taken.
    """
    pool = symbols.select("symbol").distinct()
    own = bars.where("close > 0").join(pool, "symbol", "left_semi").select("symbol", "date", "close")
    size = symbols.agg(F.count_distinct("symbol").alias("_k"))  # one row
    full = own.groupBy("date").agg(F.count("*").alias("_c")).join(size, F.col("_c") == F.col("_k")).select("date")
    r = own.join(full, "date").withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("date")) - 1).where("ret is not null")
    sums = scratch(gram.pair_sums(r), "sums")
    mean = sums.where("a = b").select(F.col("a").alias("symbol"), (F.col("sx") / F.col("n") * YEAR).alias("mean"))
    return mean, gram.both_ways(sums.select("a", "b", (gram.covariance() * YEAR).alias("cov")))


def binomials(n: int, k: int) -> np.ndarray:
    """C(c, j) for c up to n and j up to k; larger than fits counts as the largest bigint."""
    return np.array([[min(math.comb(c, j), 2**63 - 1) for j in range(k + 1)] for c in range(n + 1)], dtype=np.int64)


def unranked(ranks: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """The k-subsets (rising numbers) of these places in the combinatorial number system."""
    out, left = np.empty((len(ranks), k), dtype=np.int64), ranks.copy()
    for j in range(k, 0, -1):
        c = np.searchsorted(table[:, j], left, side="right") - 1
        out[:, j - 1] = c
        left -= table[c, j]
    return out


def within_limit(codes: np.ndarray, most: int) -> np.ndarray:
    """Rows in which no value stands more than ``most`` times."""
    if most >= codes.shape[1]:
        return np.ones(len(codes), dtype=bool)
    rows = np.sort(codes, axis=1)
    return ~(rows[:, most:] == rows[:, : codes.shape[1] - most]).any(1)


def combinations(symbols: DataFrame, k: int, max_per_sector: int, parts: int | None = None) -> DataFrame:
    """(combo array<string>): all k-subsets of (symbol, sector) with at most so many of a sector.

    Sets are numbered, and ``parts`` tasks make the sets of an interval of numbers each: nothing is joined or shuffled.
    A pool of more than POOL symbols, or one with more sets than a bigint counts, is refused.
    """
    spark = symbols.sparkSession
    pool = _pool_of(symbols)
    n, total = len(pool), math.comb(len(pool), k)
    if total >= 2**63:
        raise ValueError(f"{n} symbols have too many sets of {k}")
    names, codes, table = pa.array(pool["symbol"], pa.string()), pd.factorize(pool["sector"])[0], binomials(n, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = unranked(batch.column(0).to_numpy(), table, k)
            sets = sets[within_limit(codes[sets], max_per_sector)]
            if len(sets):
                ends = pa.array(np.arange(0, (len(sets) + 1) * k, k), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, names.take(pa.array(sets.ravel())))], names=["combo"])

    return spark.range(0, total, 1, parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "combo array<string>")


def portfolio_metrics(weights: DataFrame, expected: DataFrame, cov: DataFrame, sectors: DataFrame, rf: float = 0.0, power: float = 0.0, sector_weight: float = 0.0) -> DataFrame:
    """expected return, volatility and Sharpe ratio of each portfolio, the ratio scaled by its concentration."""
    ret = weights.join(expected, "symbol").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("mean")).alias("ret"))
    a = weights.select("portfolio_id", F.col("symbol").alias("a"), F.col("weight").alias("wa"))
    b = weights.select("portfolio_id", F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    vol = a.join(cov, "a").join(b, ["portfolio_id", "b"]).groupBy("portfolio_id").agg(F.sqrt(F.greatest(F.sum(F.col("wa") * F.col("wb") * F.col("cov")), F.lit(0.0))).alias("vol"))
    by_sector = weights.join(sectors, "symbol").groupBy("portfolio_id", "sector").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("h"))
    hhi = by_sector.groupBy("portfolio_id").agg(F.sum("h").alias("hhi"), F.sum(F.col("w") * F.col("w")).alias("sector_hhi"))
    out = ret.join(vol, "portfolio_id").join(hhi, "portfolio_id")
    raw = F.when(F.col("vol") > 0, (F.col("ret") - rf) / F.col("vol"))
    scale = F.pow((1 - sector_weight) * F.col("hhi") + sector_weight * F.col("sector_hhi"), F.lit(power))
    return out.withColumn("sharpe", F.when(raw > 0, raw / scale).otherwise(raw * scale))


#: Largest pool whose covariances (POOL * POOL numbers) are gathered and broadcast.
POOL = 2000


@dataclass(frozen=True)
class SearchParams:
    """Draws of a combination between ``least`` and ``most``: factor * ln(k) ** 2; a window of draws without progress ends it."""

    factor: float = 200.0
    least: int = 200
    most: int = 1000
    first: int = 100
    discard: float = 0.5
    window: int = 100
    delta: float = 1e-4
    rf: float = 0.0
    power: float = 0.0
    sector_weight: float = 0.0


def draws(k: int, p: SearchParams) -> int:
    return int(min(max(p.factor * np.log(max(k, 2)) ** 2, p.least), p.most))


def uniforms(seeds: np.ndarray, first: int, rows: int, k: int) -> np.ndarray:
    """Numbers from 0 to 1 (seeds x rows x k): a hash of the seed and the number's place, so that no draw depends on another."""
    place = (np.arange(first, first + rows, dtype=np.uint64)[:, None] * np.uint64(k) + np.arange(1, k + 1, dtype=np.uint64)[None, :]) * np.uint64(0x9E3779B97F4A7C15)
    x = seeds.astype(np.uint64)[:, None, None] * np.uint64(0xD1342543DE82EF95) + place[None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: Combinations searched at once.
LOT = 256


def best_weights(sets: np.ndarray, mean: np.ndarray, cov: np.ndarray, groups: np.ndarray, p: SearchParams, n: int, seeds: np.ndarray, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The best of up to n random weight vectors of each of ``sets`` (rows of places in the pool), and its ratio.

    A set gives up after the first scan if that is far below ``bar``, or after a window of draws without progress.
    """
    weights, tops = np.empty(sets.shape), np.empty(len(sets))
    for at in range(0, len(sets), LOT):
        weights[at : at + LOT], tops[at : at + LOT] = _best_of_lot(sets[at : at + LOT], mean, cov, groups, p, n, seeds[at : at + LOT], bar)
    return weights, tops


def _best_of_lot(sets, mean, cov, groups, p, n, seeds, bar):
    k = sets.shape[1]
    best, top, since = np.full(sets.shape, 1 / k), np.full(len(sets), -np.inf), np.zeros(len(sets), dtype=np.int64)
    mu, sigma, by = mean[sets], cov[sets[:, :, None], sets[:, None, :]], groups[sets] if p.power else None
    going, tried = np.arange(len(sets)), 0
    while tried < n and len(going):
        m = min(p.window if tried else p.first, n - tried)
        w = uniforms(seeds[going], tried, m, k)
        w /= w.sum(2, keepdims=True)
        if not tried:
            w[:, 0] = 1 / k
        vol = np.sqrt(np.maximum(((w @ sigma[going]) * w).sum(2), 0))
        s = np.where(vol > 0, ((w * mu[going, None, :]).sum(2) - p.rf) / np.where(vol > 0, vol, 1), -np.inf)
        if p.power:
            h = ((1 - p.sector_weight) * (w**2).sum(2) + p.sector_weight * ((w @ by[going]) ** 2).sum(2)) ** p.power
            s = np.where(s > 0, s / h, s * h)
        at = s.argmax(1)
        now, before = s[np.arange(len(going)), at], top[going]
        more = now > before
        best[going[more]], top[going[more]] = w[more, at[more]], now[more]
        with np.errstate(invalid="ignore"):
            since[going] = np.where(top[going] - before < p.delta, since[going] + m, 0)
        stay = since[going] < p.window
        if not tried:
            stay &= ~(top[going] < bar * p.discard)
        going, tried = going[stay], tried + m
    return best, top


def _pool_of(symbols: DataFrame) -> pd.DataFrame:
    """The pool's (symbol, sector) in order; a pool of more than POOL symbols is refused, as it goes to the driver."""
    pool = symbols.select("symbol", "sector").distinct().orderBy("symbol").limit(POOL + 1).toArrow().to_pandas()
    if len(pool) > POOL:
        raise ValueError(f"a pool has at most {POOL} symbols")
    return pool


def _arrays(mean: DataFrame, cov: DataFrame, sectors: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """The statistics of the pool (POOL symbols at most) as arrays."""
    m = mean.join(_only(sectors), "symbol").orderBy("symbol").limit(POOL + 1).toArrow().to_pandas()
    if len(m) > POOL:
        raise ValueError(f"a pool has at most {POOL} symbols")
    at = {s: i for i, s in enumerate(m["symbol"])}
    rows = cov.where(F.col("a").isin(*at) & F.col("b").isin(*at)).select("a", "b", "cov").toArrow().to_pandas() if at else pd.DataFrame({"a": [], "b": [], "cov": []})
    c = np.zeros((len(at), len(at)))
    c[rows["a"].map(at).to_numpy(dtype=np.int64), rows["b"].map(at).to_numpy(dtype=np.int64)] = rows["cov"].to_numpy(dtype=float)
    groups = pd.get_dummies(m["sector"]).to_numpy(dtype=float)
    return at, m["mean"].to_numpy(), c, groups


def _only(sectors: DataFrame) -> DataFrame:
    return sectors.select("symbol", "sector")


def sets_in(lists: pa.ListArray, names: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, sets as places in ``names``) of a column of combinations, for each length that occurs."""
    flat = pc.index_in(lists.flatten(), value_set=names).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for k in np.unique(sizes):
        rows = np.flatnonzero(sizes == k)
        yield rows, flat[first[rows][:, None] + np.arange(k)].astype(np.int64)


def equal_weight_bar(combos: DataFrame, at: dict[str, int], mean: np.ndarray, cov: np.ndarray, p: SearchParams, quantile: float = 0.9) -> float:
    """A quantile of the combinations' Sharpe ratios at equal weights, found before the search: no draw depends on order.

    With a concentration penalty there is none. One pass over the combinations; one number comes to the driver.
    """
    if p.power:
        return -np.inf
    names = pa.array(list(at), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in sets_in(batch.column(0), names):
                vol = np.sqrt(np.maximum(cov[sets[:, :, None], sets[:, None, :]].mean((1, 2)), 0.0))
                s = (mean[sets].mean(1) - p.rf)[vol > 0] / vol[vol > 0]
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64())], names=["s"])

    got = combos.select("combo").mapInArrow(run, "s double").agg(F.percentile_approx("s", quantile, 10_000)).first()[0]
    return -np.inf if got is None or got <= 0 else float(got)


def random_weight_search(combos: DataFrame, mean: DataFrame, cov: DataFrame, sectors: DataFrame, p: SearchParams = SearchParams(), seed: int = 7, n: int | None = None) -> DataFrame:
    """(combo, weights, sharpe): the best of random weights of each combination.

    A combination whose first scan stays below ``p.discard`` of the bar, the 0.9 quantile of all combinations at equal
    weights, gets no further draws. With a concentration penalty there is no bar.

    Combinations are searched where they lie, in batches, against arrays of the pool's size; a
    combination's draws depend on it and the seed only, not on the partitioning.
    """
    arrays = _arrays(mean, cov, sectors)
    bar = equal_weight_bar(combos, *arrays[:3], p)
    stats = combos.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m, c, g = stats.value
        names = pa.array(list(at), pa.string())
        for batch in batches:
            combo, own = batch.column("combo"), batch.column("own").to_numpy()
            for rows, sets in sets_in(combo, names):
                w, s = best_weights(sets, m, c, g, p, n or draws(sets.shape[1], p), own[rows], bar)
                ends = pa.array(np.arange(0, (len(rows) + 1) * sets.shape[1], sets.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([combo.take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(w.ravel())), pa.array(s)], names=["combo", "weights", "sharpe"])

    seeded = combos.select("combo", F.pmod(F.xxhash64("combo", F.lit(seed)), F.lit(2**31)).alias("own"))
    return seeded.mapInArrow(run, "combo array<string>, weights array<double>, sharpe double")


def refine(results: DataFrame, mean: DataFrame, cov: DataFrame, sectors: DataFrame, fraction: float = 0.1, n: int = 3000, p: SearchParams = SearchParams(), seed: int = 8) -> DataFrame:
    """The top fraction of combinations searched again with more draws; the better of both results counts.

    The results, which are a search, are written to the scratch folder once and read for the cut and the top.
    """
    results = scratch(results, "results")
    cut = results.agg(F.percentile_approx("sharpe", 1 - fraction, 100_000)).first()[0]
    top = results.where(F.col("sharpe") >= F.lit(cut))
    again = random_weight_search(top.select("combo"), mean, cov, sectors, p, seed, n)
    return top.unionByName(again).groupBy("combo").agg(F.max_by("weights", F.struct("sharpe", "weights")).alias("weights"), F.max("sharpe").alias("sharpe"))


def evolutionary_search(islands: DataFrame, mean: DataFrame, cov: DataFrame, sectors: DataFrame, population: int = 60, generations: int = 40, mutation: float = 0.2, crossover: float = 0.8, elite: int = 2, patience: int = 5, p: SearchParams = SearchParams()) -> DataFrame:
    """(k, seed, generation, best, combo, weights): each (k, seed) island evolves combinations on its own."""
    stats = islands.sparkSession.sparkContext.broadcast(_arrays(mean, cov, sectors))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, m, c, g = stats.value
        names = sorted(at)
        k, seed = int(pdf["k"].iloc[0]), int(pdf["seed"].iloc[0])
        k = min(k, len(names))
        rng, known = np.random.default_rng([seed, k]), {}

        def rate(combos: list[tuple[int, ...]]) -> None:
            """A generation is searched at once; a combination's draws depend on it alone."""
            new = sorted({x for x in combos if x not in known})
            if new:
                own = np.array([sum(31**j * x for j, x in enumerate(combo)) % 2**31 for combo in new])
                w, s = best_weights(np.array(new), m, c, g, p, draws(k, p), own)
                known.update((x, (w[i], float(s[i]))) for i, x in enumerate(new))

        def fitness(combo: tuple[int, ...]) -> float:
            return known[combo][1]

        def one() -> tuple[int, ...]:
            return tuple(sorted(rng.choice(len(names), k, replace=False).tolist()))

        def parent(living: list) -> tuple[int, ...]:
            return max((living[i] for i in rng.integers(0, len(living), 3)), key=fitness)

        living, rows, flat = [one() for _ in range(population)], [], 0
        for generation in range(generations):
            rate(living)
            living.sort(key=lambda x: (-fitness(x), x))
            flat = flat + 1 if rows and fitness(living[0]) <= rows[-1][3] + 1e-9 else 0
            rows.append((k, seed, generation, fitness(living[0]), [names[i] for i in living[0]], known[living[0]][0]))
            if flat >= patience:
                break
            young = living[:elite]
            while len(young) < population:
                a, b = parent(living), parent(living)
                cut = int(rng.integers(1, k)) if k > 1 and rng.random() < crossover else k
                child = set(a[:cut]) | set(b[cut:])
                if rng.random() < mutation:
                    child.discard(int(rng.choice(sorted(child))))
                while len(child) < k:
                    child.add(int(rng.integers(0, len(names))))
                young.append(tuple(sorted(child)))
            living = young
        return pd.DataFrame(rows, columns=["k", "seed", "generation", "best", "combo", "weights"])

    return islands.groupBy("k", "seed").applyInPandas(run, "k int, seed int, generation int, best double, combo array<string>, weights array<double>")


def composition(weights: DataFrame, facts: DataFrame) -> DataFrame:
    """Concentration of each portfolio and the weighted means of its valid facts.

    Rows are bounded by a portfolio's holdings; nulls and non-positive P/E are left out and weights renormalised.
    """
    d = weights.join(facts.select("symbol", "sector", "forward_pe", "momentum", "dividend_yield", "average_volume"), "symbol", "left")
    place = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("weight"), "symbol"))
    mean = lambda c, ok: F.try_divide(F.sum(F.when(ok, F.col("weight") * F.col(c))), F.sum(F.when(ok, F.col("weight"))))
    one = d.withColumn("_p", place).groupBy("portfolio_id").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("hhi"),
        F.sum(F.when(F.col("_p") <= 3, F.col("weight"))).alias("top3"),
        F.sum(F.when(F.col("_p") <= 5, F.col("weight"))).alias("top5"),
        F.max("weight").alias("max_weight"),
        F.count("*").alias("n"),
        mean("forward_pe", F.col("forward_pe") > 0).alias("forward_pe"),
        mean("momentum", F.col("momentum").isNotNull()).alias("momentum"),
        mean("dividend_yield", F.col("dividend_yield").isNotNull()).alias("dividend_yield"),
        mean("average_volume", F.col("average_volume").isNotNull()).alias("liquidity"),
    )
    return one


def sector_exposure(weights: DataFrame, instruments: DataFrame) -> DataFrame:
    """(portfolio_id, sector, weight, n)."""
    named = weights.join(instruments.select("symbol", "sector"), "symbol", "left")
    return named.groupBy("portfolio_id", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def holdings_meta(weights: DataFrame, scored: DataFrame, fundamentals: DataFrame, prices: DataFrame) -> DataFrame:
    """Per holding: price and target by precedence scored, fundamentals, last close; the last target is EPS x sector P/E."""
    s = scored.select("symbol", "sector", F.col("price").alias("p1"), F.col("target_price").alias("t1"), "sector_pe")
    f = fundamentals.select("symbol", F.col("current_price").alias("p2"), F.col("target_mean_price").alias("t2"), "forward_eps")
    d = weights.join(s, "symbol", "left").join(f, "symbol", "left").join(prices.select("symbol", F.col("price").alias("p3")), "symbol", "left")
    rebuilt = F.when((F.col("forward_eps") > 0) & (F.col("sector_pe") > 0), F.col("forward_eps") * F.col("sector_pe"))
    return d.select(*weights.columns, "sector", F.coalesce("p1", "p2", "p3").alias("price"), F.coalesce("t1", "t2", rebuilt).alias("target"))


def run_stability(weights: DataFrame, metric: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per metric: n, mean, std, cv, min, max), (per symbol: frequency, mean, population deviation, cv of positive weights)."""
    m = metric.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    runs = F.broadcast(weights.agg(F.count_distinct("run_id").alias("_runs")))  # one row
    w = weights.where("weight > 0").groupBy("symbol").agg(F.count_distinct("run_id").alias("k"), F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std")).join(runs, F.lit(True))
    return m.withColumn("cv", F.try_divide("std", "mean")), w.select("symbol", (F.col("k") / F.col("_runs")).alias("frequency"), "mean", "std", F.try_divide("std", "mean").alias("cv"))


def project_allocation(weights: DataFrame, capital: float | str, prices: DataFrame, targets: DataFrame) -> DataFrame:
    """Per holding: allocation, whole shares (1 at least), invested and target value.

    ``capital`` is a number, or the column of ``weights`` that holds each portfolio's capital.
    """
    capital = F.col(capital) if isinstance(capital, str) else F.lit(float(capital))
    d = weights.join(prices.select("symbol", "price"), "symbol").join(targets.select("symbol", F.col("target_price").alias("target")), "symbol", "left")
    shares = F.greatest(F.lit(1), F.floor(F.col("weight") * capital / F.col("price")))
    return d.withColumns({"allocation": F.col("weight") * capital, "shares": shares}).withColumns({"invested": F.col("shares") * F.col("price"), "target_value": F.col("shares") * F.coalesce("target", "price")})
