"""Rebalancing decisions, one result per portfolio_id."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantjobs.operators.scoring import clip
from quantjobs.operators.timeseries import calendar_return


def holdings_metrics(positions: DataFrame, bars: DataFrame, targets: DataFrame, days: int = 365) -> DataFrame:
    """Per portfolio: value, holdings and expected return (per cent) by value weights.

    A holding's return is target / price - 1, else its calendar return; without a price it counts at its average cost.
    """
    d = positions.drop("target_price").join(targets.select("symbol", "target_price"), "symbol", "left").join(calendar_return(bars, days), "symbol", "left")
    price = F.coalesce("price", "avg_price")
    d = d.withColumn("_v", F.col("net_qty") * price).withColumn("_r", F.coalesce(F.when((F.col("target_price") > 0) & (price > 0), F.col("target_price") / price - 1), F.col("ret"), F.lit(0.0)))
    return d.groupBy("portfolio_id").agg(F.sum("_v").alias("value"), F.count("*").alias("n"), (F.try_divide(F.sum(F.col("_v") * F.col("_r")), F.sum("_v")) * 100).alias("expected_return"))


def at_hand(c: Column) -> Column:
    """A number to be held against a limit: what floats miss by a hair counts as the limit itself."""
    return F.round(c, 10)


def blend_candidates(holdings: DataFrame, ideal: DataFrame, n: int = 100) -> DataFrame:
    """(portfolio_id, blend, symbol, weight): n + 1 mixtures of held and ideal weights, renormalised, then weights over 0.001."""
    ids = holdings.select("portfolio_id").distinct()
    goal = ids.join(F.broadcast(ideal.select("symbol", F.col("weight").alias("w2"))), F.lit(True))  # a model of a few symbols
    both = holdings.select("portfolio_id", "symbol", F.col("weight").alias("w1")).join(goal, ["portfolio_id", "symbol"], "full_outer").na.fill(0.0)
    totals = both.groupBy("portfolio_id").agg(F.sum("w1").alias("t1"), F.sum("w2").alias("t2"))  # a blend's total is a blend of totals
    d = both.join(totals, "portfolio_id").select("portfolio_id", "symbol", "w1", "w2", "t1", "t2", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")).withColumn("blend", F.round(F.col("k") / n, 4))
    mix = lambda a, b: F.col(a) * (1 - F.col("blend")) + F.col(b) * F.col("blend")
    return d.withColumn("weight", F.try_divide(mix("w1", "w2"), mix("t1", "t2"))).where(at_hand(F.col("weight")) > 0.001).select("portfolio_id", "blend", "symbol", "weight")


#: Portfolios that are computed together, and the columns of facts that ``blend_sums`` takes.
TOGETHER = 500
FACTS = ("upside", "sharpe", "momentum", "quality_score", "poor", "raw_upside_pct", "adjusted_pct", "price")
SUMS = ("n", "total", "hhi", "top", "expected_return", "sharpe", "momentum", "adjusted", "base", "quality", "suspicious_pct", "top2", "turnover_pct")


def blend_sums(holdings: DataFrame, ideal: DataFrame, facts: DataFrame, n: int = 100) -> DataFrame:
    """Per portfolio and blend of ``blend_candidates``: the sums of ``SUMS`` over its weights.

    ``holdings`` is (portfolio_id, symbol, weight, value), ``facts`` one row an instrument with some of ``FACTS`` (numbers;
    poor is 1 for low and rejected targets). They mean what ``score_candidates``, ``quality_metrics``,
    ``return_concentration`` and ``trade_summary`` make of them; what has no value is null. A portfolio's weights are
    shuffled once, in one row, and no row of a blend and symbol is made.
    """
    ids = holdings.select("portfolio_id").distinct()
    goal = ids.join(F.broadcast(ideal.select("symbol", F.col("weight").alias("w2"))), F.lit(True))  # a model of a few symbols
    both = holdings.select("portfolio_id", "symbol", F.col("weight").alias("w1"), "value").unionByName(goal, True).na.fill(0.0, ["w1", "w2", "value"]).repartition("portfolio_id")
    both = both.groupBy("portfolio_id", "symbol").agg(*[F.sum(c).alias(c) for c in ("w1", "w2", "value")])
    have = facts.select("symbol", F.lit(1.0).alias("_in"), *[F.col(c).cast("double") for c in FACTS if c in facts.columns])
    cols = ["w1", "w2", "value", "_in", *[c for c in FACTS if c in facts.columns]]
    rows = both.join(F.broadcast(have), "symbol", "left")  # one row an instrument
    lists = rows.groupBy("portfolio_id").agg(*[F.collect_list(F.coalesce(c, F.lit(float("nan")))).alias(c) for c in cols])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield _blended(batch.slice(at, TOGETHER), n)

    kind = lists.schema["portfolio_id"].dataType.simpleString()
    return lists.mapInArrow(run, f"portfolio_id {kind}, blend double, " + ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in SUMS))


def _blended(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """``blend_sums`` of some portfolios; the elements of all lie one after another."""
    x = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "portfolio_id"}
    size = np.diff(batch.column("w1").offsets.to_numpy())
    start = np.cumsum(size) - size
    many = lambda v: np.repeat(v, size)
    add, most = (lambda v: np.add.reduceat(v, start)), (lambda v: np.maximum.reduceat(v, start))
    none = np.full(len(x["w1"]), np.nan)
    get = {c: x.get(c, none) for c in FACTS}
    zero = lambda v: np.where(np.isnan(v), 0.0, v)
    w1, w2, price, value = x["w1"], x["w2"], get["price"], add(x["value"])
    t1, t2, worth = add(w1), add(w2), many(add(x["value"]))
    raw, adjusted, priced, poor = zero(get["raw_upside_pct"]), zero(get["adjusted_pct"]), price > 0, get["poor"] == 1
    known, base = ~np.isnan(get["quality_score"]), add(w1 * adjusted)
    out = {c: [] for c in ("blend", *SUMS)}
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a, b: np.where(b != 0, a / b, np.nan)
        for k in range(n + 1):
            b = round(k / n, 4)
            w = (w1 * (1 - b) + w2 * b) / many(t1 * (1 - b) + t2 * b)
            kept = np.round(w, 10) > 0.001
            w = np.where(kept, w, 0.0)

            def summed(c, kept=kept, w=w):
                has = kept & ~np.isnan(get[c])
                return np.where(most(has), add(w * zero(get[c])), np.nan)

            found = {"blend": np.full(len(size), b), "n": add(kept.astype(np.int64)), "total": add(w), "hhi": add(w * w), "top": most(w)}
            found |= {s: summed(c) * f for s, c, f in (("expected_return", "upside", 100), ("sharpe", "sharpe", 1), ("momentum", "momentum", 1)) if c in x}
            if "quality_score" not in x:  # the other sums need ratings
                for c, v in out.items():
                    v.append(found.get(c, base * np.nan))
                continue
            rc = w * raw
            size_of, gain = np.abs(rc), np.maximum(rc, 0.0)
            first = most(size_of)
            second = np.where(add((size_of == many(first)).astype(int)) > 1, first, np.maximum(most(np.where(size_of == many(first), 0.0, size_of)), 0.0))
            move = np.abs(w - w1)
            shares = np.maximum(1.0, np.floor(np.round(move * worth / price, 6)))
            traded = np.where(np.round(move, 10) >= 0.001, np.where(priced, shares * price, move * worth), 0.0)
            found |= {"adjusted": add(w * adjusted), "base": base, "quality": part(add(np.where(known, w * zero(get["quality_score"]), 0.0)), add(np.where(known, w, 0.0))), "suspicious_pct": part(add(np.where(poor, gain, 0.0)), add(gain)) * 100, "top2": part(first + second, add(size_of)) * 100, "turnover_pct": part(add(traded), value) * 100}
            for c, v in out.items():
                v.append(found.get(c, base * np.nan))
    ids = pa.chunked_array([batch.column("portfolio_id")] * (n + 1)).combine_chunks()
    cols = {c: np.concatenate(v) for c, v in out.items()}
    whole = pa.RecordBatch.from_arrays([ids, *[pa.array(v, mask=np.isnan(v)) if v.dtype == float else pa.array(v) for v in cols.values()]], ["portfolio_id", *cols])
    return whole.filter(pa.array(cols["n"] > 0))


def transition_trades(holdings: DataFrame, target: DataFrame, prices: DataFrame, cost_pct: float | DataFrame) -> DataFrame:
    """Per symbol whose weight moves by 0.001 or more: action, whole shares (1 at least), value and cost.

    A number of shares within a millionth of a whole one counts as whole.
    ``cost_pct`` is one per cent for all, or (portfolio_id, cost_pct); a portfolio without one pays nothing.
    """
    keys = [c for c in target.columns if c in ("portfolio_id", "blend")]
    own = holdings.select("portfolio_id", "symbol", F.col("weight").alias("current_weight"), "value", F.lit(1).alias("_own"))
    if "blend" in keys:
        own = own.join(target.select("portfolio_id", "blend").distinct(), "portfolio_id")
    both = own.unionByName(target.select(*keys, "symbol", F.col("weight").alias("target_weight")), True).repartition("portfolio_id")  # one shuffle for all that goes by portfolio
    d = both.groupBy(*keys, "symbol").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("current_weight", "target_weight")], F.sum("value").alias("value"), F.max("_own").alias("_own"))
    whole = Window.partitionBy(*keys)
    d = d.withColumns({"_total": F.sum("value").over(whole), "_own": F.max("_own").over(whole)}).where("_own is not null").drop("value", "_own").join(prices.select("symbol", "price"), "symbol", "left")  # one price a symbol
    if isinstance(cost_pct, DataFrame):
        d = d.join(cost_pct.select("portfolio_id", F.col("cost_pct").alias("_cost")), "portfolio_id", "left").na.fill(0.0, ["_cost"])
    else:
        d = d.withColumn("_cost", F.lit(float(cost_pct)))
    delta = F.col("target_weight") - F.col("current_weight")
    d = d.withColumn("weight_change", delta).where(at_hand(F.abs("weight_change")) >= 0.001)
    d = d.withColumn("shares", F.when(F.col("price") > 0, F.greatest(F.lit(1), F.floor(F.round(F.abs("weight_change") * F.col("_total") / F.col("price"), 6)))).otherwise(0))
    d = d.withColumn("trade_value", F.when(F.col("price") > 0, F.col("shares") * F.col("price")).otherwise(F.abs("weight_change") * F.col("_total")))
    return d.select(*keys, "symbol", F.when(F.col("weight_change") > 0, "BUY").otherwise("SELL").alias("action"), "current_weight", "target_weight", "weight_change", "price", "shares", "trade_value", (F.col("trade_value") * F.col("_cost") / 100).alias("cost"), F.col("_total").alias("portfolio_value"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Per portfolio (and blend): bought, sold, cost and turnover per cent of its value."""
    keys = [c for c in ("portfolio_id", "blend") if c in trades.columns]
    buy = F.col("action") == "BUY"
    g = trades.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(buy, F.col("trade_value")).otherwise(0.0)).alias("bought"), F.sum(F.when(buy, 0.0).otherwise(F.col("trade_value"))).alias("sold"), F.sum("cost").alias("cost"), F.max("portfolio_value").alias("_v"))
    return g.select(*keys, "n", "bought", "sold", "cost", ((F.col("bought") + F.col("sold")) / F.col("_v") * 100).alias("turnover_pct"))


def damped(c: Column, unit: float, slope: float = 1.0) -> Column:
    """Logarithm of gains in units, losses as they are over ``slope``; null as 0."""
    return F.when(c.isNull(), 0.0).when(c > 0, F.log1p(c) / unit).otherwise(c / slope)


def score_candidates(candidates: DataFrame, w: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """score of candidates by expected_return (per cent), sharpe and momentum."""
    s = w[0] * damped(F.col("expected_return") / 100, 0.693, 0.20) + w[1] * damped(F.col("sharpe"), 1.386) + w[2] * damped(F.col("momentum"), 1.098)
    return candidates.withColumn("score", s)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per portfolio the blend of the best score; the smallest among equals."""
    g = score_candidates(candidates).groupBy("portfolio_id").agg(F.max_by(F.struct("blend", "score"), F.struct(F.round("score", 10), -F.col("blend"))).alias("b"))
    return g.select("portfolio_id", "b.*")


def amount(x: float | str) -> Column:
    """A number for all rows, or the column of that name (one value a portfolio)."""
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def discretize(weights: DataFrame, value: float | str, prices: DataFrame) -> DataFrame:
    """Whole shares (1 at least) and the weights that they give; without a price the allocation is kept with no shares.

    ``value`` is a number, or the column of ``weights`` that holds each portfolio's value.
    """
    value = amount(value)
    d = weights.join(prices.select("symbol", "price"), "symbol", "left")
    d = d.withColumn("shares", F.when(F.col("price") > 0, F.greatest(F.lit(1), F.floor(F.col("weight") * value / F.col("price")))).otherwise(0))
    d = d.withColumn("value", F.when(F.col("price") > 0, F.col("shares") * F.col("price")).otherwise(F.col("weight") * value))
    total = F.sum("value").over(Window.partitionBy("portfolio_id"))
    return d.withColumn("new_weight", F.try_divide("value", total))


def return_contributors(weights: DataFrame, quality: DataFrame) -> DataFrame:
    """Per holding: raw and shrunk contribution (weight times return, per cent) and rank by its size."""
    d = weights.join(quality.select("symbol", "source", "quality_bucket", "quality_score", "raw_upside_pct", "adjusted_pct"), "symbol", "left")  # one row a symbol
    d = d.withColumns({"raw_contribution": F.col("weight") * F.coalesce("raw_upside_pct", F.lit(0.0)), "adjusted_contribution": F.col("weight") * F.coalesce("adjusted_pct", F.lit(0.0))})
    keys = [c for c in ("portfolio_id", "blend") if c in weights.columns]
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.round("raw_contribution", 10))), "symbol")))


def return_concentration(contributors: DataFrame) -> DataFrame:
    """Shares of the first, two and five largest contributions, per cent."""
    keys = [c for c in ("portfolio_id", "blend") if c in contributors.columns]
    size = F.abs("raw_contribution")
    return contributors.groupBy(*keys).agg(*[(F.try_divide(F.sum(F.when(F.col("rank") <= k, size).otherwise(0.0)), F.sum(size)) * 100).alias(f"top{k}") for k in (1, 2, 5)])


def contribution_by(contributors: DataFrame, col: str) -> DataFrame:
    """Weight and contributions by source, bucket or another column."""
    return contributors.groupBy("portfolio_id", col).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("raw_contribution").alias("raw"), F.sum("adjusted_contribution").alias("adjusted"))


def quality_metrics(contributors: DataFrame) -> DataFrame:
    """Weighted quality, weight of low and rejected targets, and their share of positive contributions."""
    keys = [c for c in ("portfolio_id", "blend") if c in contributors.columns]
    poor, gain = F.col("quality_bucket").isin("low", "reject"), F.greatest("raw_contribution", F.lit(0.0))
    known = F.col("quality_score").isNotNull()
    return contributors.groupBy(*keys).agg(F.try_divide(F.sum(F.when(known, F.col("weight") * F.col("quality_score"))), F.sum(F.when(known, F.col("weight")))).alias("quality"), (F.sum(F.when(poor, F.col("weight")).otherwise(0.0)) * 100).alias("low_reject_pct"), (F.try_divide(F.sum(F.when(poor, gain).otherwise(0.0)), F.sum(gain)) * 100).alias("suspicious_pct"))


def signal_persistence(history: DataFrame, today: DataFrame | None = None) -> DataFrame:
    """Per portfolio: the run of latest dates (last row of each) whose gain reached the hurdle, and today if it did.

    ``today`` is (portfolio_id, passes); a failure today makes it 0.
    """
    daily = history.groupBy("portfolio_id", "date").agg(F.max_by(F.col("gain") >= F.col("hurdle"), F.struct("timestamp", "run_id")).alias("ok"))
    failed = F.max((~F.col("ok")).cast("int")).over(Window.partitionBy("portfolio_id").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0))
    g = daily.withColumn("_f", failed).groupBy("portfolio_id").agg(F.count_if(F.col("_f") == 0).alias("days"))
    if today is None:
        return g
    return g.join(today, "portfolio_id", "full_outer").select("portfolio_id", F.when(F.coalesce("passes", F.lit(False)), F.coalesce("days", F.lit(0)) + 1).otherwise(0).alias("days"))


@dataclass(frozen=True)
class GateParams:
    """Fixed values of the gate: hurdle parts, budget and floors."""

    base_hurdle: float = 0.5
    slippage: float = 0.15
    tax_drag: float = 0.0
    uncertainty: float = 0.5
    budget: float = 35.0
    floor: float = 0.60
    suspicious: float = 35.0
    persistence: int = 2
    partial_gain: float = 1.0


def rebalance_gate(metrics: DataFrame, p: GateParams = GateParams(), aggressive: bool = False) -> DataFrame:
    """hurdle, vetoes and decision from (official, gain, cost, hurdle_addon, turnover_mult, turnover, quality, suspicious, days).

    The aggressive variant only asks for the gain.
    """
    c = F.col
    d = metrics.withColumn("hurdle", p.base_hurdle + c("cost") + p.slippage + p.tax_drag + p.uncertainty + c("hurdle_addon")).withColumn("budget", p.budget * c("turnover_mult"))
    checks = [("adjusted_gain_below_hurdle", c("gain") < c("hurdle"))]
    if not aggressive:
        checks += [("signal_not_persistent", c("days") < p.persistence), ("turnover_above_budget", c("turnover") > c("budget")), ("target_quality_below_floor", c("quality") < p.floor), ("suspicious_return_contribution_high", c("suspicious") > p.suspicious)]
    d = d.withColumn("vetoes", F.array_compact(F.array(*[F.when(cond, name) for name, cond in checks])))
    free = F.size("vetoes") == 0
    only = (F.size("vetoes") == 1) & F.array_contains("vetoes", "turnover_above_budget") & (c("gain") >= F.greatest(c("hurdle"), F.lit(p.partial_gain)))
    return d.withColumn("decision", F.when((c("official") != "REBALANCE") & ~free, "HOLD").when(free, "REBALANCE").when(only, "PARTIAL_REBALANCE").otherwise("WATCH"))


def execution_plan(trades: DataFrame, gate: DataFrame, band: float = 1.0, least: float = 25.0, actions: int = 6, weekly: float = 10.0, monthly: float = 25.0) -> DataFrame:
    """Status, shares and value that may be executed today, per trade in the order of its weight change.

    An ordered fold over one portfolio's trades carries the remaining budget and the number of actions.
    """
    row = F.struct((-F.abs(F.round("weight_change", 10))).alias("o"), "symbol", "action", "price", "shares", "trade_value", "weight_change")
    g = trades.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(row)).alias("ts"), F.max("portfolio_value").alias("pv")).join(gate.select("portfolio_id", "decision", F.col("budget").alias("limit")), "portfolio_id")
    c = F.col
    pct = F.when(c("decision") == "REBALANCE", F.least(c("limit"), F.lit(monthly))).when(c("decision") == "PARTIAL_REBALANCE", F.least(c("limit"), F.lit(weekly), F.lit(monthly))).otherwise(0.0)
    g = g.withColumn("left", c("pv") * pct / 100)
    kind = "array<struct<symbol:string,action:string,status:string,shares:bigint,value:double>>"
    zero = F.struct(F.col("left").alias("left"), F.lit(0).alias("n"), F.col("decision").alias("d"), F.array().cast(kind).alias("rows"))

    def step(a: Column, t: Column) -> Column:
        full, part = a["d"] == "REBALANCE", a["d"] == "PARTIAL_REBALANCE"
        can = F.when(at_hand(F.abs(t["weight_change"]) * 100) < band, "IGNORE_BAND").when(at_hand(t["trade_value"]) < least, "IGNORE_SMALL").when(~full & ~part, F.when(a["d"] == "WATCH", "MONITOR").otherwise("HOLD")).when(part & (a["n"] >= actions), "DEFER_MAX_ACTIONS").when(a["left"] <= 0, "DEFER_BUDGET")
        shares = F.when(full, t["shares"]).when(t["price"] > 0, F.least(t["shares"], F.floor(a["left"] / t["price"]))).otherwise(0).cast("bigint")
        value = F.when(full, t["trade_value"]).when((t["price"] > 0) & (t["shares"] > 0), shares * t["price"]).otherwise(F.least(t["trade_value"], a["left"]))
        ok = can.isNull() & (at_hand(value) >= least) & ((shares > 0) | (t["shares"] == 0))
        done = F.struct(t["symbol"].alias("symbol"), t["action"].alias("action"), F.when(can.isNotNull(), can).when(ok, "EXECUTE").otherwise("DEFER_BUDGET").alias("status"), F.when(ok, shares).otherwise(F.lit(0).cast("bigint")).alias("shares"), F.when(ok, value).otherwise(0.0).alias("value"))
        return F.struct((a["left"] - F.when(ok, value).otherwise(0.0)).alias("left"), (a["n"] + F.when(ok, 1).otherwise(0)).alias("n"), a["d"].alias("d"), F.array_append(a["rows"], done).alias("rows"))

    return g.select("portfolio_id", "decision", F.explode(F.aggregate("ts", zero, step, lambda a: a["rows"])).alias("r")).select("portfolio_id", "decision", "r.*")


def sector_drift(holdings: DataFrame, target: DataFrame, instruments: DataFrame, band: float = 3.0) -> DataFrame:
    """Per portfolio and sector: current and target weight (per cent), drift, and whether it leaves the band."""
    named = lambda d, c: d.join(instruments.select("symbol", "sector"), "symbol", "left").groupBy("portfolio_id", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg((F.sum("weight") * 100).alias(c))
    d = named(holdings, "current").join(named(target, "target"), ["portfolio_id", "sector"], "full_outer").na.fill(0.0)
    return d.withColumn("drift", F.col("target") - F.col("current")).withColumn("outside", F.abs("drift") >= band)


def stable_frontier(candidates: DataFrame, contributors: DataFrame, summary: DataFrame, base: DataFrame, turn: float = 0.05, excess: float = 0.10, budget: float = 35.0, unsure: float = 4.0, concentrated: float = 0.03, suspicious: float = 0.05) -> DataFrame:
    """Per portfolio and blend: adjusted gain less five penalties, the best row marked, and what it saves in turnover.

    ``base`` is (portfolio_id, adjusted return of the holdings); ``candidates`` has the official score.
    """
    keys = ["portfolio_id", "blend"]
    q, conc = quality_metrics(contributors), return_concentration(contributors)
    r = contributors.groupBy(*keys).agg(F.sum("adjusted_contribution").alias("adjusted"))
    d = candidates.join(r, keys).join(q, keys).join(conc, keys).join(summary.select(*keys, "turnover_pct"), keys, "left").join(base.withColumnRenamed("adjusted", "base"), "portfolio_id").na.fill(0.0, ["turnover_pct"])
    return frontier(d, turn, excess, budget, unsure, concentrated, suspicious)


def frontier(d: DataFrame, turn: float = 0.05, excess: float = 0.10, budget: float = 35.0, unsure: float = 4.0, concentrated: float = 0.03, suspicious: float = 0.05) -> DataFrame:
    """``stable_frontier`` from the sums of each portfolio and blend, as ``blend_sums`` has them, and the official score."""
    keys, c = ["portfolio_id", "blend"], F.col
    gain = c("adjusted") - c("base")
    score = gain - turn * c("turnover_pct") - excess * F.greatest(c("turnover_pct") - budget, F.lit(0.0)) - unsure * (1 - F.coalesce("quality", F.lit(0.0))) - concentrated * F.greatest(F.coalesce("top2", F.lit(0.0)) - 50, F.lit(0.0)) - suspicious * F.coalesce("suspicious_pct", F.lit(0.0))
    d = d.withColumn("stable_score", score)
    best = d.groupBy("portfolio_id").agg(F.max_by("blend", F.struct(F.round("stable_score", 8), -F.col("blend"))).alias("best"), F.max_by("turnover_pct", F.struct(F.round("score", 10), -F.col("blend"))).alias("official_turnover"), F.max_by("turnover_pct", F.struct(F.round("stable_score", 8), -F.col("blend"))).alias("best_turnover"))
    return d.join(best, "portfolio_id").select(*keys, "adjusted", "turnover_pct", "stable_score", (c("blend") == c("best")).alias("selected"), (c("official_turnover") - c("best_turnover")).alias("turnover_saved"))


@dataclass(frozen=True)
class BalancedParams:
    """Fixed values of the balanced universe."""

    quality: float = 0.30
    history: int = 100
    adtv: float = 1000.0
    target_cap: float = 40.0
    cap: float = 30.0
    dividend_cap: float = 12.0
    weights: tuple[float, float, float, float, float] = (0.35, 0.25, 0.15, 0.15, 0.10)
    unsure: float = 6.0
    vol: float = 0.08
    free_drawdown: float = 15.0
    drawdown: float = 0.04
    low: float = 8.0
    thin: float = 2.0
    bonus: float = 3.0
    stress_penalty: float = 2.0
    stress_mult: float = 0.5


def balanced_universe(scored: DataFrame, history: DataFrame, state: str = "normal", p: BalancedParams = BalancedParams()) -> DataFrame:
    """reason (null if eligible) by the first rule that excludes, and the balanced score of every instrument."""
    c = F.col
    d = scored.join(history.select("symbol", F.col("rows").alias("_rows"), F.col("traded_value").alias("_traded"), F.col("max_drawdown").alias("_dd")), "symbol", "left")
    adtv = F.coalesce("_traded", F.col("average_volume") * F.col("price"), F.lit(0.0))
    reason = F.when(c("price").isNull() | (c("price") <= 0), "missing_current_price").when(c("quality_bucket") == "reject", "target_quality_reject").when(c("quality_score") < p.quality, "target_quality_below_minimum").when(F.array_contains("quality_flags", "target_class_mismatch_suspected"), "target_class_mismatch").when(F.coalesce("_rows", F.lit(0)) < p.history, "insufficient_price_history").when(adtv < p.adtv, "liquidity_below_minimum")
    mult, penalty = {"stress": (p.stress_mult, p.stress_penalty), "volatile_watch": ((1 + p.stress_mult) / 2, p.stress_penalty / 2)}.get(state, (1.0, 0.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    value = F.when((c("forward_pe") > 0) & (c("sector_pe") > 0), clip((F.try_divide("sector_pe", "forward_pe") - 1) * 10, -30.0, 30.0)).otherwise(0.0)
    w = p.weights
    expected = clip(zero(c("adjusted_pct")), -p.target_cap, p.target_cap) * w[0] * mult + clip(zero(c("annual_mean")) * 100, -p.cap, p.cap) * w[1] + clip(zero(c("momentum")) * 100, -p.cap, p.cap) * w[2] + value * w[3] + clip(zero(c("dividend_yield")), 0.0, p.dividend_cap) * w[4] - F.greatest(1 - zero(c("quality_score")), F.lit(0.0)) * p.unsure - penalty
    score = expected + zero(c("quality_score")) * p.bonus + zero(c("score")) * p.bonus - zero(c("annual_std")) * 100 * p.vol - F.greatest(zero(c("_dd")) * 100 - p.free_drawdown, F.lit(0.0)) * p.drawdown - F.when(c("quality_bucket") == "low", p.low).otherwise(0.0) - F.when(adtv < 2 * p.adtv, p.thin).otherwise(0.0)
    return d.withColumns({"reason": reason, "balanced_expected": expected, "balanced_score": score, "adtv": adtv}).drop("_rows", "_traded", "_dd")


def reason_counts(universe: DataFrame) -> DataFrame:
    return universe.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def capped_weights(selected: DataFrame, max_sector: float = 0.30, max_low: float = 0.08, passes: int = 8) -> DataFrame:
    """(portfolio_id, symbol, weight) from scores: water-filled under caps, then sector and low-quality caps.

    ``selected`` is (portfolio_id, symbol, sector, quality_bucket, score, cap), a few rows a portfolio, which are shuffled
    to one row. Many portfolios are filled at once, a row of a matrix each. A null sector has no cap.
    """
    r = F.struct("symbol", "sector", F.coalesce(F.col("quality_bucket") == "low", F.lit(False)).alias("low"), F.col("score").cast("double").alias("score"), F.col("cap").cast("double").alias("cap"))
    lists = selected.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(r)).alias("r")).withColumn("_s", F.array_sort(F.array_distinct(F.array_compact("r.sector"))))
    group = F.transform("r.sector", lambda x: F.coalesce(F.array_position("_s", x), F.lit(0)))  # from 1, in the order of names
    lists = lists.select(F.col("portfolio_id").cast("string").alias("portfolio_id"), F.col("r.symbol").alias("symbol"), group.alias("group"), F.col("r.low").alias("low"), F.col("r.score").alias("score"), F.col("r.cap").alias("cap"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield _capped(batch.slice(at, TOGETHER), max_sector, max_low, passes)

    return lists.mapInArrow(run, "portfolio_id string, symbol string, weight double")


def _capped(batch: pa.RecordBatch, max_sector: float, max_low: float, passes: int) -> pa.RecordBatch:
    """``capped_weights`` of some portfolios, a row each; missing numbers don't count in sums."""
    size = np.diff(batch.column("score").offsets.to_numpy())
    there = np.arange(size.max())[None, :] < size[:, None]

    def matrix(c: str, empty: float) -> np.ndarray:
        out = np.full(there.shape, empty)
        out[there] = batch.column(c).flatten().to_numpy(zero_copy_only=False)
        return out

    score, cap = np.maximum(matrix("score", np.nan), 1e-4), matrix("cap", np.nan)
    group, low = matrix("group", 0), matrix("low", 0) > 0
    total = lambda x, at: np.nansum(np.where(at, x, 0.0), 1)
    weight, free = np.zeros(there.shape), there.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        open_ = there.any(1)
        while open_.any():
            rest = 1 - total(weight, ~free)
            open_ &= free.any(1) & (rest > 0)
            share = rest[:, None] * score / total(score, free)[:, None]
            over = (share > cap) & free & open_[:, None]
            done = open_ & ~over.any(1)
            weight = np.where(done[:, None] & free, share, np.where(over, cap, weight))
            free &= ~over
            open_ &= ~done
        whole = total(weight, there)[:, None]
        weight = np.where(whole > 0, weight / whole, weight)

        groups = [(group == k, max_sector) for k in range(1, int(group.max()) + 1)] + [(low, max_low)]
        busy = np.ones(len(size), dtype=bool)
        for _ in range(passes):
            changed = np.zeros(len(size), dtype=bool)
            for members, most in groups:
                held = total(weight, members)
                hit = busy & (held > most + 1e-9)
                if not hit.any():
                    continue
                changed |= hit
                weight = np.where(members & hit[:, None], weight * (most / held)[:, None], weight)
                freed, turns = np.where(hit, held - most, 0.0), 0
                while True:  # what is freed goes to the others, as their caps allow
                    takes = there & ~members & (weight < cap - 1e-9) & (hit & (freed > 1e-9) & (turns <= size))[:, None]
                    if not takes.any():
                        break
                    add = np.where(takes, np.fmin(freed[:, None] * score / total(score, takes)[:, None], cap - weight), 0.0)
                    weight, freed, turns = weight + add, freed - total(add, takes), turns + 1
            busy &= changed
            if not busy.any():
                break
        weight = np.where(weight > 1e-4, weight, 0.0) / total(weight, there)[:, None]
    kept = (weight > 0) & there
    at = pa.array(kept[there])
    ids = batch.column("portfolio_id").take(pa.array(np.repeat(np.arange(len(size)), kept.sum(1))))
    return pa.RecordBatch.from_arrays([ids, batch.column("symbol").flatten().filter(at), pa.array(weight[kept])], ["portfolio_id", "symbol", "weight"])


def constraint_violations(weights: DataFrame, meta: DataFrame, asset: float = 12.0, sector: float = 30.0, low: float = 8.0, top5: float = 50.0, hhi: float = 0.12, least: int = 8, most: int = 20, tolerance: float = 0.0) -> DataFrame:
    """(portfolio_id, code, actual, threshold) of every limit that a portfolio breaks."""
    d = weights.join(meta.select("symbol", "sector", "quality_bucket"), "symbol", "left").withColumn("_p", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("weight"), "symbol")))
    s = d.groupBy("portfolio_id", "sector").agg(F.sum("weight").alias("w")).groupBy("portfolio_id").agg((F.max("w") * 100).alias("sector"))
    g = d.groupBy("portfolio_id").agg((F.max("weight") * 100).alias("asset"), (F.sum(F.when(F.col("quality_bucket") == "low", F.col("weight")).otherwise(0.0)) * 100).alias("low"), (F.sum(F.when(F.col("_p") <= 5, F.col("weight")).otherwise(0.0)) * 100).alias("top5"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.count_if(F.col("weight") > 0).cast("double").alias("n")).join(s, "portfolio_id")
    c = F.col
    checks = [("max_asset_weight_pct", c("asset"), asset, c("asset") > asset + tolerance), ("max_sector_weight_pct", c("sector"), sector, c("sector") > sector + tolerance), ("max_low_quality_weight_pct", c("low"), low, c("low") > low + tolerance), ("max_top5_weight_pct", c("top5"), top5, c("top5") > top5 + tolerance), ("max_hhi", c("hhi"), hhi, c("hhi") > hhi + max(0.0001, tolerance / 100)), ("min_positions", c("n"), float(least), c("n") < least), ("max_positions", c("n"), float(most), c("n") > most)]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), actual.alias("actual"), F.lit(float(limit)).alias("threshold"))) for code, actual, limit, cond in checks]))
    return g.select("portfolio_id", F.explode(found).alias("v")).select("portfolio_id", "v.*")


def destination(plans: DataFrame, options: DataFrame) -> DataFrame:
    """Per portfolio: the option (official, stable, balanced) to head for, what it gains over the others, and the decision.

    ``options`` is (portfolio_id, option, expected, turnover, cost, violations); options that break limits
    lose to those that don't; the greater expected return less cost wins, then the smaller turnover.
    """
    net = F.col("expected") - F.col("cost")
    order = F.struct((F.col("violations") == 0).alias("ok"), F.round(net, 8), -F.round("turnover", 8), "option")
    g = options.groupBy("portfolio_id").agg(F.max_by(F.struct("option", net.alias("net"), "turnover", "violations"), order).alias("d"), F.count("*").alias("options"), F.max(F.when(F.col("option") == "official", net)).alias("official_net"))
    return g.join(plans.select("portfolio_id", "decision"), "portfolio_id", "left").select("portfolio_id", "options", F.col("d.option").alias("destination"), F.col("d.net").alias("net"), "d.turnover", (F.col("d.net") - F.col("official_net")).alias("gain_over_official"), F.when(F.col("decision").isin("HOLD", "WATCH"), F.col("decision")).otherwise(F.coalesce("decision", F.lit("HOLD"))).alias("decision"))
