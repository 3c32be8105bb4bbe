"""Returns, windows and other time-series operators over long bars (symbol, date, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantjobs.operators.scan import running

YEAR = 252


def by(key: str | list[str], order: str = "date") -> Window:
    return Window.partitionBy(key).orderBy(order)


def calendar(bars: DataFrame) -> DataFrame:
    """(date, idx): the global trading days, numbered from 1. Only distinct dates meet in one task."""
    return bars.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")))


def daily_returns(bars: DataFrame) -> DataFrame:
    """ret without filling: null unless the symbol also closed on the global day before."""
    w = by("symbol")
    dated = bars.join(F.broadcast(calendar(bars)), "date")  # as many rows as trading days
    step = F.col("idx") - F.lag("idx").over(w)
    return dated.withColumn("ret", F.when(step == 1, F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)).select("symbol", "date", "idx", "close", "ret")


def padded(bars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Every symbol on every global day since its first one, the last close carried forward.

    The days are those of ``market``, where ``bars`` are only some symbols of it.
    """
    spans = bars.groupBy("symbol").agg(F.min("date").alias("first"))
    days = (bars if market is None else market).select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("days"))  # one array of trading days
    grid = spans.join(F.broadcast(days.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).select("symbol", F.explode(F.filter("days", lambda d: d >= F.col("first"))).alias("date"))
    filled = F.last("close", ignorenulls=True).over(by("symbol"))
    return grid.join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left").select("symbol", "date", filled.alias("close"))


def daily_returns_padded(bars: DataFrame) -> DataFrame:
    """ret after filling: 0 on a day without a trade once the symbol has started."""
    return padded(bars).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by("symbol"))) - 1)


def momentum(bars: DataFrame, n: int = 126) -> DataFrame:
    """Close on the last global day over the close n global days before; null if either is missing."""
    dated = bars.join(F.broadcast(calendar(bars)), "date")
    last = F.broadcast(calendar(bars).agg(F.max("idx").alias("_last")))  # one row
    ends = dated.join(last, F.col("idx").isin(F.col("_last"), F.col("_last") - n))
    sides = ends.groupBy("symbol").agg(F.max(F.when(F.col("idx") == F.col("_last"), F.col("close"))).alias("b"), F.max(F.when(F.col("idx") < F.col("_last"), F.col("close"))).alias("a"))
    return bars.select("symbol").distinct().join(sides, "symbol", "left").select("symbol", (F.col("b") / F.col("a") - 1).alias("momentum"))


def momentum_blend(bars: DataFrame, ns: tuple[int, ...] = (63, 126, 252)) -> DataFrame:
    """Mean of the momenta over several spans that exist."""
    parts = None
    for n in ns:
        one = momentum(bars, n)
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("symbol").agg(F.avg("momentum").alias("momentum"))


def recent(bars: DataFrame, col: str = "date") -> DataFrame:
    """``bars`` with pos: 1 for a symbol's latest row, 2 for the one before."""
    return bars.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(col))))


def portfolio_momentum(bars: DataFrame, weights: DataFrame, n: int = YEAR) -> DataFrame:
    """Weighted mean over the holdings of latest over n-th latest own close, of those with n closes."""
    own = recent(bars.where("close is not null").join(weights.select("symbol"), "symbol", "left_semi"))
    ends = own.where(F.col("pos").isin(1, n)).groupBy("symbol").agg(F.max(F.when(F.col("pos") == 1, F.col("close"))).alias("b"), F.max(F.when(F.col("pos") == n, F.col("close"))).alias("a"))
    got = ends.where("a > 0").join(weights, "symbol")
    return got.agg((F.sum(F.col("weight") * (F.col("b") / F.col("a") - 1)) / F.sum("weight")).alias("momentum"))


def latest_price(bars: DataFrame, mode: str = "last_available") -> DataFrame:
    """(symbol, price): the last close, or with ``last_date`` the close on the final global day only."""
    if mode == "last_available":
        return bars.where("close is not null").groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    last = F.broadcast(bars.agg(F.max("date").alias("_last")))
    return bars.join(last, F.lit(True)).groupBy("symbol").agg(F.max(F.when(F.col("date") == F.col("_last"), F.col("close"))).alias("price"))


def calendar_return(bars: DataFrame, days: int = 365) -> DataFrame:
    """Latest close over the last close at least ``days`` calendar days before, else over the oldest."""
    last = F.max("date").over(Window.partitionBy("symbol"))
    old = F.col("date") <= F.date_sub("_last", days)
    g = bars.withColumn("_last", last).groupBy("symbol").agg(F.max_by("close", "date").alias("b"), F.max_by(F.when(old, F.col("close")), F.when(old, F.col("date"))).alias("a"), F.min_by("close", "date").alias("o"))
    return g.select("symbol", (F.col("b") / F.coalesce("a", "o") - 1).alias("ret"))


def risk_return(returns: DataFrame, rf: float = 0.0) -> DataFrame:
    """Annual mean, standard deviation (ddof 1) and Sharpe ratio a symbol; Sharpe is 0 without deviation."""
    g = returns.groupBy("symbol").agg((F.avg("ret") * YEAR).alias("annual_mean"), (F.stddev_samp("ret") * F.sqrt(F.lit(YEAR))).alias("annual_std"))
    return g.withColumn("sharpe", F.when(F.col("annual_std") > 0, (F.col("annual_mean") - rf) / F.col("annual_std")).otherwise(0.0))


def growth_index(returns: DataFrame, base: float = 100.0, keys: list[str] | None = None) -> DataFrame:
    """index: base times the running product of 1 + ret, null returns as 0. A hot key, or no key, is scanned by months."""
    grown = running(returns.withColumn("_f", 1 + F.coalesce("ret", F.lit(0.0))), keys or [], ["date"], {"index": ("_f", "product")})
    return grown.drop("_f").withColumn("index", F.lit(base) * F.col("index"))


def drawdown(df: DataFrame, value_col: str, keys: list[str] | None = None) -> DataFrame:
    """drawdown: 1 - value / running peak, 0 at a peak. A hot key, or no key, is scanned by months."""
    return running(df, keys or [], ["date"], {"_peak": (value_col, "max")}).withColumn("drawdown", 1 - F.col(value_col) / F.col("_peak")).drop("_peak")


def max_drawdown(df: DataFrame, value_col: str, keys: list[str]) -> DataFrame:
    return drawdown(df, value_col, keys).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))


def rolling_vol(returns: DataFrame, n: int = 20) -> DataFrame:
    """vol: annual deviation of the last n returns, null until there are n."""
    w = by("symbol").rowsBetween(-(n - 1), 0)
    return returns.withColumn("vol", F.when(F.count("ret").over(w) == n, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(YEAR))))


def vol_percentile(vols: DataFrame, count_nulls: bool = True) -> DataFrame:
    """Share of a symbol's history below its current volatility; warm-up nulls count in the denominator or not."""
    now = vols.groupBy("symbol").agg(F.max_by("vol", "date").alias("now"), (F.count("*") if count_nulls else F.count("vol")).alias("n"))
    below = vols.join(now, "symbol").groupBy("symbol", "now", "n").agg(F.count_if(F.col("vol") < F.col("now")).alias("k"))
    return below.where("now is not null and n > 0").select("symbol", F.col("now").alias("vol"), (F.col("k") / F.col("n")).alias("percentile"))


def forward_fill(df: DataFrame, keys: list[str], order: str, col: str) -> DataFrame:
    """``col`` with the last value that is not null where it is null; ``order`` is a date, timestamp or number."""
    return running(df.withColumn("_v", F.col(col)), keys, [order], {col: ("_v", "last")}).select(*df.columns)


def least_rows(n: int) -> int:
    """Observations that a window of n needs."""
    return max(20, int(0.45 * n))


def window_return(bars: DataFrame, n: int) -> DataFrame:
    """Return over a symbol's last n + 1 closes, if there are enough."""
    own = recent(bars.where("close is not null")).where(F.col("pos") <= n + 1)
    g = own.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "date").alias("b"), F.min_by("close", "date").alias("a"))
    return g.where(F.col("n") >= least_rows(n)).select("symbol", (F.col("b") / F.col("a") - 1).alias("ret"))


def window_drawdown(bars: DataFrame, n: int) -> DataFrame:
    """Last close over the peak of the last n closes, less 1, if there are enough."""
    own = recent(bars.where("close is not null")).where(F.col("pos") <= n)
    g = own.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "date").alias("b"), F.max("close").alias("peak"))
    return g.where(F.col("n") >= least_rows(n)).select("symbol", (F.col("b") / F.col("peak") - 1).alias("drawdown"))


def history_metrics(bars: DataFrame, traded: int = 21, peak: int = 126) -> DataFrame:
    """Rows, mean traded value of the last rows with volume, and worst drawdown over the last closes."""
    full = bars.where("close is not null")
    value = recent(full.where("volume is not null")).where(F.col("pos") <= traded).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("traded_value"))
    dd = max_drawdown(recent(full).where(F.col("pos") <= peak), "close", ["symbol"])
    return full.groupBy("symbol").agg(F.count("*").alias("rows")).join(value, "symbol", "left").join(dd, "symbol", "left")


def fund_quota_returns(quotas: DataFrame, ids: list[str]) -> DataFrame:
    """Returns of chosen funds: digits-only ids, the last quota of a date by seq."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    import re

    own = quotas.withColumn("fund_id", digits("fund_id")).where(F.col("fund_id").isin(*[re.sub("[^0-9]", "", i) for i in ids]))
    daily = own.groupBy("fund_id", "date").agg(F.max_by("quota", "seq").alias("quota"))
    return daily.withColumn("fund_return", F.col("quota") / F.lag("quota").over(by("fund_id")) - 1)


def asof_price(keys: DataFrame, bars: DataFrame, tolerance_days: int = 10) -> DataFrame:
    """(symbol, date, price): the close of the date or of the nearest earlier one within the tolerance, else null.

    Wanted pairs are made distinct first and are scanned with the bars month by month of a symbol; the last close of a
    month is carried to the later ones.
    """
    want = keys.select("symbol", "date").distinct().withColumn("_k", F.lit(1))
    rows = bars.where("close is not null").select("symbol", "date", F.struct("date", "close").alias("_b"), F.lit(0).alias("_k"))
    both = rows.unionByName(want.withColumn("_b", F.lit(None).cast("struct<date:date,close:double>")))
    near = F.datediff("date", "_p.date") <= tolerance_days
    return running(both, ["symbol"], ["date", "_k"], {"_p": ("_b", "last")}).where("_k = 1").select("symbol", "date", F.when(near, F.col("_p.close")).alias("price"))


def align_series(*dfs: DataFrame) -> DataFrame:
    """(series, date, ret) from the latest of the series' first valid dates on; the first return becomes 0."""
    both = None
    for k, df in enumerate(dfs):
        one = df.where("ret is not null").select(F.lit(k).alias("series"), "date", "ret")
        both = one if both is None else both.unionByName(one)
    start = F.broadcast(both.groupBy("series").agg(F.min("date").alias("d")).agg(F.max("d").alias("_start")))  # one row
    return both.join(start, F.col("date") >= F.col("_start")).select("series", "date", F.when(F.col("date") == F.col("_start"), 0.0).otherwise(F.col("ret")).alias("ret"))
