"""Queries of the source and time-series operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantjobs.operators import timeseries as ts
from quantjobs.plans.fixtures import table
from quantjobs.sources import tables as io

R = 6


def decimal_rounds(sql):
    """SQL whose ``round(x, 4)`` and ``round(x, 6)`` round from a decimal of nine places."""
    for digits in (4, 6):
        at = 0
        while sql and (end := sql.find(f", {digits})", at)) >= 0:
            at, depth, start = end + 1, 1, end
            while start > 0 and depth:
                start -= 1
                depth += {")": 1, "(": -1}.get(sql[start], 0)
            if sql[max(0, start - 5) : start] == "round":
                x = sql[start + 1 : end]
                new = f"CAST(round(CAST({x} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"
                sql = sql[: start - 5] + new + sql[end + len(f", {digits})") :]
                at = start - 5 + len(new)
    return sql


def r6(df, *cols):
    """``df`` with the given columns rounded to six places."""
    return df.withColumns({c: F.round(c, R) for c in cols})


def _bars(s, d):
    return table(s, d, "bars")


def _weights(s, d):
    return table(s, d, "weights")


def io1(s, d):
    raw = table(s, d, "bars").withColumns({"date": F.when(F.day("date") == 13, F.lit("n/a")).otherwise(F.col("date").cast("string")), "volume": F.when(F.day("date") == 14, F.lit(float("nan"))).otherwise(F.col("volume"))})
    return io.clean_bars(raw).select("symbol", "date", "close", "volume")


def io2(s, d):
    raw = table(s, d, "part").join(table(s, d, "symbols").select("p_partkey", "symbol", "sector"), "p_partkey")
    raw = raw.select(F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), "symbol", F.lit(" ")).alias("symbol"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 10 == 0, "Error: none").otherwise(F.concat("sector", F.lit(" & co"))).alias("sector"), F.col("p_brand").alias("industry"))
    return io.clean_instruments(raw)


def _lines(s, d):
    json = F.to_json(F.struct("event_id", "user_id", "event_type"))
    return table(s, d, "events").select(F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).when(F.col("event_id") % 50 == 1, F.lit("  ")).otherwise(json).alias("value"))


def io3(s, d):
    rows, bad = io.parse_history(_lines(s, d), "event_id bigint, user_id bigint, event_type string")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).unionByName(bad.groupBy(F.lit("(bad)").alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("ids")))


def io4(s, d):
    b = _bars(s, d).select("symbol", "date", "close")
    return io.upsert_latest(b.where(F.day("date") <= 20), b.where(F.day("date") >= 10).withColumn("close", F.col("close") + 1), ["symbol", "date"])


def _skips(s, d):
    p = table(s, d, "symbols")
    return p.select("symbol", F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("ALL"))).otherwise(F.array(F.lit("1997-03-05"), F.lit("1997-03-06"))).alias("skip_data"))


SKIPS = "(SELECT symbol, max(p_partkey) % 4 = 0 AS every FROM symbols GROUP BY symbol)"


def io7(s, d):
    days = table(s, d, "bars").select("date").where(F.day("date") == 1).distinct()
    return io.missing_dates(table(s, d, "instruments"), _bars(s, d), _skips(s, d), days, "1997-01-01", "1997-06-30")


def io8(s, d):
    b = _bars(s, d)
    return io.append_evolving(b.where(F.year("date") < 1997).select("symbol", "date", "close"), b.where(F.year("date") >= 1997).select("symbol", "date", "volume")).select("symbol", "date", "close", "volume")


def io9(s, d):
    b = _bars(s, d)
    return io.reconcile(b.where(F.day("date") > 2), b.where(F.day("date") < 28), ["symbol", "date"])


def io10(s, d):
    out = io.daily_composition(_bars(s, d), _weights(s, d))
    kind = "map<string,struct<weight:double,value:double>>"
    return out.select("date", F.explode(F.from_json("composition", kind)).alias("symbol", "v")).select("date", "symbol", "v.weight", "v.value")


def ts14(s, d):
    e = table(s, d, "events")
    quotas = e.select(F.concat(F.lit("F-"), F.col("user_id") % 10, F.lit("/0")).alias("fund_id"), F.col("ts").cast("date").alias("date"), (10 + F.col("value") / 100).cast("double").alias("quota"), F.col("event_id").alias("seq"))
    return r6(ts.fund_quota_returns(quotas, ["F-1/0", "2.0", "30"]), "quota", "fund_return")


def ts15(s, d):
    keys = table(s, d, "trades").select("symbol", F.date_add("trade_date", 3).alias("date"))
    return ts.asof_price(keys, _bars(s, d))


def ts16(s, d):
    r = ts.daily_returns(_bars(s, d))
    pos = table(s, d, "ranked")
    one = [r.join(pos.where(f"pos = {k}"), "symbol", "left_semi") for k in (1, 60)]
    return r6(ts.align_series(*one), "ret")


ENDS = "SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pos FROM bars"
PAD = """pad AS (SELECT g.symbol, g.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
FROM (SELECT f.symbol, c.date FROM (SELECT symbol, min(date) AS first FROM bars GROUP BY symbol) f JOIN cal c ON c.date >= f.first) g
LEFT JOIN bars b ON b.symbol = g.symbol AND b.date = g.date)"""
VOL = "vols AS (SELECT symbol, date, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
MOM = "CAST(max(CASE WHEN b.idx = l.m THEN b.close END) / max(CASE WHEN b.idx = l.m - {n} THEN b.close END) - 1 AS DOUBLE)"
IDX = "(SELECT b.symbol, b.close, c.idx FROM bars b JOIN cal c ON b.date = c.date)"

QUERIES = {
    "io1_read_bars": (io1, "SELECT symbol, date, close, CASE WHEN day(date) <> 14 THEN volume END AS volume FROM bars WHERE day(date) <> 13"),
    "io2_read_instruments": (io2, """SELECT symbol, name, sector, industry, CAST(NULL AS VARCHAR) AS broker_name FROM (SELECT s.symbol, CASE WHEN p.p_partkey % 3 > 0 THEN p.p_name ELSE s.symbol END AS name,
        s.sector || ' and co' AS sector, p.p_brand AS industry, row_number() OVER (PARTITION BY s.symbol ORDER BY p.p_partkey) AS n FROM part p JOIN symbols s ON p.p_partkey = s.p_partkey WHERE p.p_partkey % 10 <> 0) WHERE n = 1"""),
    "io3_read_history": (io3, """SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 50 > 1 GROUP BY 1
        UNION ALL SELECT '(bad)', count(*), CAST(7 * count(*) AS BIGINT) FROM events WHERE event_id % 50 = 0"""),
    "io4_upsert_latest": (io4, "SELECT symbol, date, CASE WHEN day(date) >= 10 THEN close + 1 ELSE close END AS close FROM bars"),
    "io5_latest_per_key": (lambda s, d: io.latest_per_key(table(s, d, "snapshots"), ["symbol"], ["last_updated", "seq"]).select("symbol", "forward_pe", "target_mean_price", "last_updated"), "SELECT symbol, forward_pe, target_mean_price, last_updated FROM fundamentals"),
    "io5_latest_run": (lambda s, d: io.latest_run(table(s, d, "history"), "date").select("run_id", "date", "decision"), "SELECT run_id, date, decision FROM history WHERE date = (SELECT max(date) FROM history)"),
    "io6_drop_skipped": (lambda s, d: io.drop_skipped(_bars(s, d), _skips(s, d)).select("symbol", "date", "close"), f"SELECT symbol, date, close FROM bars WHERE symbol NOT IN (SELECT symbol FROM {SKIPS} WHERE every)"),
    "io7_missing_dates": (io7, f"""SELECT i.symbol, CAST(g.d AS DATE) AS date FROM instruments i JOIN {SKIPS} k ON i.symbol = k.symbol AND NOT k.every
        CROSS JOIN generate_series(DATE '1997-01-01', DATE '1997-06-30', INTERVAL 1 DAY) AS g(d) WHERE isodow(g.d) < 6 AND CAST(g.d AS DATE) NOT IN (DATE '1997-03-05', DATE '1997-03-06')
        AND CAST(g.d AS DATE) NOT IN (SELECT date FROM bars WHERE day(date) = 1) AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = i.symbol AND b.date = CAST(g.d AS DATE))"""),
    "io8_append_evolving": (io8, "SELECT symbol, date, CASE WHEN year(date) < 1997 THEN close END AS close, CASE WHEN year(date) >= 1997 THEN volume END AS volume FROM bars"),
    "io9_reconcile": (io9, """SELECT count_if(day(date) > 2) AS n_left, count_if(day(date) < 28) AS n_right, count_if(day(date) >= 28) AS missing_right, count_if(day(date) <= 2) AS missing_left,
        count_if(day(date) >= 28 OR day(date) <= 2) = 0 AS valid FROM bars"""),
    "io10_daily_composition": (io10, "SELECT b.date, b.symbol, w.weight, round(w.weight * b.close, 6) AS value FROM bars b JOIN weights w ON b.symbol = w.symbol"),
    "ts1_daily_returns": (lambda s, d: r6(ts.daily_returns(_bars(s, d)), "ret").select("symbol", "date", "ret"), "SELECT symbol, date, round(ret, 6) AS ret FROM ret"),
    "ts2_daily_returns_padded": (lambda s, d: r6(ts.daily_returns_padded(_bars(s, d)), "ret").select("symbol", "date", "ret"), f"WITH {PAD} SELECT symbol, date, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS ret FROM pad"),
    "ts3_momentum": (lambda s, d: r6(ts.momentum(_bars(s, d)), "momentum"), f"SELECT b.symbol, round({MOM.format(n=126)}, 6) AS momentum FROM {IDX} b CROSS JOIN (SELECT max(idx) AS m FROM cal) l GROUP BY b.symbol"),
    "ts3_momentum_blend": (lambda s, d: r6(ts.momentum_blend(_bars(s, d)), "momentum"), "SELECT symbol, round(avg(momentum), 6) AS momentum FROM (" + " UNION ALL ".join(f"SELECT b.symbol, {MOM.format(n=n)} AS momentum FROM {IDX} b CROSS JOIN (SELECT max(idx) AS m FROM cal) l GROUP BY b.symbol" for n in (63, 126, 252)) + ") GROUP BY symbol"),
    "ts4_portfolio_momentum": (lambda s, d: r6(ts.portfolio_momentum(_bars(s, d), _weights(s, d)), "momentum"), f"""WITH e AS ({ENDS}), g AS (SELECT symbol, max(CASE WHEN pos = 1 THEN close END) AS b, max(CASE WHEN pos = 252 THEN close END) AS a FROM e GROUP BY symbol)
        SELECT round(sum(w.weight * (g.b / g.a - 1)) / sum(w.weight), 6) AS momentum FROM g JOIN weights w ON g.symbol = w.symbol WHERE g.a > 0"""),
    "ts5_latest_price": (lambda s, d: ts.latest_price(_bars(s, d)).join(ts.latest_price(_bars(s, d), "last_date").withColumnRenamed("price", "on_last_date"), "symbol"), "SELECT symbol, arg_max(close, date) AS price, max(CASE WHEN date = (SELECT max(date) FROM bars) THEN close END) AS on_last_date FROM bars GROUP BY symbol"),
    "ts6_calendar_return": (lambda s, d: r6(ts.calendar_return(_bars(s, d)), "ret"), """WITH m AS (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol), g AS (SELECT b.symbol, arg_max(close, date) AS b, arg_max(close, date) FILTER (WHERE date <= last - 365) AS a, arg_min(close, date) AS o FROM bars b JOIN m ON b.symbol = m.symbol GROUP BY b.symbol)
        SELECT symbol, round(b / coalesce(a, o) - 1, 6) AS ret FROM g"""),
    "ts7_risk_return": (lambda s, d: r6(ts.risk_return(ts.daily_returns(_bars(s, d))), "annual_mean", "annual_std", "sharpe"), "SELECT symbol, round(avg(ret) * 252, 6) AS annual_mean, round(stddev_samp(ret) * sqrt(252), 6) AS annual_std, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) ELSE 0 END, 6) AS sharpe FROM ret GROUP BY symbol"),
    "ts8_growth_index": (lambda s, d: r6(ts.growth_index(ts.daily_returns(_bars(s, d)), keys=["symbol"]), "index").select("symbol", "date", "index"), "SELECT symbol, date, round(100 * product(1 + coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS index FROM ret"),
    "ts9_drawdown": (lambda s, d: r6(ts.drawdown(_bars(s, d), "close", ["symbol"]), "drawdown").select("symbol", "date", "drawdown"), "SELECT symbol, date, round(1 - close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS drawdown FROM bars"),
    "ts9_max_drawdown": (lambda s, d: r6(ts.max_drawdown(ts.growth_index(ts.daily_returns(_bars(s, d)).where("ret is not null"), 1.0, ["symbol"]), "index", ["symbol"]), "max_drawdown"), """WITH i AS (SELECT symbol, date, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM ret WHERE ret IS NOT NULL),
        p AS (SELECT symbol, 1 - v / max(v) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS dd FROM i) SELECT symbol, round(max(dd), 6) AS max_drawdown FROM p GROUP BY symbol"""),
    "ts10_rolling_vol": (lambda s, d: r6(ts.rolling_vol(ts.daily_returns(_bars(s, d)).where("ret is not null")), "vol").select("symbol", "date", "vol"), f"WITH {VOL.replace('FROM ret ', 'FROM ret WHERE ret IS NOT NULL ')} SELECT symbol, date, round(vol, 6) AS vol FROM vols"),
    "ts10_vol_percentile": (lambda s, d: _percentiles(s, d), f"""WITH {VOL.replace('FROM ret ', 'FROM ret WHERE ret IS NOT NULL ')}, n AS (SELECT symbol, arg_max(vol, date) AS now, count(*) AS a, count(vol) AS b FROM vols GROUP BY symbol)
        SELECT v.symbol, round(count_if(v.vol < n.now) / any_value(n.a), 6) AS with_nulls, round(count_if(v.vol < n.now) / any_value(n.b), 6) AS without_nulls FROM vols v JOIN n ON v.symbol = n.symbol WHERE n.now IS NOT NULL GROUP BY v.symbol"""),
    "ts11_forward_fill": (lambda s, d: ts.forward_fill(_bars(s, d).withColumn("close", F.when(F.day("date") % 3 > 0, F.col("close"))), ["symbol"], "date", "close").select("symbol", "date", "close"), "SELECT symbol, date, last_value(CASE WHEN day(date) % 3 > 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM bars"),
    "ts12_window_return": (lambda s, d: r6(ts.window_return(_bars(s, d), 126), "ret"), f"WITH e AS ({ENDS}) SELECT symbol, round(arg_min(close, pos) / arg_max(close, pos) - 1, 6) AS ret FROM e WHERE pos <= 127 GROUP BY symbol HAVING count(*) >= 56"),
    "ts12_window_drawdown": (lambda s, d: r6(ts.window_drawdown(_bars(s, d), 126), "drawdown"), f"WITH e AS ({ENDS}) SELECT symbol, round(arg_min(close, pos) / max(close) - 1, 6) AS drawdown FROM e WHERE pos <= 126 GROUP BY symbol HAVING count(*) >= 56"),
    "ts13_history_metrics": (lambda s, d: r6(ts.history_metrics(_bars(s, d)), "traded_value", "max_drawdown"), """WITH e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pos FROM bars),
        p AS (SELECT symbol, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS dd FROM e WHERE pos <= 126)
        SELECT e.symbol, count(*) AS rows, round(avg(CASE WHEN pos <= 21 THEN close * volume END), 6) AS traded_value, round(any_value(q.m), 6) AS max_drawdown FROM e JOIN (SELECT symbol, max(dd) AS m FROM p GROUP BY symbol) q ON e.symbol = q.symbol GROUP BY e.symbol"""),
    "ts14_fund_quota_returns": (ts14, """WITH q AS (SELECT CAST(user_id % 10 AS VARCHAR) || '0' AS fund_id, CAST(ts AS DATE) AS date, arg_max(CAST(10 + value / 100 AS DOUBLE), event_id) AS quota FROM events WHERE user_id % 10 IN (1, 2, 3) GROUP BY 1, 2)
        SELECT fund_id, date, round(quota, 6) AS quota, round(quota / lag(quota) OVER (PARTITION BY fund_id ORDER BY date) - 1, 6) AS fund_return FROM q"""),
    "ts15_asof_price": (ts15, """WITH k AS (SELECT DISTINCT symbol, trade_date + 3 AS date FROM trades)
        SELECT k.symbol, k.date, CASE WHEN k.date - b.date <= 10 THEN b.close END AS price FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.date >= b.date"""),
    "ts16_align_series": (ts16, """WITH x AS (SELECT CASE WHEN k.pos = 1 THEN 0 ELSE 1 END AS series, r.date, r.ret FROM ret r JOIN ranked k ON r.symbol = k.symbol AND k.pos IN (1, 60) WHERE r.ret IS NOT NULL),
        m AS (SELECT max(d) AS start FROM (SELECT series, min(date) AS d FROM x GROUP BY series)) SELECT CAST(series AS INTEGER) AS series, date, round(CASE WHEN date = start THEN 0 ELSE ret END, 6) AS ret FROM x, m WHERE date >= start"""),
}


def _percentiles(s, d):
    v = ts.rolling_vol(ts.daily_returns(_bars(s, d)).where("ret is not null"))
    a = ts.vol_percentile(v).select("symbol", F.round("percentile", R).alias("with_nulls"))
    return a.join(ts.vol_percentile(v, False).select("symbol", F.round("percentile", R).alias("without_nulls")), "symbol")
