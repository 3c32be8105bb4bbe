"""Queries of the search and performance operators, each with its SQL (None where draws are random)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantjobs.operators import performance as pf
from quantjobs.operators import search as ps
from quantjobs.operators import timeseries as ts
from quantjobs.plans.fixtures import table
from quantjobs.plans.market import r6
from quantjobs.plans.scoring import PADRET


def _pool(s, d):
    """The 50 symbols of the best composite score."""
    return table(s, d, "best").select("symbol", "sector")


def _stats(s, d):
    bars, pool = table(s, d, "bars"), _pool(s, d)
    return ps.panel_stats(ts.padded(bars.join(pool.select("symbol"), "symbol", "left_semi"), bars), pool)


def _traded(s, d):
    """The ten symbols traded most often, which hold the two portfolios of PS3."""
    return table(s, d, "ranked").where("pos <= 10").join(table(s, d, "instruments"), "symbol").select("symbol", "sector")


def _two(s, d):
    w, i = table(s, d, "weights"), table(s, d, "ideal")
    return w.select(F.lit("p1").alias("portfolio_id"), "symbol", "weight").unionByName(i.select(F.lit("p2").alias("portfolio_id"), "symbol", "weight"))


def ps1(s, d):
    mean, cov = _stats(s, d)
    return r6(cov.join(mean.withColumnRenamed("symbol", "a"), "a"), "cov", "mean")


def ps2(s, d):
    return ps.combinations(_pool(s, d), 3, 2).select(F.array_join("combo", ",").alias("combo"))


def ps3(s, d):
    bars, pool = table(s, d, "bars"), _traded(s, d)
    mean, cov = ps.panel_stats(ts.padded(bars.join(pool.select("symbol"), "symbol", "left_semi"), bars), pool)
    return r6(ps.portfolio_metrics(_two(s, d), mean, cov, table(s, d, "instruments"), 0.01, 0.3, 0.5), "ret", "vol", "hhi", "sector_hhi", "sharpe").select("portfolio_id", "ret", "vol", "hhi", "sector_hhi", "sharpe")


def _searched(s, d):
    mean, cov = _stats(s, d)
    pool = _pool(s, d)
    return ps.random_weight_search(ps.combinations(pool, 3, 2), mean, cov, pool), mean, cov, pool


def ps4(s, d):
    return _searched(s, d)[0]


def ps5(s, d):
    found, mean, cov, pool = _searched(s, d)
    return ps.refine(found, mean, cov, pool)


def ps6(s, d):
    mean, cov = _stats(s, d)
    islands = s.range(16).select((F.col("id") + 5).cast("int").alias("k")).crossJoin(s.range(2).select(F.col("id").cast("int").alias("seed")))
    return ps.evolutionary_search(islands, mean, cov, _pool(s, d))


def ps8(s, d):
    f = table(s, d, "fundamentals").withColumn("current_price", F.when(F.col("dividend_yield") > 3, F.col("forward_eps")))
    scored = table(s, d, "upsides").where("source = 'YahooFinance'")
    return r6(ps.holdings_meta(table(s, d, "hold_w").select("portfolio_id", "symbol", "weight"), scored, f, table(s, d, "last_price")), "price", "target").select("portfolio_id", "symbol", "sector", "price", "target")


def _runs(s, d):
    return table(s, d, "hold_w").select(F.col("portfolio_id").cast("bigint").alias("run_id"), "symbol", "weight")


def ps9(s, d):
    w = _runs(s, d)
    m = w.groupBy("run_id").agg(F.count("*").cast("double").alias("n"), F.max("weight").alias("top"))
    m = m.select(F.explode(F.array(F.struct(F.lit("n").alias("metric"), F.col("n").alias("value")), F.struct(F.lit("top").alias("metric"), F.col("top").alias("value")))).alias("e")).select("e.*")
    metrics, symbols = ps.run_stability(w, m)
    return r6(metrics.select(F.col("metric").alias("name"), F.col("n").cast("double").alias("size"), "mean", "std", "cv").unionByName(symbols.select(F.col("symbol").alias("name"), F.col("frequency").alias("size"), "mean", "std", "cv")), "size", "mean", "std", "cv")


def ps10(s, d):
    out = ps.project_allocation(table(s, d, "weights").withColumn("capital", F.lit(10_000.0)), "capital", table(s, d, "last_price"), table(s, d, "upsides"))
    return r6(out, "allocation", "invested", "target_value").select("symbol", "allocation", "shares", "invested", "target_value")


def pf2(s, d):
    out = pf.sector_attribution(ts.daily_returns(table(s, d, "bars")), table(s, d, "weights"), table(s, d, "instruments"), table(s, d, "bench_ret"))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


def pf6(s, d):
    b = table(s, d, "bars")
    values = b.select("symbol", "date", (F.col("close") * 100).alias("value"))
    flows = b.where(F.day("date") % 7 == 0).select("symbol", "date", F.col("volume").alias("flow"))
    return r6(pf.twr(values, flows, ["symbol"]), "ret")


def _daily(s, d):
    b = table(s, d, "bench_ret").withColumnRenamed("ret", "bench")
    return ts.daily_returns(table(s, d, "bars")).select("symbol", "date", "ret").join(F.broadcast(b), "date").withColumn("rf", F.lit(0.0004))


def pf7(s, d):
    return r6(pf.window_performance(_daily(s, d), ["symbol"], ["ret", "bench", "rf"], "rf"), "ret", "bench", "rf").withColumn("pct_of_rf", F.round("pct_of_rf", 4))


def pf8(s, d):
    h = table(s, d, "trades").select("symbol", F.col("trade_date").alias("date"), F.col("gross_value").cast("double").alias("value"))
    return r6(pf.window_risk(_daily(s, d), h, ["symbol"]), "te", "hhi").withColumn("ir", F.round("ir", 3))


def pf10(s, d):
    symbol = table(s, d, "ranked").where("pos = 1").first()["symbol"]
    b = table(s, d, "bars")
    return r6(pf.risk_free_returns(b, symbol, b), "rf")


PANEL = PADRET.split(",\npr AS")[0] + """, pool AS (SELECT k.symbol, i.sector FROM ranked k JOIN instruments i ON k.symbol = i.symbol WHERE k.pos <= 10),
own AS (SELECT p.* FROM pad p JOIN pool o ON p.symbol = o.symbol), ful AS (SELECT date FROM own GROUP BY date HAVING count(*) = 10),
pp AS (SELECT * FROM (SELECT symbol, own.date, close / lag(close) OVER (PARTITION BY symbol ORDER BY own.date) - 1 AS ret FROM own JOIN ful ON own.date = ful.date) WHERE ret IS NOT NULL),
mean AS (SELECT symbol, avg(ret) * 252 AS mean FROM pp GROUP BY symbol), cov AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM pp a JOIN pp b ON a.date = b.date GROUP BY 1, 2)"""
BEST = PANEL.replace("SELECT k.symbol, i.sector FROM ranked k JOIN instruments i ON k.symbol = i.symbol WHERE k.pos <= 10", "SELECT symbol, sector FROM best").replace("count(*) = 10", "count(*) = (SELECT count(*) FROM pool)")
TWO = "two AS (SELECT 'p1' AS portfolio_id, symbol, weight FROM weights UNION ALL SELECT 'p2', symbol, weight FROM ideal)"
AN = "CASE WHEN {t} > -1 THEN pow(1 + {t}, 252.0 / {n}) - 1 ELSE -1 END"
DAILY = "dl AS (SELECT r.symbol, r.date, r.ret, b.ret AS bench, CAST(0.0004 AS DOUBLE) AS rf FROM ret r JOIN bench_ret b ON r.date = b.date)"
WIN = """en AS (SELECT symbol, max(date) AS e FROM dl GROUP BY symbol), wn AS (SELECT symbol, 'YTD' AS w, CAST(date_trunc('year', e) AS DATE) AS st FROM en
UNION ALL SELECT symbol, CAST(m AS VARCHAR) || 'M', CAST(e - to_months(CAST(m AS INTEGER)) AS DATE) FROM en, (VALUES (3), (6), (12), (24)) AS v(m))"""

QUERIES = {
    "ps1_panel_stats": (ps1, f"WITH {BEST} SELECT c.a, c.b, round(cov, 6) AS cov, round(mean, 6) AS mean FROM cov c JOIN mean m ON c.a = m.symbol"),
    "ps2_combinations": (ps2, """WITH p AS (SELECT symbol, sector FROM best)
        SELECT a.symbol || ',' || b.symbol || ',' || c.symbol AS combo FROM p a JOIN p b ON a.symbol < b.symbol JOIN p c ON b.symbol < c.symbol WHERE NOT (a.sector = b.sector AND b.sector = c.sector)"""),
    "ps3_portfolio_metrics": (ps3, f"""WITH {PANEL}, {TWO}, r AS (SELECT portfolio_id, sum(weight * mean) AS ret FROM two JOIN mean ON two.symbol = mean.symbol GROUP BY 1),
        v AS (SELECT a.portfolio_id, sqrt(sum(a.weight * b.weight * cov)) AS vol FROM two a JOIN two b ON a.portfolio_id = b.portfolio_id JOIN cov ON cov.a = a.symbol AND cov.b = b.symbol GROUP BY 1),
        s AS (SELECT portfolio_id, sector, sum(weight) AS w, sum(weight * weight) AS h FROM two JOIN instruments i ON two.symbol = i.symbol GROUP BY 1, 2), h AS (SELECT portfolio_id, sum(h) AS hhi, sum(w * w) AS sector_hhi FROM s GROUP BY 1)
        SELECT r.portfolio_id, round(ret, 6) AS ret, round(vol, 6) AS vol, round(hhi, 6) AS hhi, round(sector_hhi, 6) AS sector_hhi, round(CASE WHEN ret > 0.01 THEN (ret - 0.01) / vol / pow(0.5 * hhi + 0.5 * sector_hhi, 0.3) ELSE (ret - 0.01) / vol * pow(0.5 * hhi + 0.5 * sector_hhi, 0.3) END, 6) AS sharpe
        FROM r JOIN v ON r.portfolio_id = v.portfolio_id JOIN h ON r.portfolio_id = h.portfolio_id"""),
    "ps4_random_weight_search": (ps4, None),
    "ps5_refine": (ps5, None),
    "ps6_evolutionary_search": (ps6, None),
    "ps7_composition": (lambda s, d: r6(ps.composition(table(s, d, "hold_w").select("portfolio_id", "symbol", "weight"), table(s, d, "facts")), "hhi", "top3", "top5", "max_weight", "forward_pe", "momentum", "dividend_yield", "liquidity"), """WITH x AS (SELECT h.portfolio_id, h.weight, f.*, row_number() OVER (PARTITION BY h.portfolio_id ORDER BY weight DESC, h.symbol) AS p FROM hold_w h LEFT JOIN facts f ON h.symbol = f.symbol)
        SELECT portfolio_id, round(sum(weight * weight), 6) AS hhi, round(sum(CASE WHEN p <= 3 THEN weight END), 6) AS top3, round(sum(CASE WHEN p <= 5 THEN weight END), 6) AS top5, round(max(weight), 6) AS max_weight, count(*) AS n,
        round(sum(CASE WHEN forward_pe > 0 THEN weight * forward_pe END) / sum(CASE WHEN forward_pe > 0 THEN weight END), 6) AS forward_pe, round(sum(CASE WHEN momentum IS NOT NULL THEN weight * momentum END) / sum(CASE WHEN momentum IS NOT NULL THEN weight END), 6) AS momentum,
        round(sum(weight * dividend_yield) / sum(CASE WHEN dividend_yield IS NOT NULL THEN weight END), 6) AS dividend_yield, round(sum(weight * average_volume) / sum(CASE WHEN average_volume IS NOT NULL THEN weight END), 6) AS liquidity FROM x GROUP BY portfolio_id"""),
    "ps7_sector_exposure": (lambda s, d: ps.sector_exposure(table(s, d, "hold_w"), table(s, d, "instruments")).withColumn("weight", F.round("weight", 5)), "SELECT portfolio_id, sector, round(sum(weight), 5) AS weight, count(*) AS n FROM hold_w h JOIN instruments i ON h.symbol = i.symbol GROUP BY 1, 2"),
    "ps8_holdings_meta": (ps8, """SELECT h.portfolio_id, h.symbol, u.sector, round(coalesce(u.price, CASE WHEN f.dividend_yield > 3 THEN f.forward_eps END, p.price), 6) AS price,
        round(coalesce(u.target_price, f.target_mean_price, CASE WHEN f.forward_eps > 0 AND u.sector_pe > 0 THEN f.forward_eps * u.sector_pe END), 6) AS target FROM hold_w h LEFT JOIN (SELECT * FROM upsides WHERE source = 'YahooFinance') u ON h.symbol = u.symbol
        LEFT JOIN fundamentals f ON h.symbol = f.symbol LEFT JOIN last_price p ON h.symbol = p.symbol"""),
    "ps9_run_stability": (ps9, """WITH m AS (SELECT portfolio_id, CAST(count(*) AS DOUBLE) AS n, max(weight) AS t FROM hold_w GROUP BY 1), v AS (SELECT 'n' AS name, n AS v FROM m UNION ALL SELECT 'top', t FROM m),
        a AS (SELECT name, CAST(count(*) AS DOUBLE) AS size, avg(v) AS mean, stddev_samp(v) AS std FROM v GROUP BY 1 UNION ALL SELECT symbol, count(DISTINCT portfolio_id) / (SELECT count(*) FROM m), avg(weight), stddev_pop(weight) FROM hold_w WHERE weight > 0 GROUP BY 1)
        SELECT name, round(size, 6) AS size, round(mean, 6) AS mean, round(std, 6) AS std, round(std / mean, 6) AS cv FROM a"""),
    "ps10_project_allocation": (ps10, """SELECT w.symbol, round(weight * 10000, 6) AS allocation, CAST(greatest(1, floor(weight * 10000 / p.price)) AS BIGINT) AS shares, round(greatest(1, floor(weight * 10000 / p.price)) * p.price, 6) AS invested,
        round(greatest(1, floor(weight * 10000 / p.price)) * coalesce(u.target_price, p.price), 6) AS target_value FROM weights w JOIN last_price p ON w.symbol = p.symbol LEFT JOIN upsides u ON w.symbol = u.symbol"""),
    "pf1_portfolio_series": (lambda s, d: r6(pf.portfolio_series(table(s, d, "bars"), table(s, d, "weights")), "ret", "value"), """WITH x AS (SELECT r.date, sum(w.weight * coalesce(r.ret, 0)) AS ret FROM ret r JOIN weights w ON r.symbol = w.symbol GROUP BY r.date)
        SELECT date, round(ret, 6) AS ret, round(1000 * product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS value FROM x"""),
    "pf2_sector_attribution": (pf2, """WITH r AS (SELECT t.*, i.sector FROM ret t JOIN instruments i ON t.symbol = i.symbol WHERE t.date >= (SELECT max(date) - INTERVAL 12 MONTH FROM bars)), n AS (SELECT count(DISTINCT date) AS n FROM r),
        o AS (SELECT w.symbol, w.weight, i.sector FROM weights w JOIN instruments i ON w.symbol = i.symbol), wp AS (SELECT sector, sum(weight) AS wp FROM o GROUP BY 1), s AS (SELECT r.sector, sum(o.weight * coalesce(r.ret, 0)) AS s FROM r JOIN o ON r.symbol = o.symbol GROUP BY 1),
        p AS (SELECT wp.sector, wp, coalesce(s, 0) / wp / n * 252 AS rp FROM wp LEFT JOIN s ON wp.sector = s.sector, n), wb AS (SELECT sector, count(*) / (SELECT count(*) FROM instruments) AS wb FROM instruments GROUP BY 1),
        rb AS (SELECT sector, avg(m) * 252 AS rb FROM (SELECT sector, date, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
        t AS (SELECT (SELECT avg(x) * 252 FROM (SELECT sum(o.weight * coalesce(r.ret, 0)) AS x FROM r JOIN o ON r.symbol = o.symbol GROUP BY r.date)) AS pt, (SELECT avg(ret) * 252 FROM bench_ret WHERE date >= (SELECT max(date) - INTERVAL 12 MONTH FROM bars)) AS bt),
        z AS (SELECT coalesce(wp, 0) AS wp, coalesce(rp, 0) AS rp, coalesce(wb, 0) AS wb, coalesce(rb, 0) AS rb FROM wb LEFT JOIN p ON wb.sector = p.sector LEFT JOIN rb ON wb.sector = rb.sector),
        e AS (SELECT sum((wp - wb) * (rb - bt)) * 100 AS al, sum(wb * (rp - rb)) * 100 AS se, sum((wp - wb) * (rp - rb)) * 100 AS it, (any_value(pt) - any_value(bt)) * 100 AS ac FROM z, t)
        SELECT round(al, 4) AS allocation, round(se, 4) AS selection, round(it, 4) AS interaction, round(ac, 4) AS active, round(CASE WHEN abs(ac - al - se - it) > 0.01 THEN ac - al - se - it ELSE 0 END, 4) AS residual FROM e"""),
    "pf3_asset_attribution": (lambda s, d: r6(pf.asset_attribution(ts.daily_returns(table(s, d, "bars")), table(s, d, "weights")), "contribution", "volatility", "realised"), """SELECT r.symbol, w.weight, round(sum(ret * w.weight), 6) AS contribution, round(coalesce(stddev_samp(ret) * sqrt(252), 0), 6) AS volatility, round(product(1 + ret) - 1, 6) AS realised, count(*) AS n
        FROM ret r JOIN weights w ON r.symbol = w.symbol WHERE ret IS NOT NULL GROUP BY 1, 2"""),
    "pf4_relative_risk": (lambda s, d: _rel(s, d), f"""WITH x AS (SELECT r.symbol, r.ret, b.ret AS b FROM ret r JOIN bench_ret b ON r.date = b.date WHERE r.ret IS NOT NULL),
        g AS (SELECT symbol, count(*) AS n, stddev_samp(ret - b) * sqrt(252) AS te, avg(ret - b) * 252 AS ex, covar_samp(ret, b) AS c, var_samp(b) AS v, CASE WHEN count(*) > 1 THEN corr(ret, b) END AS correlation, product(1 + ret) - 1 AS p, product(1 + b) - 1 AS q FROM x GROUP BY 1),
        h AS (SELECT *, {AN.format(t='p', n='n')} - ({AN.format(t='q', n='n')}) AS al FROM g)
        SELECT symbol, n, round(te, 6) AS te, round(CASE WHEN te > 0 THEN ex / te END, 6) AS ir_mean, round(CASE WHEN te > 0 THEN al / te END, 4) AS ir_geometric, round(CASE WHEN v > 0 THEN c / v END, 6) AS beta, round(correlation, 6) AS correlation, round(p - q, 6) AS alpha_total, round(al, 4) AS alpha_annual FROM h WHERE n > 2"""),
    "pf5_absolute_risk": (lambda s, d: _abs(s, d), f"""WITH r AS (SELECT symbol, date, ret FROM ret WHERE ret IS NOT NULL), i AS (SELECT symbol, date, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM r),
        dd AS (SELECT symbol, max(d) AS d FROM (SELECT symbol, 1 - v / max(v) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS d FROM i) GROUP BY 1),
        g AS (SELECT symbol, count(*) AS n, product(1 + ret) - 1 AS t, stddev_samp(ret) * sqrt(252) AS vol, stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS dn FROM r GROUP BY 1), h AS (SELECT *, {AN.format(t='t', n='n')} AS an FROM g)
        SELECT h.symbol, n, round(t, 6) AS total, round(an, 3) AS annual, round(vol, 6) AS volatility, round(CASE WHEN vol > 0 THEN (an - 0.1175) / vol END, 3) AS sharpe, round(CASE WHEN dn > 0 THEN (an - 0.1175) / dn END, 3) AS sortino, round(dd.d, 6) AS max_drawdown,
        round(CASE WHEN dd.d > 0 THEN an / dd.d END, 3) AS calmar, round(t / (pow(1.1175, n / 252.0) - 1) * 100, 3) AS pct_of_rf, n >= 252 AS annual_safe FROM h JOIN dd ON h.symbol = dd.symbol WHERE n > 9"""),
    "pf6_twr": (pf6, "SELECT symbol, date, round((close * 100 - CASE WHEN day(date) % 7 = 0 THEN volume ELSE 0 END) / prev - 1, 6) AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) * 100 AS prev FROM bars) WHERE prev > 0"),
    "pf7_window_performance": (pf7, f"""WITH {DAILY}, {WIN} SELECT d.symbol, w AS window, count(*) AS days, round(product(1 + coalesce(d.ret, 0)) - 1, 6) AS ret, round(product(1 + d.bench) - 1, 6) AS bench, round(product(1 + rf) - 1, 6) AS rf,
        round((product(1 + coalesce(d.ret, 0)) - 1) / (product(1 + rf) - 1) * 100, 4) AS pct_of_rf FROM dl d JOIN wn ON d.symbol = wn.symbol AND d.date >= wn.st GROUP BY 1, 2"""),
    "pf8_window_risk": (pf8, f"""WITH {DAILY}, {WIN}, g AS (SELECT d.symbol, w, count(*) AS n, stddev_samp(d.ret - d.bench) * sqrt(252) AS te, product(1 + d.ret) - 1 AS p, product(1 + d.bench) - 1 AS q FROM dl d JOIN wn ON d.symbol = wn.symbol AND d.date >= wn.st WHERE d.ret IS NOT NULL GROUP BY 1, 2),
        h AS (SELECT symbol, sum(v) AS v, sum(v * v) AS q, count(*) AS k FROM (SELECT symbol, CAST(gross_value AS DOUBLE) AS v FROM trades t WHERE trade_date = (SELECT max(trade_date) FROM trades u WHERE u.symbol = t.symbol)) GROUP BY 1)
        SELECT g.symbol, w AS window, n AS days, round(te, 6) AS te, round(CASE WHEN te > 0 THEN ({AN.format(t='p', n='n')} - ({AN.format(t='g.q', n='n')})) / te END, 3) AS ir, round(h.q / (h.v * h.v), 6) AS hhi, h.k AS assets FROM g LEFT JOIN h ON g.symbol = h.symbol"""),
    "pf9_portfolio_diagnostics": (lambda s, d: r6(pf.portfolio_diagnostics(_runs(s, d), table(s, d, "fundamentals")), "turnover", "pe_upside", "dividend_yield").withColumn("liquidity", F.round("liquidity", 2)), """WITH w AS (SELECT CAST(portfolio_id AS BIGINT) AS run_id, symbol, weight FROM hold_w), b AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS prev FROM (SELECT DISTINCT run_id FROM w)),
        g AS (SELECT w.run_id, any_value(b.prev) AS prev, sum(abs(w.weight - coalesce(o.weight, 0))) / 2 AS t, avg(f.average_volume / w.weight) AS l, sum(f.forward_pe * w.weight) AS pe, sum(f.dividend_yield * w.weight) AS y FROM w JOIN b ON w.run_id = b.run_id LEFT JOIN w o ON o.run_id = b.prev AND o.symbol = w.symbol JOIN fundamentals f ON w.symbol = f.symbol GROUP BY 1)
        SELECT run_id, round(CASE WHEN prev IS NULL THEN 0 ELSE t END, 6) AS turnover, round(l, 2) AS liquidity, round(((SELECT avg(forward_pe) FROM fundamentals) - pe) / pe, 6) AS pe_upside, round(y, 6) AS dividend_yield FROM g"""),
    "pf10_risk_free_returns": (pf10, """WITH p AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bars WHERE symbol = (SELECT symbol FROM ranked WHERE pos = 1))
        SELECT c.date, round(coalesce(p.r, pow(1.1175, CAST(1 AS DOUBLE) / 252) - 1), 6) AS rf FROM cal c LEFT JOIN p ON c.date = p.date"""),
}


def _rel(s, d):
    out = pf.relative_risk(ts.daily_returns(table(s, d, "bars")), table(s, d, "bench_ret"), ["symbol"]).where("n > 2")
    return r6(out, "te", "ir_mean", "beta", "correlation", "alpha_total").withColumns({c: F.round(c, 4) for c in ("ir_geometric", "alpha_annual")})


def _abs(s, d):
    out = pf.absolute_risk(ts.daily_returns(table(s, d, "bars")), ["symbol"]).where("n > 9")
    return r6(out, "total", "volatility", "max_drawdown").withColumns({c: F.round(c, 3) for c in ("annual", "sharpe", "sortino", "calmar", "pct_of_rf")})
