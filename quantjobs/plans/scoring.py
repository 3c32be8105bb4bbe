"""Queries of the scoring operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantjobs.operators import scoring as sc
from quantjobs.operators import timeseries as ts
from quantjobs.plans.fixtures import table
from quantjobs.plans.market import r6

AS_OF = "2001-11-01"
PARAMS = sc.QualityParams(base_pct=4.0, penalty_pct=5.0)


def _upsides(s, d):
    return sc.upside(table(s, d, "facts"))


def _normed(s, d):
    return sc.minmax(_upsides(s, d), "sharpe", "upside", "momentum")


def _quality(s, d):
    u = _upsides(s, d)
    return sc.target_quality(u, sc.class_mismatch(u, 0.15, 1.05), AS_OF, PARAMS)


def sc5(s, d):
    n = _normed(s, d)
    return r6(sc.composite_score(n, sc.factor_weights(n)), "score", "sharpe_weight").select("symbol", "rank", "score", "sharpe_weight")


def sc9(s, d):
    return _quality(s, d).select("symbol", "quality_score", "quality_bucket", F.array_join("quality_flags", ";").alias("quality_flags"), "raw_upside_pct")


def sc11(s, d):
    held = table(s, d, "ranked").where("pos % 3 = 0")
    return r6(sc.eligible(_upsides(s, d), held), "upside", "target_price").select("symbol", "source", "upside", "target_price")


def sc12(s, d):
    return r6(sc.top_n(table(s, d, "composite"), 5, ["sector"]), "score").select("sector", "rank", "symbol", "score")


def _hist_padded(s, d):
    return ts.risk_return(ts.daily_returns_padded(table(s, d, "bars")))


def sc13(s, d):
    hist = _hist_padded(s, d).select("symbol", "annual_mean")
    return r6(sc.blended_returns(hist, _upsides(s, d).where("source <> 'None'").select("symbol", "upside"), 0.35), "expected").select("symbol", "expected")


def sc15(s, d):
    w = lambda c: table(s, d, "ranked").where(c)
    out = sc.correlation_groups(table(s, d, "bars"), w("pos <= 4"), w("pos between 4 and 7"))
    return out.select("a", "b", F.round("corr", 4).alias("corr"), "n", "group_a", "group_b", "place_a", "place_b")


def _held(s, d):
    return table(s, d, "hold_w").select("symbol").distinct()


def sc14(s, d):
    return r6(sc.correlation_pairs(ts.daily_returns(table(s, d, "bars")), _held(s, d)).where("n >= 3"), "corr")


def sc16(s, d):
    pairs = sc.correlation_pairs(ts.daily_returns_padded(table(s, d, "bars")), _held(s, d))
    return r6(sc.avg_internal_corr(pairs, table(s, d, "hold_w"), ["portfolio_id"]), "avg_corr")


PADRET = """pad AS (SELECT g.symbol, g.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
FROM (SELECT f.symbol, c.date FROM (SELECT symbol, min(date) AS first FROM bars GROUP BY symbol) f JOIN cal c ON c.date >= f.first) g LEFT JOIN bars b ON b.symbol = g.symbol AND b.date = g.date),
pr AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM pad)"""
MISMATCH = """mm AS (SELECT a.symbol, min(b.symbol) AS related FROM upsides a JOIN upsides b ON regexp_replace(replace(a.symbol, '.SA', ''), '[0-9]+$', '') = regexp_replace(replace(b.symbol, '.SA', ''), '[0-9]+$', '') AND a.symbol <> b.symbol
WHERE a.target_price > 0 AND b.target_price > 0 AND abs(a.target_price - b.target_price) / greatest(a.target_price, b.target_price) <= 0.15 AND greatest(a.price, b.price) / least(a.price, b.price) >= 1.05 GROUP BY a.symbol)"""
QUALITY = MISMATCH + f""",
q0 AS (SELECT u.*, mm.related, coalesce(u.target_price <= 0, true) AS no_t, CASE WHEN u.target_price > 0 AND u.price > 0 THEN CAST((u.target_price / u.price - 1) * 100 AS DOUBLE) END AS raw FROM upsides u LEFT JOIN mm ON u.symbol = mm.symbol),
q1 AS (SELECT *, coalesce(raw >= 150, false) AS ext, coalesce(raw >= 300, false) AS rej, source = 'SectorPE_Fallback' AS fb, related IS NOT NULL AS rel, coalesce(forward_pe <= 0, false) AS badpe,
  coalesce(average_volume < 100000, false) AS thin, coalesce(DATE '{AS_OF}' - last_updated > 45, false) AS stale, coalesce(annual_mean * 100 <= -50, false) AS dist, coalesce(price < 1, false) AS cheap FROM q0),
q2 AS (SELECT *, CASE WHEN no_t THEN CAST(0 AS DOUBLE) ELSE 1 END AS a FROM q1),
q3 AS (SELECT *, CASE WHEN fb THEN least(a, CAST(0.35 AS DOUBLE)) ELSE a END - CASE WHEN ext THEN 0.25 ELSE 0 END - CASE WHEN rej THEN 0.35 ELSE 0 END - CASE WHEN badpe THEN 0.35 ELSE 0 END - CASE WHEN cheap THEN 0.2 ELSE 0 END
  - CASE WHEN thin THEN 0.15 ELSE 0 END - CASE WHEN stale THEN 0.2 ELSE 0 END AS b FROM q2),
q4 AS (SELECT *, round(least(greatest(CASE WHEN rel THEN least(b, 0.2) ELSE b END - CASE WHEN dist THEN 0.2 ELSE 0 END, 0), 1), 10) AS c FROM q3),
quality AS (SELECT *, round(c, 4) AS quality_score, CASE WHEN no_t OR (rej AND fb) OR (rel AND ext) OR c <= 0.15 THEN 'reject' WHEN c <= 0.4 THEN 'low' WHEN c <= 0.7 THEN 'medium' ELSE 'high' END AS quality_bucket,
  list_sort(list_distinct(list_filter([CASE WHEN no_t THEN 'missing_target' END, CASE WHEN fb THEN 'sector_pe_fallback' END, CASE WHEN ext THEN 'extreme_upside' END, CASE WHEN badpe THEN 'negative_or_zero_forward_pe' END,
  CASE WHEN cheap THEN 'very_low_price' END, CASE WHEN thin THEN 'low_liquidity' END, CASE WHEN stale THEN 'stale_target' END, CASE WHEN rel THEN 'target_class_mismatch_suspected' END, CASE WHEN rel THEN 'unit_or_share_class_mismatch_suspected' END,
  CASE WHEN rel THEN 'corporate_action_check_required' END, CASE WHEN dist OR (cheap AND rej) THEN 'distressed_price_action' END], lambda x: x IS NOT NULL))) AS flags, round(raw, 4) AS raw_upside_pct FROM q4)"""
VW = """v AS (SELECT var_samp(sharpe_norm) AS s, var_samp(upside_norm) AS u, var_samp(momentum_norm) AS m FROM normed),
w0 AS (SELECT 0.6 * s / (s + u + m) + 0.4 * 0.4 AS a, 0.6 * u / (s + u + m) + 0.4 * 0.35 AS b, 0.6 * m / (s + u + m) + 0.4 * 0.25 AS c FROM v),
w AS (SELECT a / (a + b + c) AS sharpe_weight, b / (a + b + c) AS upside_weight, c / (a + b + c) AS momentum_weight FROM w0)"""
BW = "bw AS (SELECT date, close, row_number() OVER (ORDER BY date DESC) AS pos, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM bench)"
WR = "(SELECT symbol, arg_min(close, pos) / arg_max(close, pos) - 1 AS r FROM e WHERE pos <= {n} + 1 GROUP BY symbol HAVING count(*) >= {k})"

QUERIES = {
    "sc1_sector_median_pe": (lambda s, d: sc.sector_median_pe(table(s, d, "instruments"), table(s, d, "fundamentals")), "SELECT sector, sector_pe FROM sector_pe"),
    "sc2_upside": (lambda s, d: r6(_upsides(s, d), "upside", "target_price").select("symbol", "source", "upside", "target_price"), "SELECT symbol, source, round(upside, 6) AS upside, round(target_price, 6) AS target_price FROM upsides"),
    "sc3_minmax": (lambda s, d: r6(_normed(s, d), "sharpe_norm", "upside_norm", "momentum_norm").select("symbol", "sharpe_norm", "upside_norm", "momentum_norm"), "SELECT symbol, round(sharpe_norm, 6) AS sharpe_norm, round(upside_norm, 6) AS upside_norm, round(momentum_norm, 6) AS momentum_norm FROM normed"),
    "sc4_factor_weights": (lambda s, d: r6(sc.factor_weights(_normed(s, d)), "sharpe_weight", "upside_weight", "momentum_weight"), f"WITH {VW} SELECT round(sharpe_weight, 6) AS sharpe_weight, round(upside_weight, 6) AS upside_weight, round(momentum_weight, 6) AS momentum_weight FROM w"),
    "sc5_composite_score": (sc5, f"""WITH {VW}, x AS (SELECT symbol, sharpe_norm * sharpe_weight + upside_norm * upside_weight + momentum_norm * momentum_weight AS sc, sharpe_weight AS sw FROM normed CROSS JOIN w)
        SELECT symbol, CAST(row_number() OVER (ORDER BY sc DESC, symbol) AS INTEGER) AS rank, round(sc, 6) AS score, round(sw, 6) AS sharpe_weight FROM x"""),
    "sc6_trend_regime": (lambda s, d: r6(sc.trend_regime(table(s, d, "bench")), "trend", "vol_percentile"), f"""WITH {BW}, n AS (SELECT count(*) AS n, arg_min(close, pos) AS b, arg_max(close, pos) AS a, stddev_samp(CASE WHEN pos < 60 THEN r END) * sqrt(252) AS vol FROM bw WHERE pos <= 60),
        v AS (SELECT CASE WHEN count(r) OVER w = 60 THEN stddev_samp(r) OVER w * sqrt(252) END AS v FROM bw WHERE r IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
        x AS (SELECT n.n, (b / a - 1) * 252 / n.n AS t, (SELECT count_if(v.v < n.vol) / count(*) FROM v) AS p FROM n)
        SELECT round(t, 6) AS trend, round(p, 6) AS vol_percentile, CASE WHEN n < 20 THEN 'neutral' WHEN t > 0.2 AND p < 0.7 THEN 'strong_bull' WHEN t > 0.1 THEN 'bull' WHEN t < -0.2 OR p > 0.8 THEN 'strong_bear' WHEN t < -0.1 THEN 'bear' ELSE 'neutral' END AS regime FROM x"""),
    "sc7_market_stress": (lambda s, d: r6(sc.market_stress(table(s, d, "bars"), table(s, d, "bench"), table(s, d, "instruments")), "bench_return_3m", "bench_return_6m", "bench_drawdown_3m", "bench_drawdown_6m", "bench_vol", "negative_3m", "negative_6m", "dispersion_3m", "drawdown_breadth", "worst_sector_return").withColumn("triggers", F.array_join("triggers", ",")), f"""WITH {BW}, e AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pos FROM bars),
        r3 AS {WR.format(n=63, k=28)}, r6 AS {WR.format(n=126, k=56)}, d6 AS (SELECT symbol, arg_min(close, pos) / max(close) - 1 AS dd FROM e WHERE pos <= 126 GROUP BY symbol HAVING count(*) >= 56),
        sm AS (SELECT i.sector, median(r) AS m FROM r3 JOIN instruments i ON r3.symbol = i.symbol GROUP BY i.sector),
        x AS (SELECT (SELECT max(date) FROM bars) AS as_of,
        (SELECT CASE WHEN count(*) >= 28 THEN (arg_min(close, pos) / arg_max(close, pos) - 1) * 100 END FROM bw WHERE pos <= 64) AS bench_return_3m, (SELECT CASE WHEN count(*) >= 56 THEN (arg_min(close, pos) / arg_max(close, pos) - 1) * 100 END FROM bw WHERE pos <= 127) AS bench_return_6m,
        (SELECT CASE WHEN count(*) >= 28 THEN (arg_min(close, pos) / max(close) - 1) * 100 END FROM bw WHERE pos <= 63) AS bench_drawdown_3m, (SELECT CASE WHEN count(*) >= 56 THEN (arg_min(close, pos) / max(close) - 1) * 100 END FROM bw WHERE pos <= 126) AS bench_drawdown_6m,
        (SELECT CASE WHEN count(*) >= 28 THEN stddev_samp(r) * sqrt(252) * 100 END FROM bw WHERE pos <= 63 AND r IS NOT NULL) AS bench_vol,
        (SELECT avg(CASE WHEN r < 0 THEN 100.0::DOUBLE ELSE 0 END) FROM r3) AS negative_3m, (SELECT avg(CASE WHEN r < 0 THEN 100.0::DOUBLE ELSE 0 END) FROM r6) AS negative_6m,
        (SELECT CASE WHEN count(*) >= 10 THEN (quantile_cont(r, 0.9) - quantile_cont(r, 0.1)) * 100 END FROM r3) AS dispersion_3m,
        (SELECT avg(CASE WHEN dd * 100 <= -20 THEN 100.0::DOUBLE ELSE 0 END) FROM d6) AS drawdown_breadth, (SELECT arg_min(sector, m) FROM sm) AS worst_sector, (SELECT min(m) * 100 FROM sm) AS worst_sector_return),
        y AS (SELECT *, list_filter([CASE WHEN bench_drawdown_3m <= -10 THEN 'benchmark_drawdown_3m' END, CASE WHEN bench_drawdown_6m <= -10 THEN 'benchmark_drawdown_6m' END, CASE WHEN negative_3m >= 60 THEN 'negative_breadth_3m' END,
        CASE WHEN drawdown_breadth >= 45 THEN 'broad_asset_drawdown' END, CASE WHEN bench_vol >= 25 THEN 'elevated_benchmark_volatility' END, CASE WHEN dispersion_3m >= 35 THEN 'high_cross_sectional_dispersion' END], lambda t: t IS NOT NULL) AS t FROM x),
        z AS (SELECT *, CASE WHEN len(t) = 0 THEN 'normal' WHEN list_has_any(t, ['benchmark_drawdown_3m', 'benchmark_drawdown_6m', 'negative_breadth_3m', 'broad_asset_drawdown']) THEN 'stress' ELSE 'volatile_watch' END AS state FROM y)
        SELECT as_of, round(bench_return_3m, 6) AS bench_return_3m, round(bench_return_6m, 6) AS bench_return_6m, round(bench_drawdown_3m, 6) AS bench_drawdown_3m, round(bench_drawdown_6m, 6) AS bench_drawdown_6m, round(bench_vol, 6) AS bench_vol,
        round(negative_3m, 6) AS negative_3m, round(negative_6m, 6) AS negative_6m, round(dispersion_3m, 6) AS dispersion_3m, round(drawdown_breadth, 6) AS drawdown_breadth, worst_sector, round(worst_sector_return, 6) AS worst_sector_return,
        array_to_string(t, ',') AS triggers, state, CAST(CASE state WHEN 'normal' THEN 1.0 WHEN 'stress' THEN 1.25 ELSE 1.1 END AS DOUBLE) AS shrinkage_mult, CAST(CASE state WHEN 'normal' THEN 0 WHEN 'stress' THEN 1 ELSE 0.5 END AS DOUBLE) AS hurdle_addon,
        CAST(CASE state WHEN 'normal' THEN 1 WHEN 'stress' THEN 0.7 ELSE 0.85 END AS DOUBLE) AS turnover_mult FROM z"""),
    "sc8_class_mismatch": (lambda s, d: sc.class_mismatch(_upsides(s, d), 0.15, 1.05), f"WITH {MISMATCH} SELECT symbol, related FROM mm"),
    "sc9_target_quality": (sc9, f"WITH {QUALITY} SELECT symbol, quality_score, quality_bucket, array_to_string(flags, ';') AS quality_flags, raw_upside_pct FROM quality"),
    "sc10_adjusted_return": (lambda s, d: r6(sc.adjusted_return(_quality(s, d), PARAMS), "shrinkage", "capped_pct", "penalty_pct", "adjusted_pct").select("symbol", "shrinkage", "capped_pct", "base_pct", "penalty_pct", "adjusted_pct"), f"""WITH {QUALITY},
        a AS (SELECT symbol, CAST(CASE WHEN quality_bucket = 'reject' THEN 0 ELSE quality_score END AS DOUBLE) AS s, CAST(least(greatest(coalesce(raw_upside_pct, 0), -80), 150) AS DOUBLE) AS c, CAST(CASE WHEN quality_bucket = 'reject' THEN 0 ELSE 4 END AS DOUBLE) AS b FROM quality)
        SELECT symbol, round(s, 6) AS shrinkage, round(c, 6) AS capped_pct, b AS base_pct, round(5 * (1 - s), 6) AS penalty_pct, round(s * c + (1 - s) * b - 5 * (1 - s), 6) AS adjusted_pct FROM a"""),
    "sc11_eligible": (sc11, """SELECT u.symbol, source, round(upside, 6) AS upside, round(target_price, 6) AS target_price FROM upsides u JOIN ranked k ON u.symbol = k.symbol
        WHERE (upside > 0 OR k.pos % 3 = 0) AND price > 0 AND target_price > 0 AND forward_pe > 0"""),
    "sc12_top_n": (sc12, "SELECT sector, CAST(rank AS INTEGER) AS rank, symbol, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, symbol) AS rank FROM composite) WHERE rank <= 5"),
    "sc13_blended_returns": (sc13, f"""WITH {PADRET}, h AS (SELECT symbol, avg(ret) * 252 AS m FROM pr GROUP BY symbol)
        SELECT h.symbol, round(CASE WHEN u.upside IS NULL THEN h.m ELSE 0.35 * h.m + 0.65 * u.upside END, 6) AS expected FROM h LEFT JOIN (SELECT * FROM upsides WHERE source <> 'None') u ON h.symbol = u.symbol"""),
    "sc14_correlation_pairs": (sc14, """WITH x AS (SELECT * FROM ret WHERE ret IS NOT NULL AND symbol IN (SELECT symbol FROM hold_w))
        SELECT a.symbol AS a, b.symbol AS b, round(CASE WHEN isfinite(corr(a.ret, b.ret)) THEN corr(a.ret, b.ret) END, 6) AS corr, count(*) AS n FROM x a JOIN x b ON a.date = b.date GROUP BY 1, 2 HAVING count(*) >= 3"""),
    "sc15_correlation_groups": (sc15, """WITH g AS (SELECT symbol, CASE WHEN pos < 4 THEN 'holdings' WHEN pos = 4 THEN 'both' ELSE 'model' END AS grp FROM ranked WHERE pos <= 7),
        gb AS (SELECT b.symbol, b.date, b.close FROM bars b JOIN g ON b.symbol = g.symbol), own AS (SELECT DISTINCT date FROM gb ORDER BY date DESC LIMIT 252),
        cut AS (SELECT gb.* FROM gb JOIN own ON gb.date = own.date),
        gp AS (SELECT x.symbol, x.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY x.symbol ORDER BY x.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM (SELECT f.symbol, o.date FROM (SELECT symbol, min(date) AS first FROM cut GROUP BY symbol) f JOIN own o ON o.date >= f.first) x LEFT JOIN cut b ON b.symbol = x.symbol AND b.date = x.date),
        r AS (SELECT * FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM gp) WHERE ret IS NOT NULL),
        f AS (SELECT date FROM r GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM gb)), y AS (SELECT r.* FROM r JOIN f ON r.date = f.date),
        o AS (SELECT g.symbol, grp, row_number() OVER (ORDER BY CASE grp WHEN 'holdings' THEN 0 WHEN 'both' THEN 1 ELSE 2 END, g.symbol) AS place FROM g JOIN (SELECT DISTINCT symbol FROM gb) t ON g.symbol = t.symbol)
        SELECT a.symbol AS a, b.symbol AS b, round(CASE WHEN isfinite(corr(a.ret, b.ret)) THEN corr(a.ret, b.ret) END, 4) AS corr, count(*) AS n, any_value(oa.grp) AS group_a, any_value(ob.grp) AS group_b, CAST(any_value(oa.place) AS INT) AS place_a, CAST(any_value(ob.place) AS INT) AS place_b
        FROM y a JOIN y b ON a.date = b.date JOIN o oa ON a.symbol = oa.symbol JOIN o ob ON b.symbol = ob.symbol GROUP BY 1, 2"""),
    "sc16_avg_internal_corr": (sc16, f"""WITH {PADRET}, x AS (SELECT * FROM pr WHERE ret IS NOT NULL AND symbol IN (SELECT symbol FROM hold_w)),
        p AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS c FROM x a JOIN x b ON a.date = b.date WHERE a.symbol < b.symbol GROUP BY 1, 2)
        SELECT h.portfolio_id, round(avg(CASE WHEN isfinite(p.c) THEN p.c END), 6) AS avg_corr, count(CASE WHEN isfinite(p.c) THEN 1 END) AS n_pairs FROM hold_w h JOIN hold_w i ON h.portfolio_id = i.portfolio_id JOIN p ON p.a = h.symbol AND p.b = i.symbol WHERE h.weight > 0 AND i.weight > 0 GROUP BY 1"""),
    "sc17_published_targets": (lambda s, d: r6(sc.published_targets(_upsides(s, d), table(s, d, "last_price"), 2.0), "target"), "SELECT regexp_replace(upper(u.symbol), '[^A-Z0-9]', '', 'g') AS key, round(target_price, 6) AS target FROM upsides u JOIN last_price p ON u.symbol = p.symbol WHERE target_price > 0 AND target_price <= 2 * p.price"),
}
