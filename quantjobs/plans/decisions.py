"""Queries of the rebalancing and history operators, each with its SQL (None for the iterative caps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantjobs.operators import history as hc
from quantjobs.operators import ledger as lg
from quantjobs.operators import rebalance as rb
from quantjobs.operators import scoring as sc
from quantjobs.operators import timeseries as ts
from quantjobs.plans.fixtures import table
from quantjobs.plans.market import decimal_rounds
from quantjobs.plans.scoring import PARAMS, QUALITY, _quality

COST = 0.3


def rounded(df, digits, *cols):
    """Rounded from a decimal, as ``decimal_rounds`` has it in SQL: an edge that floats miss by a hair counts as one."""
    return df.withColumns({c: F.round(F.col(c).cast("decimal(28,9)"), digits).cast("double") for c in cols})


def r4(df, *cols):
    return rounded(df, 4, *cols)


def r6(df, *cols):
    return rounded(df, 6, *cols)


def _hold(s, d):
    return table(s, d, "hold_w")


def _target(s, d):
    return _hold(s, d).select("portfolio_id").distinct().join(F.broadcast(table(s, d, "ideal")), F.lit(True))


def _rated(s, d):
    return sc.adjusted_return(_quality(s, d), PARAMS)


def rb1(s, d):
    pos = lg.positions(table(s, d, "trades"), table(s, d, "last_price"), table(s, d, "upsides"))
    return rb.holdings_metrics(pos, table(s, d, "bars"), table(s, d, "upsides")).withColumns({"value": F.round("value", 2), "expected_return": F.round(F.col("expected_return").cast("decimal(28,9)"), 4).cast("double")})


def _blends(s, d):
    """All blends of every portfolio, each summed up in one row."""
    rated = _rated(s, d).select("symbol", "quality_score", F.col("quality_bucket").isin("low", "reject").cast("double").alias("poor"), "raw_upside_pct", "adjusted_pct")
    facts = table(s, d, "upsides").select("symbol", "upside", "sharpe", "momentum", "price").join(rated, "symbol", "left")
    return rb.blend_sums(_hold(s, d), table(s, d, "ideal"), facts)


def rb2(s, d):
    return r6(rb.blend_sums(_hold(s, d), table(s, d, "ideal"), table(s, d, "upsides").select("symbol")).select("portfolio_id", "blend", "n", "total", "hhi", "top"), "total", "hhi", "top")


def _candidates(s, d):
    return rb.blend_sums(_hold(s, d), table(s, d, "ideal"), table(s, d, "upsides").select("symbol", "upside", "sharpe", "momentum"))


def _trades(s, d):
    return rb.transition_trades(_hold(s, d), _target(s, d), table(s, d, "last_price"), COST)


def _gate_input(s, d):
    h = hc.history_per_date(table(s, d, "history"), ["portfolio_id"])
    last = h.groupBy("portfolio_id").agg(F.max_by(F.struct("decision", "gain", "turnover", "run_id"), "date").alias("r")).select("portfolio_id", "r.*")
    days = rb.signal_persistence(table(s, d, "history"))
    zero = F.lit(0.0)
    return last.join(days, "portfolio_id").select("portfolio_id", F.col("decision").alias("official"), "gain", F.lit(0.2).alias("cost"), F.when(F.col("run_id") % 3 == 0, 0.5).otherwise(zero).alias("hurdle_addon"), F.when(F.col("run_id") % 3 == 0, 0.85).otherwise(1.0).alias("turnover_mult"), "turnover", ((F.col("run_id") % 10) / 10.0).alias("quality"), ((F.col("run_id") % 50) * 1.0).alias("suspicious"), "days")


def rb9(s, d):
    m = _gate_input(s, d)
    both = rb.rebalance_gate(m).withColumn("mode", F.lit("gated")).unionByName(rb.rebalance_gate(m, aggressive=True).withColumn("mode", F.lit("aggressive")))
    return r6(both.select("portfolio_id", "mode", "decision", "hurdle", F.array_join("vetoes", ",").alias("vetoes")), "hurdle")


def _gate(s, d):
    ids = _hold(s, d).select("portfolio_id").distinct()
    n = F.col("portfolio_id").cast("int") % 4
    return ids.select("portfolio_id", F.element_at(F.array(F.lit("REBALANCE"), F.lit("PARTIAL_REBALANCE"), F.lit("WATCH"), F.lit("HOLD")), n + 1).alias("decision"), F.lit(35.0).alias("budget"))


def _contributors(s, d):
    return rb.return_contributors(_hold(s, d).select("portfolio_id", "symbol", "weight"), _rated(s, d))


def rb12(s, d):
    return r4(rb.frontier(rb.score_candidates(_blends(s, d))), "adjusted", "turnover_pct", "stable_score", "turnover_saved")


def _universe(s, d, state="normal"):
    scored = _rated(s, d).join(table(s, d, "composite").select("symbol", "score"), "symbol")
    return rb.balanced_universe(scored, ts.history_metrics(table(s, d, "bars")), state)


def rb13(s, d):
    return r4(_universe(s, d, "volatile_watch").select("symbol", "reason", "balanced_expected", "balanced_score"), "balanced_expected", "balanced_score")


def rb14(s, d):
    rated = _rated(s, d).join(table(s, d, "composite").select("symbol", "score"), "symbol").select("symbol", "sector", "quality_bucket", "score")
    picked = sc.top_n(_hold(s, d).select("portfolio_id", "symbol").join(rated, "symbol"), 12, ["portfolio_id"])
    return rb.capped_weights(picked.select("portfolio_id", "symbol", "sector", "quality_bucket", "score", F.lit(0.12).alias("cap")))


def rb16(s, d):
    h = table(s, d, "history").groupBy("portfolio_id").agg(F.max("gain").alias("a"), F.avg("gain").alias("b"), F.min("gain").alias("c"), F.max("turnover").alias("t"), F.max("run_id").alias("r"))
    rows = [F.struct(F.lit(o).alias("option"), F.col(e).alias("expected"), (F.col("t") * m).alias("turnover"), (F.col("t") * m / 50).alias("cost"), (F.col("r") % k).alias("violations")) for o, e, m, k in (("official", "a", 1.0, 2), ("stable", "b", 0.5, 3), ("balanced", "c", 0.2, 1))]
    options = h.select("portfolio_id", F.explode(F.array(*rows)).alias("o")).select("portfolio_id", "o.*")
    return r4(rb.destination(rb.rebalance_gate(_gate_input(s, d)), options), "net", "turnover", "gain_over_official")


def _outcomes(s, d):
    signals = table(s, d, "history").select("portfolio_id", "run_id", F.add_months("date", -12 * 29).alias("date"))
    daily = table(s, d, "port_ret").join(table(s, d, "bench_ret").withColumnRenamed("ret", "bench"), "date")
    return hc.forward_outcomes(signals, daily)


def hc3(s, d):
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("S"), (F.col("run_id") * 7 + i * 13) % 25))
    return r4(hc.set_stability(table(s, d, "history").withColumn("symbols", F.when(F.col("run_id") % 6 > 0, ids)), ["portfolio_id"]).select("portfolio_id", "run_id", "jaccard"), "jaccard")


def _variants(s, d):
    h = table(s, d, "history").withColumn("date", F.add_months("date", -12 * 29))
    yes, c = F.lit(True), F.col
    return hc.variant_signals(h, {
        "official": (yes, c("decision") == "REBALANCE", c("turnover"), c("gain")),
        "gated": (c("run_id") % 2 == 0, c("gain") >= c("hurdle"), c("turnover"), c("gain")),
        "partial": (yes, c("decision").isin("REBALANCE", "PARTIAL_REBALANCE"), c("turnover") / 2, c("gain") / 2),
        "stable": (c("run_id") % 3 > 0, c("gain") > 0, c("turnover") * 0.4, c("gain") * 0.8),
        "balanced": (c("run_id") % 5 > 0, c("gain") > 1, c("turnover") * 0.6, c("gain") * 0.7),
    })


def hc5(s, d, regime=False):
    v, o = _variants(s, d), _outcomes(s, d)
    if regime:
        out = hc.calibration_by_regime(v.withColumn("regime", F.when(F.day("date") % 2 == 0, "bull").otherwise("bear")), o)
    else:
        out = hc.calibration_summary(v, o)
    return r6(out, *[c for c in out.columns if c not in ("variant", "k", "runs", "regime")])


BLEND = """ids AS (SELECT DISTINCT portfolio_id FROM hold_w), goal AS (SELECT portfolio_id, symbol, weight AS w2 FROM ids CROSS JOIN ideal),
bo AS (SELECT coalesce(h.portfolio_id, g.portfolio_id) AS portfolio_id, coalesce(h.symbol, g.symbol) AS symbol, coalesce(h.weight, 0) AS w1, coalesce(g.w2, 0) AS w2 FROM hold_w h FULL JOIN goal g ON h.portfolio_id = g.portfolio_id AND h.symbol = g.symbol),
bt AS (SELECT portfolio_id, sum(w1) AS t1, sum(w2) AS t2 FROM bo GROUP BY 1), br AS (SELECT CAST(k AS DOUBLE) / 100 AS blend FROM range(101) AS r(k)),
bl AS (SELECT * FROM (SELECT bo.portfolio_id, blend, symbol, (w1 * (1 - blend) + w2 * blend) / (t1 * (1 - blend) + t2 * blend) AS weight FROM bo JOIN bt ON bo.portfolio_id = bt.portfolio_id CROSS JOIN br) WHERE round(weight, 10) > 0.001)"""
CAND = "ca AS (SELECT b.portfolio_id, b.blend, sum(b.weight * u.upside) * 100 AS er, sum(b.weight * u.sharpe) AS sh, sum(b.weight * u.momentum) AS mo FROM bl b JOIN upsides u ON b.symbol = u.symbol GROUP BY 1, 2)"
SCORE = "sco AS (SELECT *, 0.4 * CASE WHEN er IS NULL THEN 0 WHEN er > 0 THEN ln(1 + er / 100) / 0.693 ELSE er / 100 / 0.2 END + 0.4 * CASE WHEN sh IS NULL THEN 0 WHEN sh > 0 THEN ln(1 + sh) / 1.386 ELSE sh END + 0.2 * CASE WHEN mo IS NULL THEN 0 WHEN mo > 0 THEN ln(1 + mo) / 1.098 ELSE mo END AS score FROM ca)"
TRADE = """tgt AS (SELECT portfolio_id, symbol, weight FROM (SELECT DISTINCT portfolio_id FROM hold_w) i CROSS JOIN ideal), tot AS (SELECT portfolio_id, sum(value) AS pv FROM hold_w GROUP BY 1),
tr0 AS (SELECT coalesce(h.portfolio_id, t.portfolio_id) AS portfolio_id, coalesce(h.symbol, t.symbol) AS symbol, coalesce(h.weight, 0) AS cw, coalesce(t.weight, 0) AS tw FROM hold_w h FULL JOIN tgt t ON h.portfolio_id = t.portfolio_id AND h.symbol = t.symbol),
tr AS (SELECT a.portfolio_id, a.symbol, cw, tw, tw - cw AS dw, p.price, greatest(1, floor(round(abs(tw - cw) * pv / p.price, 6))) AS shares, greatest(1, floor(round(abs(tw - cw) * pv / p.price, 6))) * p.price AS tv, pv FROM tr0 a JOIN tot ON a.portfolio_id = tot.portfolio_id JOIN last_price p ON a.symbol = p.symbol WHERE round(abs(tw - cw), 10) >= 0.001)"""
ADJ = QUALITY + """,
aq AS (SELECT *, s * c2 + (1 - s) * b2 - 5 * (1 - s) AS adjusted_pct FROM (SELECT *, CAST(CASE WHEN quality_bucket = 'reject' THEN 0 ELSE quality_score END AS DOUBLE) AS s, CAST(least(greatest(coalesce(raw_upside_pct, 0), -80), 150) AS DOUBLE) AS c2, CAST(CASE WHEN quality_bucket = 'reject' THEN 0 ELSE 4 END AS DOUBLE) AS b2 FROM quality))"""
CONTRIB = "co AS (SELECT h.portfolio_id, h.symbol, h.weight, q.source, q.quality_bucket, q.quality_score, h.weight * coalesce(q.raw_upside_pct, 0) AS rc, h.weight * coalesce(q.adjusted_pct, 0) AS ac, row_number() OVER (PARTITION BY h.portfolio_id ORDER BY round(abs(h.weight * coalesce(q.raw_upside_pct, 0)), 10) DESC, h.symbol) AS rank FROM hold_w h JOIN aq q ON h.symbol = q.symbol)"
LASTH = """hd AS (SELECT portfolio_id, date, arg_max({'decision': decision, 'gain': gain, 'hurdle': hurdle, 'turnover': turnover, 'run_id': run_id}, {'t': timestamp, 'r': run_id}) AS r FROM history GROUP BY 1, 2),
pe AS (SELECT portfolio_id, count_if(f = 0) AS days FROM (SELECT portfolio_id, max(CASE WHEN r.gain >= r.hurdle THEN 0 ELSE 1 END) OVER (PARTITION BY portfolio_id ORDER BY date DESC ROWS UNBOUNDED PRECEDING) AS f FROM hd) GROUP BY 1),
gi AS (SELECT l.portfolio_id, l.r.decision AS official, l.r.gain AS gain, CASE WHEN l.r.run_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS addon, CASE WHEN l.r.run_id % 3 = 0 THEN 0.85::DOUBLE ELSE 1 END AS mult, l.r.turnover AS turnover, (l.r.run_id % 10) / 10.0::DOUBLE AS quality, CAST(l.r.run_id % 50 AS DOUBLE) AS susp, pe.days FROM (SELECT portfolio_id, arg_max(r, date) AS r FROM hd GROUP BY 1) l JOIN pe ON l.portfolio_id = pe.portfolio_id),
g1 AS (SELECT *, 0.5::DOUBLE + 0.2 + 0.15 + 0.5 + addon AS hurdle FROM gi),
g2 AS (SELECT *, list_filter([CASE WHEN gain < hurdle THEN 'adjusted_gain_below_hurdle' END, CASE WHEN days < 2 THEN 'signal_not_persistent' END, CASE WHEN turnover > 35 * mult THEN 'turnover_above_budget' END, CASE WHEN quality < 0.6 THEN 'target_quality_below_floor' END, CASE WHEN susp > 35 THEN 'suspicious_return_contribution_high' END], lambda x: x IS NOT NULL) AS v, list_filter([CASE WHEN gain < hurdle THEN 'adjusted_gain_below_hurdle' END], lambda x: x IS NOT NULL) AS va FROM g1)"""
DEC = "CASE WHEN official <> 'REBALANCE' AND len({v}) > 0 THEN 'HOLD' WHEN len({v}) = 0 THEN 'REBALANCE' WHEN len({v}) = 1 AND {v}[1] = 'turnover_above_budget' AND gain >= greatest(hurdle, 1) THEN 'PARTIAL_REBALANCE' ELSE 'WATCH' END"
FWD = """rw AS (SELECT p.date, p.ret, b.ret AS b, row_number() OVER (ORDER BY p.date) AS idx FROM port_ret p JOIN bench_ret b ON p.date = b.date),
sd AS (SELECT DISTINCT CAST(date - INTERVAL 29 YEAR AS DATE) AS date FROM history), fi AS (SELECT sd.date, min(idx) AS i FROM sd JOIN rw ON rw.date > sd.date GROUP BY 1), sp AS (SELECT date, i, k FROM fi CROSS JOIN (VALUES (5), (21)) AS v(k)),
iw AS (SELECT sp.date, sp.k, rw.idx, rw.ret, rw.b, product(1 + rw.ret) OVER (PARTITION BY sp.date, sp.k ORDER BY rw.idx ROWS UNBOUNDED PRECEDING) AS v FROM sp JOIN rw ON rw.idx >= i AND rw.idx < i + k),
dq AS (SELECT *, 1 - v / greatest(max(v) OVER (PARTITION BY date, k ORDER BY idx ROWS UNBOUNDED PRECEDING), 1) AS dd FROM iw),
oc AS (SELECT date, k, product(1 + ret) - 1 AS port, product(1 + b) - 1 AS bench, stddev_samp(ret) * sqrt(252) AS vol, max(dd) AS drawdown FROM dq GROUP BY date, k HAVING count(*) = k),
oa AS (SELECT sd.date, v.k, oc.port, oc.bench, oc.vol, oc.drawdown, oc.port - oc.bench AS alpha FROM sd CROSS JOIN (VALUES (5), (21)) AS v(k) LEFT JOIN oc ON oc.date = sd.date AND oc.k = v.k)"""
VAR = """hs AS (SELECT *, CAST(date - INTERVAL 29 YEAR AS DATE) AS d FROM history),
va AS (SELECT portfolio_id, run_id, d AS date, 'official' AS variant, true AS available, decision = 'REBALANCE' AS trade, turnover, gain FROM hs UNION ALL SELECT portfolio_id, run_id, d, 'gated', run_id % 2 = 0, gain >= hurdle, turnover, gain FROM hs
UNION ALL SELECT portfolio_id, run_id, d, 'partial', true, decision IN ('REBALANCE', 'PARTIAL_REBALANCE'), turnover / 2, gain / 2 FROM hs UNION ALL SELECT portfolio_id, run_id, d, 'stable', run_id % 3 > 0, gain > 0, turnover * 0.4::DOUBLE, gain * 0.8::DOUBLE FROM hs
UNION ALL SELECT portfolio_id, run_id, d, 'balanced', run_id % 5 > 0, gain > 1, turnover * 0.6::DOUBLE, gain * 0.7::DOUBLE FROM hs)"""


def _calibration(regime: bool) -> str:
    extra = ", regime" if regime else ""
    col = ", CASE WHEN day(va.date) % 2 = 0 THEN 'bull' ELSE 'bear' END AS regime" if regime else ""
    match = " AND s.regime = b.regime" if regime else ""
    return f"""WITH {FWD}, {VAR}, j AS (SELECT va.*, oa.k, oa.port, oa.alpha{col} FROM va JOIN oa ON va.date = oa.date),
        s AS (SELECT variant, k{extra}, count(*) AS runs, avg(CASE WHEN available THEN 100.0::DOUBLE ELSE 0 END) AS coverage, avg(CASE WHEN available THEN CASE WHEN trade THEN 100.0::DOUBLE ELSE 0 END END) AS frequency, avg(CASE WHEN available AND trade THEN turnover END) AS turnover,
        avg(CASE WHEN available AND trade AND alpha IS NOT NULL THEN CASE WHEN alpha <= 0 THEN 100.0::DOUBLE ELSE 0 END END) AS false_positive, avg(CASE WHEN available AND trade THEN port END) AS forward, avg(CASE WHEN available AND trade THEN alpha END) AS forward_alpha,
        avg(CASE WHEN available AND trade AND port IS NOT NULL THEN CASE WHEN port > 0 THEN 100.0::DOUBLE ELSE 0 END END) AS hit_rate FROM j GROUP BY variant, k{extra})
        SELECT s.k, s.variant{extra.replace(' ', ' s.')}, s.runs, round(s.coverage, 6) AS coverage, round(s.frequency, 6) AS frequency, round(s.turnover, 6) AS turnover, round(s.false_positive, 6) AS false_positive, round(s.forward, 6) AS forward, round(s.forward_alpha, 6) AS forward_alpha, round(s.hit_rate, 6) AS hit_rate,
        round(s.forward - b.forward, 6) AS forward_delta, round(s.turnover - b.turnover, 6) AS turnover_delta FROM s LEFT JOIN s b ON s.k = b.k AND b.variant = 'official'{match}"""


QUERIES = {
    "rb1_holdings_metrics": (rb1, """SELECT h.portfolio_id, round(sum(h.value), 2) AS value, count(*) AS n, round(sum(h.value * coalesce(CASE WHEN u.target_price > 0 THEN u.target_price / h.price - 1 END, c.ret, 0)) / sum(h.value) * 100, 4) AS expected_return FROM hold_w h LEFT JOIN upsides u ON h.symbol = u.symbol
        LEFT JOIN (SELECT symbol, b / coalesce(a, o) - 1 AS ret FROM (SELECT b.symbol, arg_max(close, date) AS b, arg_max(close, date) FILTER (WHERE date <= last - 365) AS a, arg_min(close, date) AS o FROM bars b JOIN (SELECT symbol, max(date) AS last FROM bars GROUP BY symbol) m ON b.symbol = m.symbol GROUP BY b.symbol)) c ON h.symbol = c.symbol GROUP BY 1"""),
    "rb2_blend_candidates": (rb2, f"WITH {BLEND} SELECT portfolio_id, blend, count(*) AS n, round(sum(weight), 6) AS total, round(sum(weight * weight), 6) AS hhi, round(max(weight), 6) AS top FROM bl GROUP BY 1, 2"),
    "rb3_transition_trades": (lambda s, d: r4(_trades(s, d).drop("portfolio_value", "current_weight", "target_weight", "price"), "weight_change", "trade_value", "cost"), f"WITH {TRADE} SELECT portfolio_id, symbol, CASE WHEN dw > 0 THEN 'BUY' ELSE 'SELL' END AS action, round(dw, 4) AS weight_change, CAST(shares AS BIGINT) AS shares, round(tv, 4) AS trade_value, round(tv * 0.3 / 100, 4) AS cost FROM tr"),
    "rb3_trade_summary": (lambda s, d: r4(rb.trade_summary(_trades(s, d)), "bought", "sold", "cost", "turnover_pct"), f"WITH {TRADE} SELECT portfolio_id, count(*) AS n, round(sum(CASE WHEN dw > 0 THEN tv ELSE 0 END), 4) AS bought, round(sum(CASE WHEN dw > 0 THEN 0 ELSE tv END), 4) AS sold, round(sum(tv * 0.3 / 100), 4) AS cost, round(sum(tv) / max(pv) * 100, 4) AS turnover_pct FROM tr GROUP BY 1"),
    "rb4_best_candidate": (lambda s, d: r6(rb.best_candidate(_candidates(s, d)), "score"), f"WITH {BLEND}, {CAND}, {SCORE} SELECT portfolio_id, blend, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(score, 10) DESC, blend) AS n FROM sco) WHERE n = 1"),
    "rb5_discretize": (lambda s, d: r4(rb.discretize(_hold(s, d).select("portfolio_id", "symbol", "weight", (F.col("portfolio_id").cast("int") % 50 * 1000.0 + 5000).alias("capital")), "capital", table(s, d, "last_price")).drop("weight", "price", "capital"), "value", "new_weight"), """WITH x AS (SELECT h.portfolio_id, h.symbol, greatest(1, floor(weight * (CAST(portfolio_id AS INT) % 50 * 1000.0::DOUBLE + 5000) / p.price)) AS shares, greatest(1, floor(weight * (CAST(portfolio_id AS INT) % 50 * 1000.0::DOUBLE + 5000) / p.price)) * p.price AS value FROM hold_w h JOIN last_price p ON h.symbol = p.symbol)
        SELECT portfolio_id, symbol, CAST(shares AS BIGINT) AS shares, round(value, 4) AS value, round(value / sum(value) OVER (PARTITION BY portfolio_id), 4) AS new_weight FROM x"""),
    "rb6_return_contributors": (lambda s, d: r4(_contributors(s, d).select("portfolio_id", "symbol", "rank", "raw_contribution", "adjusted_contribution"), "raw_contribution", "adjusted_contribution"), f"WITH {ADJ}, {CONTRIB} SELECT portfolio_id, symbol, CAST(rank AS INTEGER) AS rank, round(rc, 4) AS raw_contribution, round(ac, 4) AS adjusted_contribution FROM co"),
    "rb6_return_concentration": (lambda s, d: r4(rb.return_concentration(_contributors(s, d)), "top1", "top2", "top5"), f"WITH {ADJ}, {CONTRIB} SELECT portfolio_id, " + ", ".join(f"round(sum(CASE WHEN rank <= {k} THEN abs(rc) ELSE 0 END) / nullif(sum(abs(rc)), 0) * 100, 4) AS top{k}" for k in (1, 2, 5)) + " FROM co GROUP BY 1"),
    "rb6_contribution_by": (lambda s, d: r4(rb.contribution_by(_contributors(s, d), "quality_bucket"), "weight", "raw", "adjusted"), f"WITH {ADJ}, {CONTRIB} SELECT portfolio_id, quality_bucket, count(*) AS n, round(sum(weight), 4) AS weight, round(sum(rc), 4) AS raw, round(sum(ac), 4) AS adjusted FROM co GROUP BY 1, 2"),
    "rb7_quality_metrics": (lambda s, d: r4(rb.quality_metrics(_contributors(s, d)), "quality", "low_reject_pct", "suspicious_pct"), f"WITH {ADJ}, {CONTRIB} SELECT portfolio_id, round(sum(weight * quality_score) / sum(weight), 4) AS quality, round(sum(CASE WHEN quality_bucket IN ('low', 'reject') THEN weight ELSE 0 END) * 100, 4) AS low_reject_pct, round(sum(CASE WHEN quality_bucket IN ('low', 'reject') THEN greatest(rc, 0) ELSE 0 END) / nullif(sum(greatest(rc, 0)), 0) * 100, 4) AS suspicious_pct FROM co GROUP BY 1"),
    "rb8_signal_persistence": (lambda s, d: rb.signal_persistence(table(s, d, "history")), f"WITH {LASTH} SELECT portfolio_id, days FROM pe"),
    "rb9_rebalance_gate": (rb9, f"WITH {LASTH} SELECT portfolio_id, 'gated' AS mode, {DEC.format(v='v')} AS decision, round(hurdle, 6) AS hurdle, array_to_string(v, ',') AS vetoes FROM g2 UNION ALL SELECT portfolio_id, 'aggressive', {DEC.format(v='va')}, round(hurdle, 6), array_to_string(va, ',') FROM g2"),
    "rb10_execution_plan": (lambda s, d: r4(rb.execution_plan(_trades(s, d), _gate(s, d)), "value"), f"""WITH RECURSIVE {TRADE}, t AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(abs(dw), 10) DESC, symbol) AS k, ['REBALANCE', 'PARTIAL_REBALANCE', 'WATCH', 'HOLD'][CAST(portfolio_id AS INT) % 4 + 1] AS d FROM tr),
        f AS (SELECT portfolio_id, CAST(0 AS BIGINT) AS k, any_value(pv) * any_value(CASE d WHEN 'REBALANCE' THEN 25 WHEN 'PARTIAL_REBALANCE' THEN 10 ELSE 0 END) / 100 AS budget, 0 AS n, '' AS symbol, '' AS action, '' AS decision, '' AS status, CAST(0 AS BIGINT) AS shares, CAST(0 AS DOUBLE) AS value FROM t GROUP BY portfolio_id
        UNION ALL SELECT portfolio_id, k, budget - CASE WHEN ok THEN val ELSE 0 END, n + CASE WHEN ok THEN 1 ELSE 0 END, symbol, action, d, CASE WHEN can IS NOT NULL THEN can WHEN ok THEN 'EXECUTE' ELSE 'DEFER_BUDGET' END, CASE WHEN ok THEN sh ELSE 0 END, CASE WHEN ok THEN val ELSE 0 END FROM
            (SELECT *, can IS NULL AND round(val, 10) >= 25 AND (sh > 0 OR whole = 0) AS ok FROM (SELECT *, CASE WHEN d = 'REBALANCE' THEN tv WHEN price > 0 AND whole > 0 THEN sh * price ELSE least(tv, budget) END AS val FROM
            (SELECT t.portfolio_id, t.k, f.budget, f.n, t.symbol, CASE WHEN dw > 0 THEN 'BUY' ELSE 'SELL' END AS action, d, tv, price, CAST(t.shares AS BIGINT) AS whole, CAST(CASE WHEN d = 'REBALANCE' THEN t.shares WHEN price > 0 THEN least(t.shares, floor(f.budget / price)) ELSE 0 END AS BIGINT) AS sh,
                CASE WHEN round(abs(dw) * 100, 10) < 1 THEN 'IGNORE_BAND' WHEN round(tv, 10) < 25 THEN 'IGNORE_SMALL' WHEN d = 'WATCH' THEN 'MONITOR' WHEN d = 'HOLD' THEN 'HOLD' WHEN d = 'PARTIAL_REBALANCE' AND f.n >= 6 THEN 'DEFER_MAX_ACTIONS' WHEN f.budget <= 0 THEN 'DEFER_BUDGET' END AS can
             FROM f JOIN t ON f.portfolio_id = t.portfolio_id AND t.k = f.k + 1))))
        SELECT portfolio_id, decision, symbol, action, status, shares, round(value, 4) AS value FROM f WHERE k > 0"""),
    "rb11_sector_drift": (lambda s, d: r4(rb.sector_drift(_hold(s, d), _target(s, d), table(s, d, "instruments")), "current", "target", "drift"), f"""WITH {TRADE}, a AS (SELECT portfolio_id, sector, sum(weight) * 100 AS c FROM hold_w h JOIN instruments i ON h.symbol = i.symbol GROUP BY 1, 2), b AS (SELECT portfolio_id, sector, sum(weight) * 100 AS t FROM tgt JOIN instruments i ON tgt.symbol = i.symbol GROUP BY 1, 2)
        SELECT coalesce(a.portfolio_id, b.portfolio_id) AS portfolio_id, coalesce(a.sector, b.sector) AS sector, round(coalesce(c, 0), 4) AS current, round(coalesce(t, 0), 4) AS target, round(coalesce(t, 0) - coalesce(c, 0), 4) AS drift, abs(coalesce(t, 0) - coalesce(c, 0)) >= 3 AS outside FROM a FULL JOIN b ON a.portfolio_id = b.portfolio_id AND a.sector = b.sector"""),
    "rb12_stable_frontier": (rb12, f"""WITH {BLEND}, {CAND}, {SCORE}, {ADJ}, tot AS (SELECT portfolio_id, sum(value) AS pv FROM hold_w GROUP BY 1),
        b0 AS (SELECT h.portfolio_id, h.symbol, br.blend, h.weight AS cw FROM hold_w h CROSS JOIN br),
        t0 AS (SELECT coalesce(b0.portfolio_id, bl.portfolio_id) AS portfolio_id, coalesce(b0.symbol, bl.symbol) AS symbol, coalesce(b0.blend, bl.blend) AS blend, coalesce(bl.weight, 0) - coalesce(b0.cw, 0) AS dw FROM b0 FULL JOIN bl ON b0.portfolio_id = bl.portfolio_id AND b0.symbol = bl.symbol AND b0.blend = bl.blend),
        tu AS (SELECT t0.portfolio_id, blend, sum(greatest(1, floor(round(abs(dw) * pv / p.price, 6))) * p.price) / max(pv) * 100 AS turnover_pct FROM t0 JOIN tot ON t0.portfolio_id = tot.portfolio_id JOIN last_price p ON t0.symbol = p.symbol WHERE round(abs(dw), 10) >= 0.001 GROUP BY 1, 2),
        c0 AS (SELECT bl.*, q.quality_bucket IN ('low', 'reject') AS poor, q.quality_score AS qs, weight * coalesce(q.raw_upside_pct, 0) AS rc, weight * coalesce(q.adjusted_pct, 0) AS ac FROM bl LEFT JOIN aq q ON bl.symbol = q.symbol),
        c1 AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id, blend ORDER BY abs(round(rc, 10)) DESC, symbol) AS k FROM c0),
        m AS (SELECT portfolio_id, blend, sum(ac) AS adjusted, sum(CASE WHEN qs IS NOT NULL THEN weight * qs END) / nullif(sum(CASE WHEN qs IS NOT NULL THEN weight END), 0) AS quality, sum(CASE WHEN poor THEN greatest(rc, 0) ELSE 0 END) / nullif(sum(greatest(rc, 0)), 0) * 100 AS suspicious, sum(CASE WHEN k <= 2 THEN abs(rc) ELSE 0 END) / nullif(sum(abs(rc)), 0) * 100 AS top2 FROM c1 GROUP BY 1, 2),
        ba AS (SELECT portfolio_id, sum(h.weight * coalesce(q.adjusted_pct, 0)) AS base FROM hold_w h LEFT JOIN aq q ON h.symbol = q.symbol GROUP BY 1),
        s AS (SELECT m.*, coalesce(turnover_pct, 0) AS turnover, sco.score, adjusted - base - 0.05 * coalesce(turnover_pct, 0) - 0.10 * greatest(coalesce(turnover_pct, 0) - 35, 0) - 4 * (1 - coalesce(quality, 0)) - 0.03 * greatest(coalesce(top2, 0) - 50, 0) - 0.05 * coalesce(suspicious, 0) AS stable
            FROM m JOIN ba ON m.portfolio_id = ba.portfolio_id JOIN sco ON m.portfolio_id = sco.portfolio_id AND m.blend = sco.blend LEFT JOIN tu ON m.portfolio_id = tu.portfolio_id AND m.blend = tu.blend),
        z AS (SELECT *, first_value(blend) OVER (PARTITION BY portfolio_id ORDER BY round(stable, 8) DESC, blend) AS best, first_value(turnover) OVER (PARTITION BY portfolio_id ORDER BY round(stable, 8) DESC, blend) AS tb, first_value(turnover) OVER (PARTITION BY portfolio_id ORDER BY round(score, 10) DESC, blend) AS official FROM s)
        SELECT portfolio_id, blend, round(adjusted, 4) AS adjusted, round(turnover, 4) AS turnover_pct, round(stable, 4) AS stable_score, blend = best AS selected, round(official - tb, 4) AS turnover_saved FROM z"""),
    "rb13_balanced_universe": (rb13, f"""WITH {ADJ}, hm AS (SELECT symbol, count(*) AS n, avg(CASE WHEN pos <= 21 THEN close * volume END) AS tv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pos FROM bars) GROUP BY 1),
        dd AS (SELECT symbol, max(d) AS dd FROM (SELECT symbol, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS d FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pos FROM bars) WHERE pos <= 126) GROUP BY 1),
        x AS (SELECT q.*, c.score AS cs, hm.n, hm.tv, dd.dd, least(greatest(adjusted_pct, -40), 40) * 0.35 * 0.75 + least(greatest(coalesce(q.annual_mean, 0) * 100, -30), 30) * 0.25 + least(greatest(coalesce(q.momentum, 0) * 100, -30), 30) * 0.15 + CASE WHEN q.forward_pe > 0 AND q.sector_pe > 0 THEN least(greatest((q.sector_pe / q.forward_pe - 1) * 10, -30), 30) ELSE 0 END * 0.15
        + least(greatest(q.dividend_yield, 0), 12) * 0.1 - (1 - quality_score) * 6 - 1 AS e FROM aq q JOIN composite c ON q.symbol = c.symbol JOIN hm ON q.symbol = hm.symbol JOIN dd ON q.symbol = dd.symbol)
        SELECT symbol, CASE WHEN quality_bucket = 'reject' THEN 'target_quality_reject' WHEN quality_score < 0.3 THEN 'target_quality_below_minimum' WHEN rel THEN 'target_class_mismatch' WHEN n < 100 THEN 'insufficient_price_history' WHEN tv < 1000 THEN 'liquidity_below_minimum' END AS reason, round(e, 4) AS balanced_expected,
        round(e + quality_score * 3 + cs * 3 - coalesce(annual_std, 0) * 100 * 0.08 - greatest(dd * 100 - 15, 0) * 0.04 - CASE WHEN quality_bucket = 'low' THEN 8 ELSE 0 END - CASE WHEN tv < 2000 THEN 2 ELSE 0 END, 4) AS balanced_score FROM x"""),
    "rb13_reason_counts": (lambda s, d: rb.reason_counts(_universe(s, d)), f"""WITH {ADJ}, hm AS (SELECT symbol, count(*) AS n, avg(CASE WHEN pos <= 21 THEN close * volume END) AS tv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pos FROM bars) GROUP BY 1)
        SELECT reason, count(*) AS n FROM (SELECT CASE WHEN quality_bucket = 'reject' THEN 'target_quality_reject' WHEN quality_score < 0.3 THEN 'target_quality_below_minimum' WHEN rel THEN 'target_class_mismatch' WHEN n < 100 THEN 'insufficient_price_history' WHEN tv < 1000 THEN 'liquidity_below_minimum' END AS reason FROM aq JOIN hm ON aq.symbol = hm.symbol) WHERE reason IS NOT NULL GROUP BY 1"""),
    "rb14_capped_weights": (rb14, None),
    "rb15_constraint_violations": (lambda s, d: r4(rb.constraint_violations(_hold(s, d).select("portfolio_id", "symbol", "weight"), _rated(s, d)), "actual"), f"""WITH {ADJ}, x AS (SELECT h.portfolio_id, h.weight, q.sector, q.quality_bucket, row_number() OVER (PARTITION BY h.portfolio_id ORDER BY weight DESC, h.symbol) AS p FROM hold_w h JOIN aq q ON h.symbol = q.symbol),
        s AS (SELECT portfolio_id, max(w) * 100 AS m FROM (SELECT portfolio_id, sector, sum(weight) AS w FROM x GROUP BY 1, 2) GROUP BY 1), g AS (SELECT x.portfolio_id, max(weight) * 100 AS a, any_value(s.m) AS s, sum(CASE WHEN quality_bucket = 'low' THEN weight ELSE 0 END) * 100 AS l, sum(CASE WHEN p <= 5 THEN weight ELSE 0 END) * 100 AS t, sum(weight * weight) AS h, CAST(count(*) AS DOUBLE) AS n FROM x JOIN s ON x.portfolio_id = s.portfolio_id GROUP BY 1)
        SELECT portfolio_id, 'max_asset_weight_pct' AS code, round(a, 4) AS actual, 12.0::DOUBLE AS threshold FROM g WHERE a > 12 UNION ALL SELECT portfolio_id, 'max_sector_weight_pct', round(s, 4), 30 FROM g WHERE s > 30 UNION ALL SELECT portfolio_id, 'max_low_quality_weight_pct', round(l, 4), 8 FROM g WHERE l > 8
        UNION ALL SELECT portfolio_id, 'max_top5_weight_pct', round(t, 4), 50 FROM g WHERE t > 50 UNION ALL SELECT portfolio_id, 'max_hhi', round(h, 4), 0.12 FROM g WHERE h > 0.1201 UNION ALL SELECT portfolio_id, 'min_positions', n, 8 FROM g WHERE n < 8 UNION ALL SELECT portfolio_id, 'max_positions', n, 20 FROM g WHERE n > 20"""),
    "rb16_destination": (rb16, f"""WITH {LASTH}, h AS (SELECT portfolio_id, max(gain) AS a, avg(gain) AS b, min(gain) AS c, max(turnover) AS t, max(run_id) AS r FROM history GROUP BY 1),
        o AS (SELECT portfolio_id, 'official' AS option, a - t / 50 AS net, t AS turnover, r % 2 AS x FROM h UNION ALL SELECT portfolio_id, 'stable', b - t * 0.5 / 50, t * 0.5, r % 3 FROM h UNION ALL SELECT portfolio_id, 'balanced', c - t * 0.2 / 50, t * 0.2, 0 FROM h),
        k AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY x = 0 DESC, round(net, 8) DESC, turnover, option DESC) AS n, max(CASE WHEN option = 'official' THEN net END) OVER (PARTITION BY portfolio_id) AS f FROM o)
        SELECT k.portfolio_id, CAST(3 AS BIGINT) AS options, option AS destination, round(net, 4) AS net, round(k.turnover, 4) AS turnover, round(net - f, 4) AS gain_over_official, {DEC.format(v='v')} AS decision FROM k JOIN g2 ON k.portfolio_id = g2.portfolio_id WHERE n = 1"""),
    "hc1_history_per_date": (lambda s, d: hc.history_per_date(table(s, d, "history"), ["portfolio_id"]).select("portfolio_id", "date", "run_id", "decision"), f"WITH {LASTH} SELECT portfolio_id, date, r.run_id AS run_id, r.decision AS decision FROM hd"),
    "hc1_return_history": (lambda s, d: hc.return_history(table(s, d, "history")).select("run_id", "portfolio_id", "date", "decision", F.round("series.gain", 6).alias("gain")), "SELECT run_id, portfolio_id, date, decision, round(gain, 6) AS gain FROM history"),
    "hc2_forward_outcomes": (lambda s, d: r6(_outcomes(s, d), "port", "bench", "alpha", "vol", "drawdown"), f"WITH {FWD} SELECT h.portfolio_id, h.run_id, oa.date, oa.k, round(port, 6) AS port, round(bench, 6) AS bench, round(alpha, 6) AS alpha, round(vol, 6) AS vol, round(drawdown, 6) AS drawdown FROM history h JOIN oa ON oa.date = CAST(h.date - INTERVAL 29 YEAR AS DATE)"),
    "hc3_set_stability": (hc3, """WITH h AS (SELECT portfolio_id, run_id, date, CASE WHEN run_id % 6 > 0 THEN list_transform(range(5), lambda i: (run_id * 7 + i * 13) % 25) END AS s FROM history),
        b AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY portfolio_id ORDER BY date, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h)
        SELECT portfolio_id, run_id, round(CAST(len(list_intersect(s, p)) AS DOUBLE) / len(list_distinct(list_concat(s, p))) * 100, 4) AS jaccard FROM b WHERE s IS NOT NULL AND p IS NOT NULL UNION ALL SELECT portfolio_id, run_id, NULL FROM b WHERE s IS NULL OR p IS NULL"""),
    "hc4_variant_signals": (lambda s, d: r6(_variants(s, d), "turnover", "gain"), f"WITH {VAR} SELECT portfolio_id, run_id, date, variant, available, trade, round(turnover, 6) AS turnover, round(gain, 6) AS gain FROM va"),
    "hc5_calibration_summary": (hc5, _calibration(False)),
    "hc5_calibration_by_regime": (lambda s, d: hc5(s, d, True), _calibration(True)),
    "hc6_nearest_match": (lambda s, d: r6(hc.nearest_match(table(s, d, "history").where("decision = 'REBALANCE'"), table(s, d, "history").where("decision = 'WATCH'"), ["portfolio_id"]), "seconds"), """WITH m AS (SELECT a.portfolio_id, a.run_id AS left_run, b.run_id AS right_run, abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) AS g FROM history a JOIN history b ON a.portfolio_id = b.portfolio_id AND a.decision = 'REBALANCE' AND b.decision = 'WATCH')
        SELECT portfolio_id, left_run, right_run, round(g / 1000000, 6) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY left_run ORDER BY g, right_run) AS n FROM m WHERE g < 1800000000) WHERE n = 1"""),
}

QUERIES = {name: (f, decimal_rounds(sql)) for name, (f, sql) in QUERIES.items()}
