"""Hand-computed goldens and invariants of the reference's operators."""

from datetime import date

import pytest

from quantjobs.functions.text import parse_amount, parse_date
from quantjobs.operators import ledger as lg
from quantjobs.operators import performance as pf
from quantjobs.operators import rebalance as rb
from quantjobs.operators import scoring as sc
from quantjobs.operators import search as ps
from quantjobs.sources import tables as io

TRADES = "trade_date date, symbol string, side string, quantity double, unit_price double, gross_value double, fees double"


def twr(spark, trades, closes, start="2025-01-01", end="2025-03-31"):
    t = spark.createDataFrame([(date(*d), "STOCK1", s, q, p, q * p, f) for d, s, q, p, f in trades], TRADES)
    b = spark.createDataFrame([("STOCK1", date(*d), c) for d, c in closes], "symbol string, date date, close double")
    return [(r["month"], r["ret"], r["ret_cum"], r["flows"]) for r in lg.monthly_twr_from_trades(t, b, start, end).orderBy("month").collect()]


def test_empty_month(spark):
    assert twr(spark, [], [], end="2025-01-31") == [("2025-01", 0.0, 0.0, 0.0)]


def test_buy_and_fees(spark):
    assert twr(spark, [((2025, 1, 5), "C", 10.0, 100.0, 0.0)], [((2025, 1, 31), 110.0)], end="2025-01-31")[0][1] == 0.1
    got = twr(spark, [((2025, 1, 5), "C", 10.0, 100.0, 5.0)], [((2025, 1, 31), 110.0)], end="2025-01-31")[0]
    assert got[3] == 1005.0 and got[1] == pytest.approx(1100 / 1005 - 1, abs=1e-6)


def test_partial_sale_and_chain(spark):
    got = twr(spark, [((2025, 1, 5), "C", 20.0, 100.0, 0.0), ((2025, 2, 10), "V", 10.0, 115.0, 0.0)], [((2025, 1, 31), 120.0), ((2025, 2, 28), 120.0)], end="2025-02-28")
    assert got[0][1] == 0.2 and got[1][1] == pytest.approx(1200 / (2400 - 1150) - 1, abs=1e-6)
    got = twr(spark, [((2025, 1, 5), "C", 10.0, 100.0, 0.0)], [((2025, 1, 31), 110.0), ((2025, 2, 28), 110.0), ((2025, 3, 31), 121.0)])
    assert [g[1] for g in got] == [0.1, 0.0, 0.1] and got[-1][2] == 0.21


def test_liquidation_and_gap(spark):
    got = twr(spark, [((2025, 1, 5), "C", 10.0, 100.0, 0.0), ((2025, 2, 10), "V", 10.0, 105.0, 0.0)], [((2025, 1, 31), 110.0), ((2025, 2, 28), 108.0)])
    assert got[1][1] == pytest.approx(1050 / 1100 - 1, abs=1e-6) and got[2][1] == 0.0
    got = twr(spark, [((2025, 1, 5), "C", 10.0, 100.0, 0.0), ((2025, 1, 20), "V", 10.0, 105.0, 0.0), ((2025, 3, 5), "C", 10.0, 100.0, 0.0)], [((2025, 1, 31), 108.0), ((2025, 3, 31), 112.0)])
    assert got[1][1] == 0.0 and got[2][1] == 0.12


def test_monthly_from_daily(spark):
    rows = [("p", date(2025, 1, 2), None, None), ("p", date(2025, 1, 3), 0.05, 0.0004), ("p", date(2025, 3, 3), 0.02, 0.0005), ("p", date(2025, 3, 4), 0.03, None)]
    d = spark.createDataFrame(rows, "k string, date date, ret double, rf double")
    got = lg.monthly_twr_from_daily(d, ["k"]).orderBy("month").collect()
    assert [(r["month"], r["sessions"]) for r in got] == [("2025-01", 1), ("2025-02", 0), ("2025-03", 2)]
    assert got[1]["ret"] == 0 and got[2]["ret_cum"] == pytest.approx(1.05 * 1.02 * 1.03 - 1, abs=1e-6)
    assert got[2]["rf_cum"] == pytest.approx(1.0004 * 1.0005 - 1, abs=1e-6)
    assert lg.monthly_twr_from_daily(d.limit(0), ["k"]).count() == 0


def test_amounts_and_dates(spark):
    rows = [("R$ 1.234,56", "05/01/1996"), ("1234.56", "1996-01-05"), ("(10,00)", "5/1/96"), ("x", "31/31/1996"), (None, None)]
    df = spark.createDataFrame(rows, "a string, d string")
    got = [(None if r[0] is None else float(r[0]), r[1]) for r in df.select(parse_amount(df.a), parse_date(df.d)).collect()]
    assert got == [(1234.56, date(1996, 1, 5)), (1234.56, date(1996, 1, 5)), (-10.0, date(2096, 1, 5)), (None, None), (None, None)]


def test_fee_remainder_goes_to_last_trade(spark):
    t = spark.createDataFrame([(1, k, 100.0) for k in (1, 2, 3)], "document long, seq int, gross_value double").selectExpr("document", "seq", "cast(gross_value as decimal(18,2)) gross_value")
    f = spark.sql("select 1L document, 'X' fee_type, cast(1.00 as decimal(18,2)) amount union all select 9L, 'X', cast(5 as decimal(18,2))")
    assert [float(r["fee"]) for r in lg.allocate_fees(t, f).orderBy("seq").collect()] == [0.33, 0.33, 0.34]


def test_cost_basis_average(spark):
    rows = [("p", "S", date(2025, 1, 1), 1, 1, "BUY", 10.0, 100.0), ("p", "S", date(2025, 1, 2), 2, 1, "BUY", 10.0, 200.0), ("p", "S", date(2025, 1, 3), 3, 1, "SELL", 5.0, 90.0)]
    d = spark.createDataFrame(rows, "portfolio_id string, symbol string, trade_date date, document int, seq int, side string, quantity double, gross_value double")
    assert [(r["qty"], r["basis"]) for r in lg.cost_basis(d, cost="gross_value").orderBy("date").collect()] == [(10.0, 100.0), (20.0, 300.0), (15.0, 225.0)]


def test_drawdown_starts_at_the_first_index(spark):
    d = spark.createDataFrame([("p", date(2025, 1, k), r) for k, r in ((1, -0.5), (2, 0.1), (3, -0.1))], "k string, date date, ret double")
    assert pf.absolute_risk(d, ["k"]).first()["max_drawdown"] == pytest.approx(0.1)


def test_search_is_repeatable_and_beats_equal_weights(spark):
    mean = spark.createDataFrame([("A", 0.1), ("B", 0.2), ("C", 0.05)], "symbol string, mean double")
    cov = spark.createDataFrame([(a, b, 0.04 if a == b else 0.01) for a in "ABC" for b in "ABC"], "a string, b string, cov double")
    sec = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "symbol string, sector string")
    combos = ps.combinations(sec, 2, 1)
    assert sorted(r[0] for r in combos.selectExpr("array_join(combo, '')").collect()) == ["AC", "BC"]
    one = {tuple(r["combo"]): r["sharpe"] for r in ps.random_weight_search(combos, mean, cov, sec).collect()}
    two = {tuple(r["combo"]): r["sharpe"] for r in ps.random_weight_search(combos.repartition(3), mean, cov, sec).collect()}
    assert one == two and one[("B", "C")] >= 0.125 / (0.25 * 0.04 * 2 + 0.5 * 0.01) ** 0.5
    best = ps.evolutionary_search(spark.sql("select 2 k, 1 seed"), mean, cov, sec, population=4, generations=3).collect()
    assert all(abs(sum(r["weights"]) - 1) < 1e-9 for r in best)


def test_caps_hold(spark):
    rows = [("p", f"S{k}", f"sec{k % 4}", "low" if k == 0 else "high", float(10 - k), 0.2) for k in range(10)]
    d = spark.createDataFrame(rows, "portfolio_id string, symbol string, sector string, quality_bucket string, score double, cap double")
    w = {r["symbol"]: r["weight"] for r in rb.capped_weights(d).collect()}
    assert sum(w.values()) == pytest.approx(1) and max(w.values()) <= 0.2 + 1e-6 and w["S0"] <= 0.08 + 1e-6


def test_partial_plan_respects_budget_and_actions(spark):
    rows = [("p", f"S{k}", "BUY", 10.0, 20, 200.0, 0.02 + k / 1000, 10_000.0) for k in range(9)]
    t = spark.createDataFrame(rows, "portfolio_id string, symbol string, action string, price double, shares long, trade_value double, weight_change double, portfolio_value double")
    g = spark.sql("select 'p' portfolio_id, 'PARTIAL_REBALANCE' decision, 35D budget")
    got = rb.execution_plan(t, g).collect()
    assert sum(r["value"] for r in got) <= 1000 and sum(r["status"] == "EXECUTE" for r in got) == 5
    assert [r["symbol"] for r in got if r["status"] == "EXECUTE"][0] == "S8"


def test_bars_and_history_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", "2025-01-02", 1.0, float("nan")), ("A", "bad", 2.0, 3.0)], "symbol string, date string, close double, volume double")
    assert [(r["date"], r["volume"]) for r in io.clean_bars(df).collect()] == [(date(2025, 1, 2), None)]
    io.write_table(io.clean_bars(df), str(tmp_path / "bars"), "parquet", ["symbol"])
    assert io.read_bars(spark, str(tmp_path / "bars"), "parquet").count() == 1
    (tmp_path / "h.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    rows, bad = io.read_history(spark, str(tmp_path / "h.jsonl"), "a int")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and bad.count() == 1


LEDGER = "portfolio_id string, symbol string, trade_date date, document int, seq int, side string, quantity double, gross_value double, total_cost double"


def test_cost_basis_counts_fees_and_oversold_sales(spark):
    rows = [("a", "S", date(2025, 1, 6), 1, 1, "BUY", 10.0, 100.0, 102.0), ("a", "S", date(2025, 1, 7), 2, 1, "SELL", 4.0, 60.0, 59.0), ("a", "S", date(2025, 1, 8), 3, 1, "BUY", 6.0, 90.0, 90.6)]
    # Sold beyond what is held: 8 of 5 at average cost 20.4 takes 163.2 of 102; out of nothing held, nothing.
    rows += [("b", "S", date(2025, 1, 6), 1, 1, "BUY", 5.0, 100.0, 102.0), ("b", "S", date(2025, 1, 7), 2, 1, "SELL", 8.0, 160.0, 159.0), ("b", "S", date(2025, 1, 8), 3, 1, "SELL", 1.0, 20.0, 20.0), ("b", "S", date(2025, 1, 9), 4, 1, "BUY", 10.0, 200.0, 201.0)]
    ledger = spark.createDataFrame(rows, LEDGER)
    got = {(r["portfolio_id"], r["date"].day): (r["qty"], pytest.approx(r["basis"])) for r in lg.cost_basis(ledger).collect()}
    assert got == {("a", 6): (10.0, 102.0), ("a", 7): (6.0, 61.2), ("a", 8): (12.0, 151.8), ("b", 6): (5.0, 102.0), ("b", 7): (-3.0, -61.2), ("b", 8): (-4.0, -61.2), ("b", 9): (6.0, 139.8)}
    bars = spark.createDataFrame([("S", date(2025, 1, 6), 11.0)], "symbol string, date date, close double")
    days = {(r["portfolio_id"], r["date"].day): r["cost_basis"] for r in lg.holdings_history(ledger, bars, "2025-01-10").collect()}
    assert days["a", 10] == pytest.approx(151.8) and days["b", 6] == pytest.approx(102.0) and ("b", 8) not in days and days["b", 10] == pytest.approx(139.8)


def test_fund_return_of_minus_one(spark):
    day = lambda k: date(2025, 1, k)
    hist = spark.createDataFrame([("p", day(k), "S", 1.0, 10.0, 10.0, 10.0) for k in (6, 7, 8, 9)], "portfolio_id string, date date, symbol string, qty double, price double, value double, cost_basis double")
    ledger = spark.createDataFrame([], LEDGER)
    moves = spark.createDataFrame([("p", 1, day(6), "APLICACAO_FUNDO", 100.0), ("p", 2, day(8), "APLICACAO_FUNDO", 50.0)], "portfolio_id string, seq int, date date, operation string, value double")
    bench = spark.createDataFrame([], "date date, ret double")
    fund = spark.createDataFrame([(day(7), 0.1), (day(8), -1.0), (day(9), 0.2)], "date date, fund_return double")
    got = {r["date"].day: r["fund_value"] for r in lg.real_daily(hist, ledger, moves, bench, fund).collect()}
    assert got == {6: 100.0, 7: pytest.approx(110.0), 8: 50.0, 9: pytest.approx(60.0)}


def test_scores_by_run(spark):
    rows = [(r, s, x * (r + 1), x, x / 2) for r in (0, 1) for s, x in (("A", 1.0), ("B", 3.0), ("C", 2.0))] + [(None, "A", 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "run_id int, symbol string, sharpe double, upside double, momentum double")
    normed = sc.minmax(df, *sc.FACTORS, by=["run_id"])
    weights = sc.factor_weights(normed, strength=0.0, by=["run_id"])
    out = {(r["run_id"], r["symbol"]): (r["sharpe_norm"], r["rank"]) for r in sc.composite_score(normed, weights, by=["run_id"]).collect()}
    assert out[0, "A"] == (0.0, 3) and out[1, "B"] == (1.0, 1) and out[1, "C"] == (0.5, 2) and out[None, "A"] == (0.5, 1) and len(out) == 7
    one = df.where("run_id = 0").drop("run_id")
    ranked = sc.rank_of(spark.createDataFrame([(f"s{k:04d}", float(k % 50) if k % 7 else None) for k in range(500)], "symbol string, score double"), slices=8)
    got = [(r["symbol"], r["score"]) for r in ranked.orderBy("rank").collect()]
    assert got == sorted(got, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])) and one.count() == 3


def test_values_and_costs_of_each_portfolio(spark):
    w = spark.createDataFrame([("a", "S", 0.5, 1000.0), ("a", "T", 0.5, 1000.0), ("b", "S", 1.0, 90.0)], "portfolio_id string, symbol string, weight double, capital double")
    prices = spark.createDataFrame([("S", 100.0), ("T", 300.0)], "symbol string, price double")
    got = {(r["portfolio_id"], r["symbol"]): (r["shares"], r["value"]) for r in rb.discretize(w, "capital", prices).collect()}
    assert got == {("a", "S"): (5, 500.0), ("a", "T"): (1, 300.0), ("b", "S"): (1, 100.0)}
    held = spark.createDataFrame([("a", "S", 1.0, 1000.0), ("b", "S", 1.0, 1000.0)], "portfolio_id string, symbol string, weight double, value double")
    goal = spark.createDataFrame([("a", "T", 1.0), ("b", "T", 1.0)], "portfolio_id string, symbol string, weight double")
    pct = spark.createDataFrame([("a", 1.0)], "portfolio_id string, cost_pct double")
    got = {(r["portfolio_id"], r["symbol"]): (r["shares"], r["cost"]) for r in rb.transition_trades(held, goal, prices, pct).collect()}
    assert got == {("a", "S"): (10, 10.0), ("a", "T"): (3, 9.0), ("b", "S"): (10, 0.0), ("b", "T"): (3, 0.0)}


def test_poor_combinations_are_given_up(spark):
    symbols = spark.createDataFrame([(f"S{k}", "x") for k in range(6)], "symbol string, sector string")
    mean = spark.createDataFrame([(f"S{k}", 0.3 if k < 3 else 0.001) for k in range(6)], "symbol string, mean double")
    cov = spark.createDataFrame([(f"S{a}", f"S{b}", 0.04 if a == b else 0.0) for a in range(6) for b in range(6)], "a string, b string, cov double")
    combos = ps.combinations(symbols, 2, 6)
    at, m, c, g = ps._arrays(mean, cov, symbols)
    bar = ps.equal_weight_bar(combos, at, m, c, ps.SearchParams())
    assert bar == pytest.approx(0.3 / 0.02**0.5, rel=1e-6)
    found = {tuple(r["combo"]): r["sharpe"] for r in ps.random_weight_search(combos, mean, cov, symbols).collect()}
    assert len(found) == 15 and found["S0", "S1"] >= bar > found["S4", "S5"]
