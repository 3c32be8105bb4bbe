"""Steps whose shuffles must not grow faster than the input."""

import datetime as dt

from pyspark.sql import functions as F

from quantjobs.operators import ledger as lg
from quantjobs.operators import rebalance as rb


def shuffled_after(df, node):
    """Exchanges between the first ``node`` of the plan and the result; broadcasts don't count."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if node in line)
    return [line for line in lines[:at] if "Exchange" in line and "Broadcast" not in line]


def test_months_between_trades_are_not_shuffled(spark):
    d = dt.date
    trades = spark.createDataFrame([(p, s, day, side, 10.0, 100.0, 1.0) for p in "ab" for s, day, side in [("X", d(2020, 1, 5), "C"), ("Y", d(2020, 2, 5), "C"), ("X", d(2020, 4, 5), "V"), ("X", d(2020, 9, 5), "C"), ("Y", d(2022, 9, 5), "V")]] + [("c", "X", d(2022, 1, 5), "C", 1.0, 1.0, 0.0)], "k string, symbol string, trade_date date, side string, quantity double, gross_value double, fees double")
    bars = spark.createDataFrame([("X", d(2020, 1, 31), 11.0), ("X", d(2020, 3, 2), 12.0), ("Y", d(2020, 3, 31), 9.0), ("X", d(2020, 10, 5), 14.0)], "symbol string, date date, close double")
    out = lg.monthly_twr_from_trades(trades, bars, "2020-01-01", "2020-12-31", ["k"])
    assert not shuffled_after(out, "Generate explode(sequence(")
    rows = {(r["k"], r["month"]): r for r in out.collect()}
    ends = [110.0, 110.0, 210.0, 90.0, 90.0, 90.0, 90.0, 90.0, 210.0, 230.0, 230.0, 230.0]
    for k in "ab":
        assert [rows[k, f"2020-{m:02}"]["value_end"] for m in range(1, 13)] == ends
        assert [rows[k, f"2020-{m:02}"]["flows"] for m in (1, 2, 3, 4, 9)] == [101.0, 101.0, 0.0, -99.0, 101.0]
    assert len(rows) == 36 and all(rows["c", f"2020-{m:02}"]["ret"] == 0 for m in range(1, 13))
    alone = lg.monthly_twr_from_trades(trades.where("k = 'a'"), bars, "2020-01-01", "2020-12-31").collect()
    assert {r["month"]: tuple(r) for r in alone} == {m: tuple(r)[1:] for (k, m), r in rows.items() if k == "a"}


def traded(spark, portfolios="ab"):
    d = dt.date(2020, 1, 6)
    rows = [(p, s, d + dt.timedelta(days=n), n, k, side, q, 10.0 * q) for p in portfolios for s in "XY" for n, k, side, q in [(0, 1, "BUY", 5.0), (0, 2, "SELL", 2.0), (42, 1, "SELL", 3.0), (50, 1, "SELL", 1.0), (60, 1, "BUY", 9.0), (95, 1, "SELL", 4.0)]]
    bars = spark.createDataFrame([(s, d + dt.timedelta(days=n), 10.0 + n % 7) for s in "XY" for n in range(0, 130, 3)], "symbol string, date date, close double")
    return spark.createDataFrame(rows, "portfolio_id string, symbol string, trade_date date, document long, seq int, side string, quantity double, total_cost double"), bars


def test_days_of_holdings_are_neither_broadcast_nor_shuffled(spark):
    ledger, bars = traded(spark, [f"a{k * 7919}" for k in range(1000)])  # far more rows than prices
    history = lg.holdings_history(ledger, bars, "2020-05-01")
    totals = lg.holdings_totals(history)
    assert not shuffled_after(totals, "Generate explode(filter(")
    built = [line for line in totals._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all("BuildRight" in line for line in built)
    days = {(r["portfolio_id"], r["symbol"], r["date"]): r for r in history.collect()}
    assert all(r["date"].weekday() < 5 for r in days.values())
    held = [n for n in range(0, 117) if (n < 42 or n >= 60) and (dt.date(2020, 1, 6) + dt.timedelta(days=n)).weekday() < 5]
    assert len(days) == 2000 * len(held)
    for n in held:
        r = days["a0", "X", dt.date(2020, 1, 6) + dt.timedelta(days=n)]
        assert (r["qty"], r["price"]) == (3.0 if n < 42 else 8.0 if n < 95 else 4.0, 10.0 + n // 3 * 3 % 7)


def test_folded_and_scanned_cost_basis_are_equal(spark):
    ledger, _ = traded(spark)
    folded, scanned = ({(r["portfolio_id"], r["symbol"], r["date"]): (round(r["qty"], 9), round(r["basis"], 9)) for r in lg.cost_basis(ledger, many=m).collect()} for m in (10, 1))
    assert folded == scanned and len(folded) == 20


def test_blends_are_summed_without_a_row_a_blend_and_symbol(spark):
    hold = spark.createDataFrame([(p, s, w, 1000 * w) for p, ws in {"a": (0.5, 0.3, 0.2), "b": (1.0, 0.0005, 0.0)}.items() for s, w in zip("XYZ", ws)], "portfolio_id string, symbol string, weight double, value double")
    ideal = spark.createDataFrame([("Y", 0.6), ("V", 0.4)], "symbol string, weight double")
    facts = spark.createDataFrame([("X", 0.1), ("Y", None), ("Z", -0.2), ("V", 0.3)], "symbol string, upside double")
    out = rb.blend_sums(hold, ideal, facts)
    assert not shuffled_after(out, "MapInArrow") and "explode" not in out._jdf.queryExecution().executedPlan().toString()
    sums = F.count("*").alias("n"), F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("upside")).alias("up")
    slow = {(r["portfolio_id"], r["blend"]): r for r in rb.blend_candidates(hold, ideal).join(facts, "symbol").groupBy("portfolio_id", "blend").agg(*sums).collect()}
    rows = out.collect()
    assert len(rows) == len(slow) == 202
    for r in rows:
        s = slow[r["portfolio_id"], r["blend"]]
        assert r["n"] == s["n"] and abs(r["total"] - s["total"]) < 1e-12 and abs(r["expected_return"] - 100 * s["up"]) < 1e-9 and r["sharpe"] is None


def test_facts_join_instruments_without_sorts(spark):
    """A sort for each side of each join of ``facts`` took a page of memory each, all in one task."""
    from quantjobs.plans import fixtures

    folder = "/root/testdata/sf0.001"
    facts = fixtures._derived(spark, folder, "facts")
    assert facts._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") == 5
    plain = fixtures.VIEWS["facts"]
    names = ("instruments", "last_price", "fundamentals", "sector_pe", "risk", "trend")
    for name in names:
        plain = plain.replace(f"JOIN {name} ", f"JOIN {{{name}}} ").replace(f"FROM {name} ", f"FROM {{{name}}} ")
    want = spark.sql(plain, **{name: fixtures.table(spark, folder, name) for name in names})
    assert facts.columns == want.columns and facts.exceptAll(want).count() == want.exceptAll(facts).count() == 0 < want.count()
