"""Scans in two levels, blocked Gram matrices, exact quantiles, ranges of days, token lookups, upserts at rest: brute force."""

import datetime as dt
import glob
import itertools
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantjobs.operators import gram
from quantjobs.operators import history as hc
from quantjobs.operators import ledger as lg
from quantjobs.operators import scoring as sc
from quantjobs.operators import search as ps
from quantjobs.operators import timeseries as ts
from quantjobs.operators.quantiles import exact_quantiles
from quantjobs.operators.scan import affine, running
from quantjobs.sources import tables as io

DAY = dt.date(2020, 1, 15)


def day(n):
    return DAY + dt.timedelta(days=n)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_a_loop(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if keys else "a", day(n), rng.choice([None, 0.5, 1.5, -1.0, 2.0])) for n in rng.sample(range(900), 400)]
    df = spark.createDataFrame(rows, "k string, date date, v double").repartition(3)
    outs = {"s": ("v", "sum"), "p": ("v", "product"), "m": ("v", "max"), "l": ("v", "last")}
    got = {(r["k"], r["date"]): r for r in running(df, keys, ["date"], outs).collect()}
    before = {(r["k"], r["date"]): r for r in running(df, keys, ["date"], outs, before=True).collect()}
    assert len(got) == len(before) == 400
    for k in {r[0] for r in rows}:
        s, p, m, last = 0.0, 1.0, None, None
        for _, d, v in sorted(r for r in rows if r[0] == k):
            b = before[k, d]
            assert (b["s"], b["m"], b["l"]) == (s, m, last) and math.isclose(b["p"], p)
            if v is not None:
                s, p, m, last = s + v, p * v, v if m is None else max(m, v), v
            r = got[k, d]
            assert (r["s"], r["m"], r["l"]) == (s, m, last) and math.isclose(r["p"], p)
    numbers = df.withColumn("n", F.datediff("date", F.lit(DAY)) * 1000)
    assert {(r["k"], r["date"]): r["s"] for r in running(numbers, keys, ["n"], {"s": ("v", "sum")}).collect()} == {k: r["s"] for k, r in got.items()}
    with pytest.raises(TypeError):
        running(df, keys, ["k"], outs)
    assert running(df.limit(0), keys, ["date"], outs).count() == 0


def test_affine_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(k, day(n), rng.choice([0.0, 0.5, 1.0, 1.5]), rng.choice([0.0, 10.0, -3.0])) for k in "ab" for n in rng.sample(range(1500), 200)]
    got = {(r["k"], r["date"]): r["x"] for r in affine(spark.createDataFrame(rows, "k string, date date, m double, a double").repartition(3), ["k"], "date", "m", "a", "x").collect()}
    for k in "ab":
        x = 0.0
        for _, d, m, a in sorted(r for r in rows if r[0] == k):
            x = m * x + a
            assert math.isclose(got[k, d], x, abs_tol=1e-9)


def test_hot_keys_are_scanned_in_many_tasks(spark):
    """One symbol, and none, with all rows: no window over more than a month, rows in many partitions."""
    df = spark.range(4000).select(F.lit("A").alias("symbol"), F.expr("date'2000-01-01' + cast(id as int)").alias("date"), (F.col("id") % 7 / 1000 - 0.002).alias("ret"), (F.col("id") % 11 + 1.0).alias("close"))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (ts.growth_index(df), ts.drawdown(df, "close"), ts.growth_index(df, keys=["symbol"]), ts.forward_fill(df, ["symbol"], "date", "close"), ts.asof_price(df.select("symbol", F.date_add("date", 1).alias("date")), df)):
            assert len({r["_p"] for r in out.withColumn("_p", F.spark_partition_id()).collect()}) >= 12
            assert "windowspecdefinition(date" not in plan_of(out)  # rows are in the order of dates within a bucket only
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    values = [r["index"] for r in ts.growth_index(df, 1.0).orderBy("date").collect()]
    assert np.allclose(values, np.cumprod(1 + np.arange(4000) % 7 / 1000 - 0.002))


def folded(trades):
    """(qty, basis) after each day."""
    qty = basis = 0.0
    out = {}
    for d, _, _, side, q, c in sorted(trades):
        if side == "SELL":
            basis -= basis / qty * q if qty > 0 else 0.0
            qty -= q
        else:
            basis, qty = basis + c, qty + q
        out[d] = (qty, basis)
    return out


def test_cost_basis_equals_a_fold(spark):
    rng = random.Random(3)
    rows = [(p, s, day(rng.randrange(400)), rng.randrange(5), k, rng.choice(["BUY", "SELL", "BUY"]), float(rng.randint(1, 9)), rng.randint(1, 500) / 4) for p in "pq" for s in "xyz" for k in range(60)]
    df = spark.createDataFrame(rows, "portfolio_id string, symbol string, trade_date date, document int, seq int, side string, quantity double, total_cost double").repartition(4)
    got = {(r["portfolio_id"], r["symbol"], r["date"]): (r["qty"], r["basis"]) for r in lg.cost_basis(df).collect()}
    want = {(p, s, d): v for p in "pq" for s in "xyz" for d, v in folded([(r[2], r[3], r[4], *r[5:]) for r in rows if r[:2] == (p, s)]).items()}
    assert got.keys() == want.keys()
    for k, (q, b) in want.items():
        assert got[k][0] == q and math.isclose(got[k][1], b, rel_tol=1e-9, abs_tol=1e-6)


def test_cost_basis_of_one_pair_with_many_trades(spark):
    df = spark.range(200_000).selectExpr("'p' as portfolio_id", "'x' as symbol", "date'2000-01-01' + cast(id % 2000 as int) as trade_date", "id as document", "1 as seq", "case when id % 3 = 2 then 'SELL' else 'BUY' end as side", "cast(1 + id % 5 as double) as quantity", "cast(10 + id % 7 as double) as total_cost")
    began = time.time()
    got = {r["date"]: (r["qty"], r["basis"]) for r in lg.cost_basis(df).collect()}
    assert time.time() - began < 120
    rows = [(r["trade_date"], r["document"], 1, r["side"], r["quantity"], r["total_cost"]) for r in df.collect()]
    want = folded(rows)
    assert got.keys() == want.keys() and all(got[d][0] == q and math.isclose(got[d][1], b, rel_tol=1e-6, abs_tol=1e-4) for d, (q, b) in want.items())


def test_combinations_are_dealt_out(spark):
    pool = spark.createDataFrame([(f"S{k:02}", f"sec{k % 4}") for k in range(14)], "symbol string, sector string")
    for k, most in ((1, 1), (2, 1), (3, 2), (5, 2), (5, 5)):
        got = [tuple(r["combo"]) for r in ps.combinations(pool, k, most).collect()]
        want = [c for c in itertools.combinations([f"S{x:02}" for x in range(14)], k) if max(Counter(int(x[1:]) % 4 for x in c).values()) <= most]
        assert sorted(got) == want and len(set(got)) == len(got)
    df = ps.combinations(pool, 5, 5, parts=24)
    assert df.rdd.getNumPartitions() == 24 and "Exchange" not in plan_of(df)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 24 and max(sizes) <= 2 * min(sizes)
    assert ps.combinations(pool.limit(2), 3, 3).count() == 0
    with pytest.raises(ValueError):
        ps.combinations(spark.range(200).selectExpr("cast(id as string) symbol", "'x' sector"), 40, 40)


def test_search_finds_good_weights(spark):
    """With one asset that dominates, the best of many draws puts most weight on it; draws don't depend on partitions."""
    mean = spark.createDataFrame([("A", 0.30), ("B", 0.05), ("C", 0.04)], "symbol string, mean double")
    cov = spark.createDataFrame([(a, b, 0.04 if a == b else 0.0) for a in "ABC" for b in "ABC"], "a string, b string, cov double")
    sec = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z")], "symbol string, sector string")
    combos = ps.combinations(sec, 3, 1)
    one = ps.random_weight_search(combos, mean, cov, sec).collect()
    assert [tuple(r["combo"]) for r in one] == [("A", "B", "C")] and abs(sum(one[0]["weights"]) - 1) < 1e-9 and one[0]["weights"][0] > 0.6
    assert one[0]["sharpe"] > 1.4  # the optimum is 1.54
    refined = ps.refine(ps.random_weight_search(combos, mean, cov, sec), mean, cov, sec, 1.0).collect()
    assert refined[0]["sharpe"] >= one[0]["sharpe"]
    u = ps.uniforms(np.arange(200), 0, 100, 3)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01


@pytest.mark.parametrize("series", [2, 128])
def test_pair_sums_equal_pandas(spark, series):
    rng = np.random.default_rng(4)
    x = pd.DataFrame(rng.normal(0, 0.01, (150, 7)), columns=list("ABCDEFG"), index=[day(k) for k in range(150)])
    x = x.mask(rng.random(x.shape) < 0.3)
    x["G"] = np.nan
    x.loc[x.index[:2], "G"] = 0.01
    rows = [(s, d, None if math.isnan(v) else float(v)) for s in x for d, v in x[s].items()]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double").repartition(5)
    got = {(r["a"], r["b"]): r for r in gram.pair_sums(df, series).select("a", "b", "n", gram.correlation().alias("corr"), gram.covariance().alias("cov")).collect()}
    corr, cov = x.corr(), x.cov()
    for a, b in itertools.combinations_with_replacement(x, 2):
        n = int((x[a].notna() & x[b].notna()).sum())
        assert ((a, b) in got) == (n > 0)
        if n and "G" not in (a, b):
            assert got[a, b]["n"] == n and math.isclose(got[a, b]["corr"], corr.loc[a, b], abs_tol=1e-9) and math.isclose(got[a, b]["cov"], cov.loc[a, b], abs_tol=1e-12)
    assert got["G", "G"]["corr"] is None  # doesn't vary
    assert gram.pair_sums(df.limit(0)).count() == 0


def test_correlation_groups_golden(spark):
    """Window, gaps and order by pandas."""
    rng = np.random.default_rng(5)
    prices = pd.DataFrame(100 * np.cumprod(1 + rng.normal(0, 0.01, (60, 4)), axis=0), columns=["M2", "B1", "H1", "M1"], index=[day(k) for k in range(60)])
    prices = prices.mask(rng.random(prices.shape) < 0.2)
    prices.loc[prices.index[:45], "M1"] = np.nan
    df = spark.createDataFrame([(s, d, float(v)) for s in prices for d, v in prices[s].items() if v == v], "symbol string, date date, close double")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "symbol string")
    rows = sc.correlation_groups(df, one("H1", "B1", "gone"), one("B1", "M1", "M2"), 30).collect()
    r = prices.dropna(how="all").tail(30).ffill().pct_change().dropna()
    want = r.corr()
    assert {(x["a"], x["b"]): round(x["corr"], 9) for x in rows} == {(a, b): round(want.loc[a, b], 9) for a in want for b in want}
    assert {x["n"] for x in rows} == {len(r)}
    assert [s for _, s in sorted({(x["place_a"], x["a"]) for x in rows})] == ["H1", "B1", "M1", "M2"]
    assert {(x["a"], x["group_a"]) for x in rows} == {("H1", "holdings"), ("B1", "both"), ("M1", "model"), ("M2", "model")}


@pytest.mark.parametrize("bins,few", [(4, 3), (1024, 10_000)])
def test_exact_quantiles_equal_numpy(spark, bins, few):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0, 1, 500), "b": np.r_[np.full(300, 2.0), rng.exponential(1, 101)], "c": np.array([5.0]), "d": np.r_[-1e300, 1e300, 1.0, 2.0, 2.0, 1e-300], None: rng.integers(0, 5, 60).astype(float)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", math.nan), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9, "top": 1.0}, bins, few).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in (("q1", 0.1), ("q5", 0.5), ("q9", 0.9), ("top", 1.0)):
            assert math.isclose(got[k][name], np.quantile(vs, p), rel_tol=1e-9, abs_tol=1e-12), (k, name)
    everything = np.concatenate(list(groups.values()))
    assert math.isclose(exact_quantiles(df, [], "v", {"m": 0.5}, bins, few).collect()[0]["m"], np.median(everything))
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_forward_windows_equal_a_loop(spark):
    rng = np.random.default_rng(7)
    n, ks = 400, (1, 5, 21, 252)
    r, b = rng.normal(0, 0.02, n), rng.normal(0, 0.01, n)
    r[50] = -1.0
    days = [day(3 * k) for k in range(n)]
    daily = spark.createDataFrame([(d, float(x), float(y)) for d, x, y in zip(days, r, b, strict=True)], "date date, ret double, bench double")
    signals = spark.createDataFrame([(k, day(k)) for k in range(-5, 1210, 7)], "run_id int, date date")
    out = hc.forward_outcomes(signals, daily, ks).collect()
    assert len(out) == signals.count() * len(ks)
    for x in out:
        i, k = next((j for j, d in enumerate(days) if d > x["date"]), n), x["k"]
        if i + k > n:
            assert x["port"] is None and x["drawdown"] is None
            continue
        v = np.cumprod(1 + r[i : i + k])
        peak = np.maximum(np.maximum.accumulate(v), 1)
        assert math.isclose(x["port"], v[-1] - 1, abs_tol=1e-9) and math.isclose(x["bench"], np.prod(1 + b[i : i + k]) - 1, abs_tol=1e-9)
        assert math.isclose(x["drawdown"], (1 - v / peak).max(), abs_tol=1e-9)
        assert x["vol"] is None if k == 1 else math.isclose(x["vol"], r[i : i + k].std(ddof=1) * math.sqrt(252), abs_tol=1e-9)


def test_suggestions_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["ALFA", "BETA", "GAMA", "DELTA", "OMEGA", "SIGMA", "KAPPA", "BANCO", "ENERGIA", "XY"])
    dim = [(f"S{k:03}", " ".join(["COMPANHIA", *(word() for _ in range(rng.randint(0, 5)))])) for k in range(150)]
    names = [" ".join(["companhia" if k % 3 else "", *(word() for _ in range(rng.randint(0, 5)))]).strip() or "a b" for k in range(120)]
    tokens = lambda t: {x for x in t.upper().split() if len(x) >= 3}
    got = {r["name"]: (r["symbol"], r["score"], r["confidence"]) for r in lg.suggest_symbols(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(dim, "symbol string, name string"), together=10).collect()}
    for n in set(names):
        s, sym = min((-len(tokens(n) & tokens(t)), sym) for sym, t in dim)
        assert got[n] == (sym if s else None, -s, "review" if s <= -2 else "low" if s == -1 else "missing")
    # A token in every name makes no pairs.
    many = spark.range(3000).selectExpr("concat('COMPANHIA N', id + 1000) as name", "cast(id as string) as symbol")
    out = lg.suggest_symbols(many.select("name"), many)
    assert {r["score"] for r in out.collect()} == {2}
    assert "CartesianProduct" not in plan_of(out) and "BroadcastNestedLoop" not in plan_of(out)


def test_prefixes_are_looked_up_by_key(spark):
    dim = spark.createDataFrame([("B1", "x", "BANCO DO BRASIL"), ("A1", "x", "BANCODATA"), ("C1", "x", None)], "symbol string, name string, broker_name string")
    df = spark.createDataFrame([("BANCOD",), ("BANC",), ("BANCO DO BRASIL ON",), ("NADA",), ("CDB BANC",), (None,)], "raw_name string")
    out = lg.resolve_symbols(df, dim)
    assert {r["raw_name"]: r["symbol"] for r in out.collect()} == {"BANCOD": "A1", "BANC": "A1", "BANCO DO BRASIL ON": "B1", "NADA": None, "CDB BANC": None, None: None}
    assert "NestedLoop" not in plan_of(out)


def test_upsert_at_rest(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    row = lambda *rows: spark.createDataFrame(rows, "symbol string, date date, year int, close double")
    first = row(("A", day(0), 2020, 1.0), ("A", day(400), 2021, 2.0), ("B", day(800), 2022, 3.0))
    assert io.upsert_at_rest(spark, path, first, ["symbol", "date", "year"], "year", "b1")
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/bars/data/year=*/*.parquet")}
    read = lambda: {(r["symbol"], r["year"]): r["close"] for r in spark.read.parquet(f"{path}/data").collect()}
    old = files()
    assert len(old) == 3 and not io.upsert_at_rest(spark, path, first, ["symbol", "date", "year"], "year", "b1") and files() == old  # a repeated batch
    more = row(("A", day(400), 2021, 5.0), ("C", day(401), 2021, 6.0)).withColumn("volume", F.lit(7.0))
    assert io.upsert_at_rest(spark, path, more, ["symbol", "date", "year"], "year", "b2")
    new = files()
    assert {f for f in old if "2021" not in f} == {f for f in new if "2021" not in f} and all(old[f] == new[f] for f in old if "2021" not in f)
    assert read() == {("A", 2020): 1.0, ("A", 2021): 5.0, ("C", 2021): 6.0, ("B", 2022): 3.0}
    assert io.upsert_at_rest(spark, path, more.limit(0), ["symbol", "date", "year"], "year", "b3") and files() == new
    both = spark.read.option("mergeSchema", True).parquet(f"{path}/data")
    assert {(r["symbol"], r["year"]): r["volume"] for r in both.collect()} == {("A", 2020): None, ("A", 2021): 7.0, ("C", 2021): 7.0, ("B", 2022): None}
