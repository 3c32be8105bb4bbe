"""Covariances and correlations of many series by blocked Gram matrices, pairwise complete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantjobs.sources.tables import scratch

#: Series of a block, dates multiplied at once, and pairs of blocks that a task adds up before it passes them on (50 MB).
SERIES, DATES, PAIRS = 128, 64, 64
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(returns: DataFrame, series: int = SERIES) -> DataFrame:
    """(a, b, n, sx, sy, sxx, syy, sxy) of every two symbols a <= b with a common date, over the dates on which both have a ret.

    x is the ret of a, y that of b. (symbol, date) is unique; null returns count as absent. The days of all symbols meet
    in blocks of dates, whose matrices are multiplied and added up in the task; a row of 128 sums for each symbol and block of
    symbols is what is shuffled, not a row for each pair and date. The returns, which are read twice, go to the scratch
    folder first.
    """
    spark = returns.sparkSession
    rows = scratch(returns.where("ret is not null").select("symbol", "date", F.col("ret").cast("double").alias("ret")), "returns")
    names = scratch(rows.select("symbol").distinct().withColumn("_i", F.row_number().over(Window.orderBy("symbol")) - 1), "names")  # a row a symbol
    placed = rows.join(names, "symbol").select(F.unix_date(F.to_date("date")).alias("date"), (F.col("_i") / series).cast("int").alias("block"), F.pmod("_i", F.lit(series)).cast("int").alias("at"), "ret")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def multiplied(sums: dict, own: pd.DataFrame) -> None:
        """Adds the sums of complete dates."""
        days = own["date"].to_numpy()
        for first in range(0, len(u := np.unique(days)), DATES):
            lot = own[(days >= u[first]) & (days <= u[min(first + DATES, len(u)) - 1])]
            day = np.searchsorted(u[first : first + DATES], lot["date"].to_numpy())
            blocks = {}
            for block in np.unique(lot["block"]):
                mine = (lot["block"] == block).to_numpy()
                x, m = np.zeros((DATES, series)), np.zeros((DATES, series))
                x[day[mine], lot["at"].to_numpy()[mine]], m[day[mine], lot["at"].to_numpy()[mine]] = lot["ret"].to_numpy()[mine], 1.0
                blocks[int(block)] = x, m
            for i, (x, m) in blocks.items():
                for j, (y, k) in blocks.items():
                    if i <= j:
                        new = np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y], axis=1)  # (series, 6, series)
                        sums[i, j] = sums[i, j] + new if (i, j) in sums else new

    def rows_of(sums: dict) -> pd.DataFrame:
        out = [(i * series + a, j, s[a].tobytes()) for (i, j), s in sums.items() for a in np.flatnonzero(s[:, 0].any(1))]
        sums.clear()
        return pd.DataFrame(out, columns=["a", "block", "sums"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, left = {}, None
        for pdf in batches:
            own = pdf if left is None else pd.concat([left, pdf])
            if not len(own):
                continue
            last = own["date"].to_numpy() == own["date"].iloc[-1]  # may go on in the next batch
            left = own[last]
            multiplied(sums, own[~last])
            if len(sums) > PAIRS:
                yield rows_of(sums)
        if left is not None:
            multiplied(sums, left)
        if sums:
            yield rows_of(sums)

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0).reshape(len(SUMS), series)
        b = key[1] * series + np.arange(series)
        keep = (total[0] > 0) & (b >= key[0])
        return pd.DataFrame({"a": np.full(keep.sum(), key[0]), "b": b[keep], **{s: t[keep] for s, t in zip(SUMS, total, strict=True)}})

    partial = placed.repartition(n, "date").sortWithinPartitions("date").mapInPandas(run, "a int, block int, sums binary")
    whole = partial.groupBy("a", "block").applyInPandas(added, "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    named = lambda x: names.select(F.col("_i").alias(x), F.col("symbol").alias(f"_{x}"))
    return whole.join(named("a"), "a").join(named("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("n").cast("bigint").alias("n"), *SUMS[1:])


def covariance() -> Column:
    """Sample covariance from the sums; null of fewer than two dates."""
    return F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1)


def correlation() -> Column:
    """Pearson's correlation from the sums; null of fewer than two dates or where a series doesn't vary on them."""
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def both_ways(half: DataFrame) -> DataFrame:
    """(a, b, ...) for a <= b with the other triangle added."""
    rest = [c for c in half.columns if c not in ("a", "b")]
    return half.unionByName(half.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))
