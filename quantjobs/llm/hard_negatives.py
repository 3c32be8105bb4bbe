"""Hard-negative mining by the threshold algorithm over per-dimension sorted lists.

Candidates lie in blocks that also hold, for every dimension, the order of their rows by that component. Anchors go
to the blocks in groups of a bounded size. A task goes down the lists of a block for an anchor, from the largest
component where the anchor's is positive and from the smallest where it is negative, scores each row it meets for
the first time, and keeps the best rows of each of the anchor's windows of scores, from block to block. No row that
was not met can score more than the threshold, the inner product of the anchor with the components last met; a
block is left once that falls strictly below what every window still asks for, its k-th score or, with fewer rows,
its lower bound. Tasks send their best rows of each window only, and Spark ranks these.

Two searches follow one another: positives have one window without bounds over the rows of the anchor's label,
negatives a window for each positive over the rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantjobs.llm.common import load, saved, spread
from quantjobs.llm.topk import integer_vectors

#: Rows of a block (with 64 dimensions: 8 MB in a worker).
BLOCK = 8192
#: Bytes and number of anchors in a group, which pass through the driver and are held by each Python worker.
GROUP_BYTES, GROUP_ROWS = 32 << 20, 20_000
LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def with_orders(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, ids, labels, m, orders): blocks of vectors of one length; orders has a list of rows by rising component for each dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(own), rows):
                    part = own.iloc[at : at + rows]
                    m = np.stack(part["v"].to_numpy()).astype("<i8")
                    orders = np.argsort(m, axis=0, kind="stable").T.astype("<i4")
                    yield pd.DataFrame([{"dim": dim, "ids": part["id"].to_numpy(np.int64), "labels": part["label"].to_numpy(np.int64), "m": m.tobytes(), "orders": orders.tobytes()}])

    return vectors.mapInPandas(run, "dim int, ids array<bigint>, labels array<bigint>, m binary, orders binary")


class Best:
    """The k best (score, id) of each window of each anchor so far: higher scores first, then smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), LEAST)
        self.ids = np.full((*low.shape, k), MOST)
        self.found = np.zeros(low.shape, dtype=np.int64)

    def needs(self, i: int) -> np.ndarray:
        """What a row must score at least to enter each window of anchor i; no row can enter an empty window."""
        full = np.where(self.found[i] == self.k, self.scores[i, :, -1], self.low[i])
        return np.where(self.low[i] > self.high[i], MOST, full)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, need in enumerate(self.needs(i)):
            ok = (scores >= need) & (scores <= self.high[i, w])
            if ok.any():
                n = self.found[i, w]
                s, d = np.r_[self.scores[i, w, :n], scores[ok]], np.r_[self.ids[i, w, :n], ids[ok]]
                order = np.lexsort((d, -s))[: self.k]
                n = self.found[i, w] = len(order)
                self.scores[i, w, :n], self.ids[i, w, :n] = s[order], d[order]


def go_down(a: np.ndarray, m: np.ndarray, orders: np.ndarray, allowed: np.ndarray, ids: np.ndarray, best: Best, i: int) -> int:
    """Adds to ``best`` what the block holds for anchor i; returns the number of rows scored. All numbers are exact integers."""
    n, up, down = len(m), np.flatnonzero(a > 0), np.flatnonzero(a < 0)
    seen, depth, step = np.zeros(n, dtype=bool), 0, max(16, n >> 8)
    while depth < n:
        to = min(n, depth + step)
        met = np.zeros(n, dtype=bool)
        met[orders[up, n - to : n - depth].ravel()] = True
        met[orders[down, depth:to].ravel()] = True
        if not len(up) and not len(down):
            met[:] = True  # an anchor of zeros: all score 0
        met &= ~seen
        seen |= met
        rows = np.flatnonzero(met & allowed)
        if len(rows):
            best.add(i, (m[rows] @ a).astype(np.int64), ids[rows])
        if seen.all():
            break
        threshold = int(a[up] @ m[orders[up, n - to], up]) + int(a[down] @ m[orders[down, to - 1], down])
        if (threshold < best.needs(i)).all():
            break
        depth, step = to, step * 2
    return int(seen.sum())


def searched(rows: DataFrame, anchors: dict, same_label: bool, k: int) -> DataFrame:
    """(anchor_id, window, score, id): the k best of every window, of each task. ``anchors`` by dim: ids, labels, vectors, low, high."""
    shipped = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, Best] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.dim not in shipped.value:
                    continue
                names, labels, vectors, low, high = shipped.value[r.dim]
                best = state.setdefault(r.dim, Best(low, high, k))
                m = np.frombuffer(r.m, "<i8").reshape(-1, r.dim)
                orders = np.frombuffer(r.orders, "<i4").reshape(r.dim, -1)
                ids, own = np.asarray(r.ids), np.asarray(r.labels)
                reach = float(np.abs(m).max()) * float(np.abs(vectors).max()) * r.dim
                kind = np.float64 if reach < 2**53 else np.int64  # floating point only where it cannot round
                m = m.astype(kind)
                for i, a in enumerate(vectors):
                    go_down(a.astype(kind), m, orders, ((own == labels[i]) == same_label) & (ids != names[i]), ids, best, i)
        for dim, best in state.items():
            i, w, j = np.nonzero(np.arange(k) < best.found[:, :, None])
            yield pd.DataFrame({"anchor_id": shipped.value[dim][0][i], "window": w.astype(np.int32), "score": best.scores[i, w, j], "id": best.ids[i, w, j]})

    return rows.mapInPandas(run, "anchor_id bigint, window int, score bigint, id bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best over all tasks, with their rank from 1."""
    place = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, group_rows: int = GROUP_ROWS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    ``is_anchor`` is a condition on the column id. Scores are inner products of floor(``scale`` * x). An anchor's
    positives are the ``positives`` best other rows of its label; the negatives of a positive are the ``k`` best
    rows of other labels that score from ``low`` to ``high`` percent of the positive, ends included. Ties go to the
    smaller id; where there are fewer, all count. Rows with a null id, label or vector, or a null or non-finite
    component, take no part; vectors of another length than the anchor's are no candidates of it; empty vectors
    are left out. Of rows that repeat an anchor's id the least by label, then vector, is the anchor; none of them is
    its candidate, and each is a candidate of the others. Other columns are not read. Labels are integers.
    """
    spark = df.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    labelled = df.where(F.col(label_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.col(label_col).cast("bigint").alias("label")).alias("key"), F.col(vec_col).alias("vec"))
    vectors = saved(integer_vectors(labelled.where("key.id IS NOT NULL"), "key", "vec", scale).where(F.size("v") > 0).select("id.id", "id.label", "v"), "vectors")
    rows = saved(with_orders(spread(vectors), block), "blocks")
    asked = vectors.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    facts = asked.agg(F.sum(F.size("v") * 8), F.count("*")).first()
    if not facts[1]:
        return spark.createDataFrame([], out)
    groups = max(-(-facts[0] // GROUP_BYTES), -(-facts[1] // group_rows))
    asked = saved(asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))), "anchors")
    found = None
    for group in range(groups):
        own = asked.where(F.col("group") == group).toPandas()  # GROUP_BYTES or little more
        if not len(own):
            continue
        anchors = {dim: (p["id"].to_numpy(np.int64), p["label"].to_numpy(np.int64), np.stack(p["v"].to_numpy()).astype(np.int64)) for dim, p in own.groupby(own["v"].map(len))}
        open_ = {dim: (*a, np.full((len(a[0]), 1), LEAST), np.full((len(a[0]), 1), MOST)) for dim, a in anchors.items()}
        best = saved(ranked(searched(rows, open_, True, positives), positives).select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        near = best.toPandas()  # at most `positives` rows an anchor of the group
        asked_windows = {}
        for dim, (names, labels, m) in anchors.items():
            lows, highs = np.full((len(names), positives), MOST), np.full((len(names), positives), LEAST)  # empty
            order = np.argsort(names)
            at = np.searchsorted(names[order], near["anchor_id"].to_numpy())
            mine = np.flatnonzero(names[order][np.minimum(at, len(names) - 1)] == near["anchor_id"].to_numpy())
            i, w, s = order[at[mine]], near["window"].to_numpy()[mine], near["positive_score"].to_numpy()[mine]
            lows[i, w], highs[i, w] = -((-low * s) // 100), high * s // 100
            asked_windows[dim] = (names, labels, m, lows, highs)
        hard = ranked(searched(rows, asked_windows, False, k), k).join(best, ["anchor_id", "window"])
        hard = saved(hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        found = hard if found is None else found.unionByName(hard)
    return found


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over the whole embeddings table; a label moves on where 7 divides vec_id."""
    rows = load(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
