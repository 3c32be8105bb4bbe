"""Exact top-k search by distributed histogram selection.

Queries go to the candidates in groups of a bounded size, so that candidates never move: each pass scores a
group against all blocks of candidates where they lie. A pass counts the scores of a query in the bins of
its current interval, locates the bin of the k-th highest score, and makes that bin the next interval, until
it is one value wide. A last pass emits the scores above that value, and as many ties, by ascending id, as
are still wanted. A task sends only counts from its own k-th score upwards, as lower ones cannot hold the
global one. Candidates are read once a pass and group, which is the least that an exact search of stated
queries against all rows can do with bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantjobs.llm.common import load, saved, spread

BLOCK, BINS = 2048, 4096
#: Bytes and number of query vectors in a group, which pass through the driver and are held by each Python worker.
GROUP_BYTES, GROUP_ROWS = 32 << 20, 50_000
#: Queries scored at once against a block, which bounds a worker's score matrix to 8 * SLICE * BLOCK bytes (16 MB).
SLICE = 1000


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x), x as double; vectors that are null or hold a null or non-finite number are left out."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & F.col("id").isNotNull() & ~bad).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def blocked(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, size, ids, m): vectors of one length packed to blocks of at most ``rows``; m is a row-major matrix of 4 or 8 byte integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(own), rows):
                    part = own.iloc[at : at + rows]
                    m = np.stack(part["v"].to_numpy()).astype(np.int64)
                    size = 4 if np.abs(m).max() < 2**31 else 8
                    yield pd.DataFrame([{"dim": dim, "size": size, "ids": part["id"].to_numpy(dtype=np.int64), "m": m.astype(f"<i{size}").tobytes()}])

    return vectors.mapInPandas(run, "dim int, size int, ids array<bigint>, m binary")


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point only where it cannot round."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def unpacked(block: bytes, dim: int, size: int) -> np.ndarray:
    return np.frombuffer(block, dtype=f"<i{size}").astype(np.int64).reshape(-1, dim)


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, bins: int = BINS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k highest scores of each query row against all rows but its own.

    ``is_query`` is a condition on the column id. Ties go to the smaller id; with fewer than k candidates
    all are returned. Vectors of another length than the query's are no candidates of it; empty vectors
    score nothing and are left out. Rows that repeat an id are each a candidate of other ids, and a query once.
    """
    vectors = saved(integer_vectors(df, id_col, vec_col, scale).where(F.size("v") > 0), "vectors")
    rows = saved(blocked(spread(vectors), BLOCK), "blocks")
    asked = vectors.where(is_query).dropDuplicates(["id"])
    facts = asked.agg(F.sum(F.size("v") * 8), F.count("*")).first()
    # Bounds of each query's scores from the largest length of a row.
    longest = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).first()[0]
    if not facts[1]:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    groups = max(-(-facts[0] // group_bytes), -(-facts[1] // GROUP_ROWS))
    asked = saved(asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))), "queries")
    found = None
    for group in range(groups):
        best = _of_group(rows, asked.where(F.col("group") == group), longest, k, bins)
        if best is not None:
            found = best if found is None else found.unionByName(best)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def sliced(queries: tuple, limits: tuple, r) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, scores, own, low, width) of a block of candidates, ``SLICE`` queries at a time; a query's own row is marked."""
    (names, m), (low, width) = queries, limits
    rows, ids = unpacked(r.m, r.dim, r.size), np.asarray(r.ids)
    for at in range(0, len(names), SLICE):
        part = slice(at, at + SLICE)
        yield np.arange(at, min(at + SLICE, len(names))), scores(m[part], rows), names[part, None] == ids[None, :], low[part], width[part]


def highest(pair: np.ndarray, n: np.ndarray, bins: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by (query, bin), sorted, without the bins that have k or more scores above them; at most k bins of a query stay."""
    pair, n = pair[::-1], n[::-1]
    query = pair // (bins + 1)
    before = np.cumsum(n) - n
    first = np.r_[True, query[1:] != query[:-1]][: len(query)]
    keep = before - before[first][np.cumsum(first) - 1] < k
    return pair[keep][::-1], n[keep][::-1]


def counted(blocks: Iterator, queries: dict, limits: dict, bins: int, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dim: (place of query * (bins + 1) + bin, count) of the scores that may be among the k highest."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in blocks:
        if r.dim not in queries:
            continue
        new = [total[r.dim]] if r.dim in total else []
        for place, s, own, low, width in sliced(queries[r.dim], limits[r.dim], r):
            s -= low[:, None]
            s //= (-(-width // bins))[:, None]
            np.minimum(s, bins, out=s)  # above the interval: counted as its own bin
            s[own | (s < 0)] = -1
            kth = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - kth, axis=1)[:, s.shape[1] - kth]
            i, j = np.nonzero((s >= least[:, None]) & (s >= 0))
            new.append(np.unique(place[i] * np.int64(bins + 1) + s[i, j], return_counts=True))
        pair, at = np.unique(np.concatenate([x[0] for x in new]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([x[1] for x in new])).astype(np.int64)
        total[r.dim] = highest(pair, n, bins, k)
    return total


def _of_group(rows: DataFrame, asked: DataFrame, longest: float, k: int, bins: int) -> DataFrame | None:
    """(query_id, id, score): for one group of queries, all that may be among the k highest."""
    own = asked.select("id", "v").toPandas().sort_values("id")  # GROUP_BYTES or little more
    if not len(own):
        return None
    queries = {dim: (part["id"].to_numpy(dtype=np.int64), np.stack(part["v"].to_numpy()).astype(np.int64)) for dim, part in own.groupby(own["v"].map(len))}
    reach = {dim: np.minimum(np.ceil(np.sqrt((m.astype(np.float64) ** 2).sum(1) * longest) * (1 + 1e-9)) + 1, 2.0**62).astype(np.int64) for dim, (_, m) in queries.items()}
    limits = {dim: (-r, 2 * r + 1) for dim, r in reach.items()}
    context = rows.sparkSession.sparkContext
    shipped = context.broadcast(queries)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator:
        for pdf in batches:
            yield from pdf.itertuples(index=False)

    def counts(sent):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for dim, (pair, n) in counted(blocks(batches), shipped.value, sent.value, bins, k).items():
                yield pd.DataFrame({"q": shipped.value[dim][0][pair // (bins + 1)], "b": (pair % (bins + 1)).astype(np.int32), "n": n})

        return run

    def emit(sent):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for r in blocks(batches):
                if r.dim not in shipped.value:
                    continue
                names, ids = shipped.value[r.dim][0], np.asarray(r.ids)
                for place, s, own, low, _ in sliced(shipped.value[r.dim], sent.value[r.dim], r):
                    i, j = np.nonzero((s >= low[:, None]) & ~own)
                    order = np.lexsort((ids[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)  # place among the block's candidates of the query
                    i, j = i[nth < k], j[nth < k]
                    yield pd.DataFrame({"query_id": names[place[i]], "id": ids[j], "score": s[i, j]})

        return run

    while max(w.max() for _, w in limits.values()) > 1:
        seen = rows.mapInPandas(counts(context.broadcast(limits)), "q bigint, b int, n bigint").groupBy("q", "b").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("b")))  # at most bins + 1 rows a query
        hit = seen.withColumn("above", above).where(F.col("above") >= k).groupBy("q").agg(F.max("b").alias("b")).toPandas().sort_values("q")
        found_q, found_b = hit["q"].to_numpy(dtype=np.int64), hit["b"].to_numpy(dtype=np.int64)
        for dim, (low, width) in limits.items():
            names = queries[dim][0]
            at = np.minimum(np.searchsorted(found_q, names), max(0, len(found_q) - 1))
            full = found_q[at] == names if len(found_q) else np.zeros(len(names), dtype=bool)
            step = -(-width // bins)
            # Fewer than k candidates: all of them count.
            limits[dim] = np.where(full, low + (found_b[at] if len(found_b) else 0) * step, low), np.where(full, step, 1)
    return saved(rows.mapInPandas(emit(context.broadcast(limits)), "query_id bigint, id bigint, score bigint"), "best")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4 over the whole embeddings table.

    Vectors that are null, empty, or hold a null or non-finite component take no part; a query meets candidates of its
    own length; fewer than five candidates are all returned, and an empty table gives no rows.
    """
    found = top_k(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
