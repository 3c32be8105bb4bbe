"""Near-duplicate detection by MinHash with tensored banding, verified on whole shingle sets.

Two collections of ``halves`` short minhash tuples are computed for each document. Table (i, j) is
keyed by tuple i of the first collection and tuple j of the second, so ``halves ** 2`` tables need only
``2 * halves`` tuples. With 8 halves of 2 rows a pair at similarity 0.85 misses all tables with
probability 7e-5, a pair at 0.8 with 6e-4.

Documents with equal sets collapse first. In every bucket the densest member (the one with the most
table mates) is the centre. In each of a few rounds a document is compared with the centre of another
component that it shares most buckets with, so that a hot group costs one pair a member and round, not
all pairs. What those links leave apart in a bucket is then compared across components, all of it. A
pair reaches the exact comparison only if at least half of its 32 minhashes agree (a pair at 0.8 fails
that with probability below 1e-4).

Shingle sets are computed once more, and kept, for those documents only that share a bucket. Tables that a
hot key may skew are joined with materialised small sides, so that Spark may split its partitions; a
centre's set is copied once for so many members, and a large bucket is compared in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import finished, load, saved, small_batches
from quantjobs.llm.graph import components

#: Members of a centre that one copy of its set serves; documents of a bucket's block in the last comparison.
MEMBERS, BLOCK = 2000, 500
#: One-bit minhashes of the documents that are compared across components.
BITS = 2048
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers stirred."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of the whole sequence if it is shorter."""
    found = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), dtype=np.uint64)
    for k in range(min(words, len(h))):
        out = out * BASE + h[k : k + n]
    return np.unique(mixed(out))


class Sketch:
    """Minhashes of many sets at once."""

    def __init__(self, halves: int, rows: int) -> None:
        rng = np.random.default_rng(20_23)
        self.halves, self.rows, n = halves, rows, 2 * halves * rows
        self.flip = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.times = rng.integers(0, 2**63, n, dtype=np.uint64) | np.uint64(1)

    def __call__(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(minhashes, tuples of both collections, table keys), a row for each non-empty set."""
        least = np.empty((len(starts), len(self.flip)), dtype=np.uint64)
        for k, (flip, times) in enumerate(zip(self.flip, self.times, strict=True)):
            x = (flat ^ flip) * times
            least[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
        tuples = np.zeros((len(starts), 2 * self.halves), dtype=np.uint64)
        for k in range(self.rows):
            tuples = mixed(tuples * BASE + least[:, k :: self.rows])
        first, second = tuples[:, : self.halves, None], tuples[:, None, self.halves :]
        tables = np.arange(self.halves**2, dtype=np.uint64).reshape(1, self.halves, self.halves)
        return least, tuples, mixed(first * BASE + second + tables).reshape(len(starts), -1)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, halves: int, rows: int) -> DataFrame:
    """id, n_shingles, set_hash (null without words), sig, tuples array<int>, keys array<bigint> of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = Sketch(halves, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            sig, two, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if len(full):
                starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
                least, tuples, tables = sketch(np.concatenate([sets[i] for i in full]), starts)
                least, tuples = ((x & np.uint64(0x7FFFFFFF)).astype(np.int32) for x in (least, tuples))
                for at, i in enumerate(full):
                    sig[i], two[i], keys[i] = least[at], tuples[at], tables[at].view(np.int64)
            names = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(names, pa.string()), pa.array(sig, pa.list_(pa.int32())), pa.array(two, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "set_hash", "sig", "tuples", "keys"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles bigint, set_hash string, sig array<int>, tuples array<int>, keys array<bigint>")


def agreeing(x: Column, y: Column) -> Column:
    """How many minhashes two signatures share."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def first_table(halves: int) -> Column:
    """Whether table t is the first in which two tuple arrays wa and wb agree: a pair counts there only."""
    spot = [F.array_position(F.zip_with(F.slice("wa", at, halves), F.slice("wb", at, halves), lambda p, q: p == q), True) for at in (1, halves + 1)]
    return F.col("t") == (spot[0] - 1) * halves + spot[1] - 1


def close_bits(times: tuple[int, int]) -> Column:
    """Whether one-bit minhashes ba and bb are as close as those of a linked pair, up to 4.2 deviations."""
    p = (1 - times[1] / times[0]) / 2
    most = int(BITS * p + 4.2 * (BITS * p * (1 - p)) ** 0.5) + 1
    return F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x) <= most


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, s): the whole shingle sets of the documents with the given ids (column id), each set of an id once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, words).view(np.int64) for x in batch.column(1).to_pylist()]
            names = [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "name", "s"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").join(ids, "id", "left_semi")
    return saved(texts.mapInArrow(run, f"id {kind}, name string, s array<bigint>").dropDuplicates(["id", "name"]).select("id", "s"), "sets")


def bit_sketches(sets: DataFrame) -> DataFrame:
    """(id, bits): BITS one-bit minhashes of shingle sets."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20_24)
        flip = rng.integers(0, 2**63, BITS, dtype=np.uint64)
        odd = rng.integers(0, 2**63, BITS, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            out = []
            for x in batch.column(1):
                shingles = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found = np.full(BITS, 2**64 - 1, dtype=np.uint64)
                for at in range(0, len(shingles), 64):
                    np.minimum(found, ((shingles[at : at + 64, None] ^ flip) * odd).min(0), out=found)
                out.append(np.packbits(((mixed(found) >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "bits"])

    return saved(sets.mapInArrow(run, f"id {kind}, bits array<bigint>"), "bits")


def confirmed(pairs: DataFrame, sets: DataFrame, times: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of distinct (member, centre) whose whole sets satisfy ``times[0] * intersection >= times[1] * union``.

    A member's set moves with its pair, a centre's set once for MEMBERS of them.
    """
    pairs = saved(pairs, "pairs")
    copies = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("n"))
    copies = saved(copies, "copies")
    dealt = pairs.join(copies, "centre").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("n")).cast("int")).select("member", "centre", "salt")
    centres = copies.join(sets.withColumnRenamed("id", "centre"), "centre").select("centre", F.col("s").alias("sc"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    both = dealt.join(sets.select(F.col("id").alias("member"), F.col("s").alias("sm")), "member").join(centres, ["centre", "salt"])
    common = F.size(F.array_intersect("sm", "sc"))
    near = both.select("member", "centre", common.alias("i"), (F.size("sm") + F.size("sc") - common).alias("u")).where(F.col("i") * times[0] >= F.col("u") * times[1])
    return saved(near.select(F.least("member", "centre").alias("a"), F.greatest("member", "centre").alias("b")), "links")


def in_blocks(rows: DataFrame, side: str) -> DataFrame:
    """Rows of one side of a comparison within buckets: bi and bj name a pair of blocks of the bucket, bi <= bj.

    ``n`` is the bucket's size. As side "a" a row of block x goes to all (x, j), as side "b" to all (i, x).
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    d = rows.withColumns({"_own": own, "_n": blocks})
    if side == "a":
        return d.withColumn("bi", F.col("_own")).withColumn("bj", F.explode(F.sequence(F.col("_own"), F.col("_n") - 1))).drop("_own", "_n")
    return d.withColumn("bj", F.col("_own")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("_own")))).drop("_own", "_n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, times: tuple[int, int] = (100, 85), halves: int = 8, rows: int = 2, rounds: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked if ``times[0] * intersection >= times[1] * union`` of their shingle sets;
    component_id is the smallest id reachable. Documents without words have no shingles and no links.
    A row whose id is null has a null component and is kept. Rows that repeat an id are one document and
    get one component. ``docs`` is read twice and should be a table. The result is written to the shared folder, and
    the tables of the way there are removed.
    """
    return finished(lambda: _near_duplicates(docs, id_col, text_col, words, times, halves, rows, rounds), "near_duplicates")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, times: tuple[int, int], halves: int, rows: int, rounds: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    rows_ = saved(sketches(docs, id_col, text_col, words, halves, rows), "sketches")
    full = rows_.where("set_hash is not null and id is not null")
    classes = full.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first(F.struct("n_shingles", "sig", "tuples", "keys")).alias("f"))
    nodes = saved(classes.select("set_hash", "rep", "f.*"), "nodes")
    posts = nodes.select("rep", F.posexplode("keys").alias("t", "key"))
    sizes = saved(posts.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1"), "sizes")
    posts = saved(posts.join(sizes, "key"), "posts")
    facts = nodes.select("rep", "n_shingles", "sig")

    def side(name: str) -> DataFrame:
        return facts.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("sig").alias(f"s{name}"))

    def likely(p: str, q: str) -> Column:
        shorter, longer = F.least(f"n{p}", f"n{q}"), F.greatest(f"n{p}", f"n{q}")
        return (shorter * times[0] >= longer * times[1]) & (agreeing(F.col(f"s{p}"), F.col(f"s{q}")) >= halves * rows)

    mass = saved(posts.groupBy("rep").agg(F.sum("mates").alias("mass")), "mass")
    sets = shingle_sets(docs, mass.select(F.col("rep").alias("id")).distinct(), id_col, text_col, words)
    dense = saved(posts.join(mass, "rep").select("key", "t", "rep", "mass"), "dense")
    links = tried = None
    parts = dense.withColumn("part", F.col("rep"))
    for _ in range(rounds):
        centres = saved(parts.groupBy("key").agg(F.max_by(F.struct("rep", "part"), F.struct("mass", -F.col("rep"))).alias("c")), "centres")
        apart = parts.join(centres, "key").where(F.col("part") != F.col("c.part")).groupBy("rep", F.col("c.rep").alias("centre")).agg(F.count("*").alias("shared"))
        if tried is not None:
            apart = apart.join(tried, ["rep", "centre"], "left_anti")
        best = saved(apart.groupBy("rep").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("centre")), "best")
        tried = best if tried is None else tried.unionAll(best)
        pairs = best.select(F.col("rep").alias("a"), F.col("centre").alias("b")).join(side("a"), "a").join(side("b"), "b").where(likely("a", "b"))
        new = confirmed(pairs.select(F.col("a").alias("member"), F.col("b").alias("centre")), sets, times)  # one centre a member
        links = new if links is None else links.unionAll(new)
        found = components(links)
        label = found.select(F.col("node").alias("rep"), "component")
        parts = saved(dense.join(label, "rep", "left").select("key", "t", "rep", "mass", F.coalesce("component", "rep").alias("part")), "parts")

    # What is still apart in a bucket is compared across components.
    mixed_keys = parts.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).where("p <> q").select("key", "n")
    left = saved(parts.join(saved(mixed_keys, "mixed"), "key").select("key", "t", "rep", "part", "n"), "apart")
    bits = bit_sketches(sets.join(left.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    left = left.join(nodes.select("rep", "n_shingles", "sig", "tuples").join(bits.withColumnRenamed("id", "rep"), "rep"), "rep")
    named = [in_blocks(left, x).select("key", "t", "bi", "bj", *[F.col(c).alias(f"{n}{x}") for c, n in (("rep", "r"), ("part", "p"), ("n_shingles", "n"), ("sig", "s"), ("tuples", "w"), ("bits", "b"))]) for x in "ab"]
    once = (F.col("bi") < F.col("bj")) | (F.col("ra") < F.col("rb"))
    across = named[0].join(named[1], ["key", "t", "bi", "bj"]).where((F.col("pa") != F.col("pb")) & once & likely("a", "b") & first_table(halves) & close_bits(times))
    more = confirmed(across.select(F.least("ra", "rb").alias("member"), F.greatest("ra", "rb").alias("centre")).distinct(), sets, times)
    found = components(links.unionAll(more))
    label = nodes.select("set_hash", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("label"))
    own = rows_.select("id", "n_shingles", "set_hash").join(label, "set_hash", "left")
    component = F.coalesce("label", "id")
    return own.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over the whole documents table."""
    return near_duplicates(load(spark, sf_dir, "documents"))
