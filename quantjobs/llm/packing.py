"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents are tokenised, ended by a separator id and cut into pieces only if they are longer than a
sequence. Pieces that fill a sequence are placed at once. The others are dealt by a hash into shards of
about ``shard_items`` pieces, so that no task or group grows with the input; each shard is evolved by
several islands. A solution is the bin number of each piece of the shard. Crossover injects whole
well-filled bins of one parent into the other, drops the other's bins that hold one of the injected
pieces (and its emptiest ones), and best-fits the pieces displaced by that. After each epoch every
island's elite moves to the next island; an island rests when
an epoch saved no bin, or where its best meets a lower bound of the number of bins. What lies in
the emptiest bins of the shards is then packed anew, with that of other shards, until one shard is left.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.byte_bpe import encode_text, spaced
from quantjobs.llm.common import load, saved, small_batches, spread, whole_text, with_columns_of, without

CAPACITY, SHARD_ITEMS, ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2048, 4096, 3, 8, 12, 32
#: Share of a shard's bins, its emptiest, whose pieces are packed anew with those of other shards.
REST = 0.05
# Fixed value: the pattern of byte-level pre-tokenisation.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_coders: dict = {}


def coder(file: str):
    """text -> little-endian 32-bit ids of a byte-level tokenizers file; its added tokens are looked for first.

    Where ids follow the order of the merges, which is checked, they are the ranks of the same merges, and
    tiktoken finds them several times as fast; else the tokenizers library is used.
    """
    data = json.loads(file)
    model, step = data["model"], data.get("pre_tokenizer") or {}
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    plain = data.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not model.get("ignore_merges")
    extra = data.get("added_tokens") or []
    if plain and made == sorted(made) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in extra):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"]: t["id"] for t in extra}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
        own = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)

        def encode(x: str) -> bytes:
            held = any(t in x for t in added)
            return np.asarray(own.encode(x, allowed_special="all") if held else own.encode_ordinary(x), dtype="<u4").tobytes()

        return encode
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(file)
    return lambda x: np.asarray(library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", with_ids: bool = True, along: str | None = None) -> DataFrame:
    """One row per piece: the input's columns without the text, and piece, start, length, ids_crc32 and ids.

    Ids are those of the tokenizers file without added special tokens, then ``end_id``; special tokens that
    stand in the text are encoded as that library does. The checksum is of little-endian unsigned 32-bit ids;
    ``with_ids`` False leaves the ids themselves out. A document longer than ``capacity`` is cut into full pieces
    behind a first piece that takes what is left. Null and empty texts give the end id alone. Repeated rows give
    repeated pieces. ``along`` names an array column with one element for each piece of its document; every piece gets
    its own. Input columns of the new names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "piece", "start", "length", "ids_crc32", "ids")
    with open(tokenizer_path, encoding="utf-8") as file:
        shipped = spark.sparkContext.broadcast(file.read())
    rest = docs.drop(text, *[along] * bool(along))
    new = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + [along] * bool(along)
    own = f", `{along}` {docs.schema[along].dataType.elementType.simpleString()}" if along else ""
    schema = with_columns_of(rest, "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + own)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = zlib.crc32(shipped.value.encode()), len(shipped.value)
        if name not in _coders:
            make = coder(shipped.value)
            _coders[name] = spaced(make), make
        memo, make = _coders[name]
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc, flat = [], [], [], [], [], []
            for i, x in enumerate(batch.column(at).to_pylist()):
                whole = encode_text(x or "", memo, make) + end
                n = len(whole) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(whole[4 * a : 4 * b]))
                if with_ids:
                    flat.append(whole)
            kept = batch.drop_columns([text, *[along] * bool(along)]).take(pa.array(row, pa.int64()))
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                ids = pa.Array.from_buffers(pa.int32(), sum(length), [None, pa.py_buffer(b"".join(flat))])
                made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), ids))
            if along:
                lists = batch.column(along)
                if lists.value_lengths().to_pylist() != np.bincount(np.array(row, dtype=np.int64), minlength=len(lists)).tolist():
                    raise ValueError(f"{along} must hold one element for each piece")
                made.append(lists.flatten())
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *new])

    return docs.mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: large pieces meet no equals, and what is too large to join them has only the rest's room."""
    sizes = np.sort(np.asarray(lengths, dtype=np.int64))
    total = np.r_[0, np.cumsum(sizes)]
    best = -(-int(total[-1]) // capacity)
    half = np.searchsorted(sizes, capacity // 2, "right")  # from here on larger than half a bin
    for k in np.unique(np.r_[0, sizes[:half]]):
        alone = np.searchsorted(sizes, capacity - k, "right")
        low = np.searchsorted(sizes, k, "left")
        need = (total[half] - total[low]) - ((alone - half) * capacity - (total[alone] - total[half]))
        best = max(best, len(sizes) - half + max(0, -(-int(need) // capacity)))
    return best


def best_fit(lengths: np.ndarray, order, bins: np.ndarray, room: list[int], n: int, capacity: int) -> int:
    """Puts the items of ``order`` into the fullest open bin that takes them. room: sorted ``free << 20 | bin``."""
    for i in order:
        size = int(lengths[i])
        at = bisect_left(room, size << 20)
        if at < len(room):
            found = room.pop(at)
            free, b = (found >> 20) - size, found & 0xFFFFF
        else:
            free, b, n = capacity - size, n, n + 1
        bins[i] = b
        if free:
            insort(room, free << 20 | b)
    return n


def pack_once(lengths: np.ndarray, order, capacity: int) -> np.ndarray:
    bins = np.full(len(lengths), -1, dtype=np.int32)
    best_fit(lengths, order, bins, [], 0, capacity)
    return bins


def cross(into: np.ndarray, source: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child of two solutions: whole well-filled bins of ``source`` injected into ``into``."""
    fill = np.bincount(source, weights=lengths)
    good = np.flatnonzero(fill >= capacity - rng.integers(0, max(1, capacity // 64) + 1))
    good = good[rng.random(len(good)) < rng.uniform(0.1, 0.9)]
    injected = np.isin(source, good)
    emptiest = np.argsort(np.bincount(into, weights=lengths), kind="stable")[: rng.integers(1, 5)]
    hit = np.union1d(into[injected], emptiest)  # bins that hold a piece twice now, and the emptiest
    loose = np.flatnonzero(np.isin(into, hit) & ~injected)
    kept = ~np.isin(into, hit)
    bins = np.full(len(lengths), -1, dtype=np.int64)
    bins[kept] = into[kept]
    bins[injected] = source[injected] + into.max() + 1
    placed = bins >= 0
    _, bins[placed] = np.unique(bins[placed], return_inverse=True)
    n = int(bins.max()) + 1 if placed.any() else 0
    free = capacity - np.bincount(bins[placed], weights=lengths[placed], minlength=n).astype(np.int64)
    room = sorted(int(f) << 20 | b for b, f in enumerate(free) if f > 0)
    best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], bins, room, n, capacity)
    return bins.astype(np.int32)


def merit(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller full ones."""
    return int(bins.max()) + 1 if len(bins) else 0, -float((np.bincount(bins, weights=lengths) ** 2).sum()) if len(bins) else 0.0


def evolve(lengths: np.ndarray, population: list[np.ndarray], seed: int, capacity: int, size: int, offspring: int) -> list[np.ndarray]:
    """One epoch of an island, best solution first; it stops at the lower bound of the number of bins."""
    rng, least = np.random.default_rng(seed), lower_bound(lengths, capacity)
    if not population:
        population = [pack_once(lengths, np.argsort(-lengths, kind="stable"), capacity)]
    while len(population) < size and merit(population[0], lengths)[0] > least:
        noisy = np.argsort(-lengths * rng.uniform(rng.uniform(0.5, 1.0), 1.0, len(lengths)), kind="stable")
        population.append(pack_once(lengths, noisy, capacity))
    population.sort(key=lambda x: merit(x, lengths))
    for _ in range(offspring):
        if merit(population[0], lengths)[0] <= least or len(population) < 2:
            break
        a, b = sorted(rng.choice(len(population), (2, 2), replace=False).min(1))  # the better of two each
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        population.append(cross(population[a], population[b], lengths, capacity, rng))
        population = sorted(population, key=lambda x: merit(x, lengths))[:size]
    return population


STATE = "shard int, island int, key array<bigint>, length array<int>, population array<array<int>>, open boolean"


def evolved(items: DataFrame, n_shards: int, capacity: int, islands: int, epochs: int, size: int, offspring: int) -> DataFrame:
    """(shard, key, length, best) of (_key, _length): every shard's best solution after the islands' epochs."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_length", "_key"], ascending=[False, True])
        sizes, key = pdf["_length"].to_numpy(), pdf["_key"].to_numpy()
        return pd.DataFrame([{"shard": pdf["_shard"].iloc[0], "island": i, "key": key, "length": sizes, "population": [], "open": True} for i in range(islands)])

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    lengths = np.asarray(r.length, dtype=np.int64)
                    start = [np.asarray(x, dtype=np.int32) for x in r.population]
                    if getattr(r, "migrant", None) is not None:
                        start.append(np.asarray(r.migrant, dtype=np.int32))
                    seed = (int(r.shard) * 1_000_003 + int(r.island) * 1009 + number) % 2**32
                    before = int(min(x.max() for x in start)) + 1 if start else None
                    best = evolve(lengths, start, seed, capacity, size, offspring) if number == 0 or r.open else start
                    now = int(best[0].max()) + 1
                    more = now > lower_bound(lengths, capacity) and (before is None or now < before)
                    out.append({"shard": r.shard, "island": r.island, "key": r.key, "length": r.length, "population": best, "open": more})
                yield pd.DataFrame(out, columns=["shard", "island", "key", "length", "population", "open"])

        return run

    # Packed by best fit, a shard at its bound is done; only the others go to the islands.
    dealt = items.withColumn("_shard", F.pmod(F.xxhash64("_key", F.lit(n_shards)), F.lit(n_shards)).cast("int"))
    state = spread(dealt, "_shard").groupBy("_shard").applyInPandas(gather, STATE)
    state = saved(spread(state, "shard", "island").mapInPandas(epoch(0), STATE), "islands")
    for number in range(1, epochs):
        if not state.where("open").take(1):
            break
        elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.element_at("population", 1).alias("migrant"))
        state = saved(state.join(elite, ["shard", "island"]).mapInPandas(epoch(number), STATE), "islands")
    n_bins = F.array_max(F.element_at("population", 1))
    return state.groupBy("shard").agg(F.min_by(F.struct("key", "length", F.element_at("population", 1).alias("best")), F.struct(n_bins, "island")).alias("s")).select("shard", "s.*")


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, offspring: int = OFFSPRING) -> DataFrame:
    """Adds sequence_id and offset to every piece; the pieces of a sequence lie there without gaps.

    Null lengths count as 0; a piece longer than ``capacity`` is an error. Repeated pieces are packed
    each on its own; which piece of a length goes where depends on the order in which they are read. An empty
    table gives an empty result. Input columns of the new names are replaced.
    """
    pieces = without(pieces, "sequence_id", "offset", "_key")
    numbered = saved(pieces.withColumn("_key", F.monotonically_increasing_id()), "pieces")  # written once, so that keys stay
    items = numbered.select("_key", F.coalesce(F.col(length), F.lit(0)).cast("int").alias("_length"))
    if items.where(F.col("_length") > capacity).take(1):
        raise ValueError("a piece is longer than a sequence")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each piece's place in its bin, named by its shard, and whether the bin is among the emptiest."""
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                bins, sizes = np.asarray(r.best, dtype=np.int64), np.asarray(r.length, dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.r_[True, np.diff(bins[order]) > 0]
                begin = np.maximum.accumulate(np.where(first, ends - sizes[order], -1))
                fill = np.bincount(bins, weights=sizes)
                rest = np.argsort(fill, kind="stable")[: max(2, int(len(fill) * REST))]
                yield pd.DataFrame({"_key": np.asarray(r.key)[order], "_length": sizes[order].astype(np.int32), "sequence_id": (np.int64(r.shard) << 16) + bins[order], "offset": ends - sizes[order] - begin, "rest": np.isin(bins[order], rest[fill[rest] < capacity])})

    full = items.where(F.col("_length") == capacity)
    done = full.select("_key", (-1 - F.col("_key")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left, level, n = items.where(F.col("_length") < capacity), 0, None
    while True:
        count = left.count()
        n_shards = max(1, -(-count // shard_items))
        packed = saved(evolved(left, n_shards, capacity, islands, epochs, population, offspring).mapInPandas(place, "_key bigint, _length int, sequence_id bigint, offset bigint, rest boolean"), "packed")
        last = n_shards == 1 or (n is not None and count > n // 2)  # little is left, or it hardly gets less
        mine = packed if last else packed.where("not rest")
        done = done.unionByName(mine.select("_key", (F.col("sequence_id") + ((level + 1) << 56)).alias("sequence_id"), "offset"))
        if last:
            break
        left, n, level = packed.where("rest").select("_key", "_length"), count, level + 1
    return numbered.join(done, "_key").drop("_key")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over the whole documents table."""
    return pack_documents(load(spark, sf_dir, "documents"), with_ids=False)


def pack_documents(docs: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every piece of the documents with its place in a sequence, and its token ids.

    Pieces are packed without their ids. Texts then move once to the places of their pieces, and are tokenised again
    there: they are less than their ids, which are neither written nor shuffled. With ids ``docs`` is read twice and
    should be a table.
    """
    import public_tokenizers as P

    path, names = P.path("byte_bpe_50k.json"), ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = docs.select("doc_id", "text")
    if not with_ids:
        return pack(tokenise(rows, path, with_ids=False)).select(names)
    same = F.concat(F.md5(whole_text()), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))  # rows alike in both columns
    rows = rows.withColumn("_same", same)
    light = tokenise(rows.withColumn("_row", F.monotonically_increasing_id()), path, with_ids=False)  # pack() writes it, so that numbers stay
    places = F.array_sort(F.collect_list(F.struct("piece", "sequence_id", "offset"))).alias("_place")
    placed = pack(light.select("doc_id", "_same", "_row", "piece", "length")).groupBy("_row", "_same", "doc_id").agg(places)
    texts = rows.groupBy("_same").agg(F.first("text").alias("text"))
    out = tokenise(placed.join(texts, "_same").select("doc_id", "text", "_place"), path, along="_place")
    return out.select(*names[:5], "_place.sequence_id", "_place.offset", "ids")
