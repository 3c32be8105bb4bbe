"""Byte-level BPE with a two-tier lookup: a minimal perfect hash for whole pre-tokens, heap merges for the rest.

Pre-tokens that are in the vocabulary are found by a hash-and-displace minimal perfect hash (one slot
per vocabulary entry, one comparison). Other pre-tokens are merged bottom up: a heap of candidate pairs
over a doubly linked list of byte pieces, lowest rank first, leftmost first among equals.

Texts are cut only before a space that follows a non-space, where no pre-token of the pattern can
cross, so that repeated pieces are resolved once per worker and then reused from a bounded memo.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import load, small_batches, with_columns_of, without

#: Bounds of a worker's memos: entries of each, and characters of a key.
MEMO_ENTRIES, MEMO_CHARS = 600_000, 48


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id; the file has one ``base64 id`` pair a line."""
    pairs = []
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                pairs.append((int(rank), base64.b64decode(token)))
    tokens = [b""] * (max(rank for rank, _ in pairs) + 1)
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


class PerfectHash:
    """Minimal perfect hash from byte strings to ids: each bucket of keys has a displacement seed."""

    def __init__(self, tokens: list[bytes]) -> None:
        keys = [(t, i) for i, t in enumerate(tokens) if t]
        self.n = max(1, len(keys))
        self.n_buckets = max(1, self.n // 3)
        buckets: list[list[tuple[bytes, int]]] = [[] for _ in range(self.n_buckets)]
        for t, i in keys:
            buckets[xxhash.xxh3_64_intdigest(t) % self.n_buckets].append((t, i))
        self.seeds = np.zeros(self.n_buckets, dtype=np.int64)
        self.slots: list[tuple[bytes, int] | None] = [None] * self.n
        free: list[int] | None = None
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # a lone key may take any free slot: its seed names the slot itself
                if free is None:
                    free = [s for s in range(self.n) if self.slots[s] is None]
                slot = free.pop()
                self.seeds[b], self.slots[slot] = -slot - 1, own[0]
                continue
            seed = 1
            while True:
                at = {xxhash.xxh3_64_intdigest(t, seed) % self.n for t, _ in own}
                if len(at) == len(own) and all(self.slots[s] is None for s in at):
                    break
                seed += 1
            self.seeds[b] = seed
            for t, i in own:
                self.slots[xxhash.xxh3_64_intdigest(t, seed) % self.n] = (t, i)
        self.seeds = self.seeds.tolist()

    def get(self, token: bytes) -> int:
        """The token's id, -1 if it isn't a key."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(token) % self.n_buckets]
        found = self.slots[-seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(token, seed) % self.n]
        return found[1] if found is not None and found[0] == token else -1


def heap_merge(piece: bytes, rank_of: Callable[[bytes], int | None]) -> list[int]:
    """Ids of one pre-token: lowest-ranked adjacent pair first, leftmost among equals."""
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := rank_of(joined := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, joined))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != len(joined) or parts[i] + parts[j] != joined:
            continue  # one side was merged meanwhile
        parts[i], parts[j] = joined, b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [rank_of(p) for p in parts if p]


class Memo(dict):
    """A bounded memo of ``make``. Full, it takes nothing new until it has missed ten times its size."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.misses = make, 0

    def __missing__(self, key: str) -> bytes | None:
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) < MEMO_ENTRIES:
                self[key] = value
            else:
                self.misses += 1
                if self.misses > 10 * MEMO_ENTRIES:
                    self.clear()
                    self.misses = 0
        return value


class Codec:
    """Encoder and decoder of one rank file, built once per Python worker."""

    def __init__(self, table: PerfectHash, pattern: str) -> None:
        self.table = table
        self.rank_of = {slot[0]: slot[1] for slot in table.slots if slot}.get
        self.split = regex.compile(pattern).findall

        self.known = Memo(self.pre_token)

    def pre_token(self, text: str) -> bytes:
        piece = text.encode("utf-8")
        whole = self.table.get(piece)
        ids = [whole] if whole >= 0 else heap_merge(piece, self.rank_of)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def piece(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text whose ends are pre-token boundaries."""
        return b"".join(map(self.known.__getitem__, self.split(text)))


def spaced(encode: Callable[[str], bytes]) -> Memo:
    """Ids of ``" " + chunk`` by chunk; None where the cut beside the chunk would not be safe."""
    return Memo(lambda chunk: encode(" " + chunk) if chunk and not chunk[-1].isspace() else None)


SAFE_CUT = regex.compile(r"(?<=\S)(?= )")


def encode_text(text: str, memo: Memo, encode: Callable[[str], bytes]) -> bytes:
    """Ids of a whole text. Cuts lie before spaces that follow a non-space."""
    first, *chunks = text.split(" ")
    if first and not first[-1].isspace():
        try:
            return encode(first) + b"".join(map(memo.__getitem__, chunks))
        except TypeError:  # runs of white space: cut at safe places only
            pass
    out = []
    for part in SAFE_CUT.split(text):
        ids = memo[part[1:]] if part[:1] == " " else None
        out.append(encode(part) if ids is None else ids)
    return b"".join(out)


_codecs: dict[tuple[str, str], tuple[Codec, Memo]] = {}


@lru_cache(4)
def vocabulary(path: str) -> tuple[list[bytes], PerfectHash]:
    """Tokens and perfect hash of a rank file, made once on the driver."""
    tokens = read_ranks(path)
    return tokens, PerfectHash(tokens)


def codec(table: PerfectHash, path: str, pattern: str) -> tuple[Codec, Memo]:
    """The worker's codec of this vocabulary."""
    if (path, pattern) not in _codecs:
        made = Codec(table, pattern)
        _codecs[path, pattern] = made, spaced(made.piece)
    return _codecs[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of every whole text (array of int).

    Null texts count as empty; empty texts have no ids; repeated rows and all other columns are kept as
    they are, but for one named ``out``, which is replaced. The vocabulary file is read on the driver and shipped with the function (a fixed size).
    """
    small_batches(docs.sparkSession)
    docs = without(docs, out)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path)[1])
    schema = with_columns_of(docs, f"`{out}` array<int>")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, memo = codec(shipped.value, ranks_path, pattern)
        for batch in batches:
            ids = [encode_text(x or "", memo, made.piece) for x in batch.column(at).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for (binary). Null ids give empty bytes."""
    docs = without(docs, out)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path)[0])
    schema = with_columns_of(docs, f"`{out}` binary")
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shipped.value
        for batch in batches:
            col = batch.column(at)
            flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            texts = [b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over the whole documents table."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, P.PATTERN).select("doc_id", "ids")
    return decode(coded, path, P.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
