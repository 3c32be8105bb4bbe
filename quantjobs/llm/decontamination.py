"""Benchmark decontamination by winnowing.

Words are hashed, runs of ``gram`` words are combined to k-gram hashes, and of each window of ``span`` words the
least k-gram hash is kept as its fingerprint. What is kept depends on the window's words
alone, so a span that a document shares with an item is kept in both: no shared span of ``span`` words is missed.
An item of fewer words is one window; its length is looked up with a window of that length.

Documents pass by once. A bit table of the items' fingerprints, of one size whatever the benchmark, sieves theirs
in the tasks; what is left is extended to the window's words and joined with the items' fingerprints and windows,
so that a k-gram which is common on both sides makes no pairs. Hits of a document are merged to spans of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantjobs.llm.common import load, saved, small_batches, with_columns_of

SPAN, GRAM = 10, 5
#: Bits of the sieve (8 MB). More fingerprints fill it further: more rows reach the join, none is lost.
SIEVE_BITS = 26
#: Words hashed at once, which bounds the memory that a very long text takes beside itself.
CHUNK = 1 << 17

#: Bytes of words, A-Z lower-cased; all other bytes become a space. Bytes of characters beyond ASCII belong to words.
WORD_BYTES = np.full(256, 32, dtype=np.uint8)
for _b in [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]:
    WORD_BYTES[_b] = _b
for _b in range(ord("A"), ord("Z") + 1):
    WORD_BYTES[_b] = _b + 32

BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, owner): the words of all texts as ranges of the bytes, and the text each belongs to."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, dtype=np.uint8)[ends[0] : ends[-1]] if body is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    raw = WORD_BYTES[raw]
    word = raw != 32
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a text begins or ends here
    edge[ends] = True
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return raw, start, end, np.searchsorted(ends, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """A hash of each word's bytes, whatever stands around it. ``table`` keeps powers from call to call."""
    at, n = int(start[0]), int(end[-1] - start[0])
    if not table or len(table[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        table[:] = powers(BASE, size), powers(INVERSE, size)
    up, down = table
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(raw[at : at + n] * up[:n], out=sums[1:])
    own = (sums[end - at] - sums[start - at]) * down[start - at]
    if len(up) > 1 << 22:  # an unusually long word; its powers aren't kept
        table.clear()
    return mixed(own + (end - start).astype(np.uint64) * MIX)


def window_fingerprints(words: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The least k-gram hash of every window of ``span`` words, by the window's first word."""
    k = min(span, gram)
    grams = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(BASE) + words[j : j + len(grams)]
    grams = mixed(grams + np.uint64(span))
    least = grams[: len(words) - span + 1]
    for j in range(1, span - k + 1):
        least = np.minimum(least, grams[j : j + len(least)])
    return least


def windows(texts: pa.Array, spans: list[int], gram: int, wanted, table: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, list[bytes]]]:
    """First word counts by text as (None, counts, ...), then (text, start, span, fingerprint, window) of the wanted windows.

    ``wanted(fingerprints, owner, span, counts)`` says which; only their words are put together.
    """
    raw, start, end, owner = split(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    yield None, counts, 0, None, []
    longest = max(spans, default=0)
    for at in range(0, len(start) if longest else 0, CHUNK):
        own = slice(at, min(len(start), at + CHUNK + longest - 1))
        hashes = word_hashes(raw, start[own], end[own], table)
        for span in spans:
            n = min(CHUNK, len(hashes) - span + 1)
            if n <= 0:
                continue
            prints = window_fingerprints(hashes, span, gram)[:n]
            text = owner[at : at + n]
            ok = np.flatnonzero((text == owner[at + span - 1 : at + span - 1 + n]) & wanted(prints, text, span, counts))
            for lot in range(0, len(ok), 1 << 14):
                take = ok[lot : lot + (1 << 14)]
                i = take + at
                body = [b" ".join(raw[a:b].tobytes().split()) for a, b in zip(start[i].tolist(), end[i + span - 1].tolist(), strict=True)]
                yield text[take], i - first[text[take]], span, prints[take], body


COLUMNS = "n_words bigint, start bigint, span int, fp bigint, window binary"


def found_windows(df: DataFrame, spans: list[int], gram: int, sieve) -> DataFrame:
    """A row with n_words for each row of ``df`` (whose last column is its text), and one for each wanted window."""
    schema = with_columns_of(df.select(*df.columns[:-1]), COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, table = sieve(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.columns[:-1]
            for text, place, span, prints, body in windows(batch.columns[-1], spans, gram, wanted, table):
                n = len(place)
                if text is None:
                    none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(place, pa.int64()), *none], names=schema.names)
                elif n:
                    own = [k.take(pa.array(text)) for k in keys]
                    found = [pa.nulls(n, pa.int64()), pa.array(place, pa.int64()), pa.array(np.full(n, span, np.int32)), pa.array(prints.view(np.int64)), pa.array(body, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, *found], names=schema.names)

    return df.mapInArrow(run, schema)


def sieve_of(prints: DataFrame, bits: int = SIEVE_BITS):
    """The bit table of fingerprints ``fp`` as a broadcast array of 64-bit words; at most 2 ** (bits - 6) rows pass through the driver."""
    place = F.shiftrightunsigned("fp", 64 - bits)
    rows = prints.select(F.shiftrightunsigned(place, 6).alias("at"), place.alias("place")).selectExpr("at", "shiftleft(1L, cast(place & 63 AS int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[rows["at"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return prints.sparkSession.sparkContext.broadcast(table)


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, spans, items) of every row of ``docs``: which words lie in windows of ``items``.

    spans: the hit words as (start, end) word offsets, end exclusive, merged; items: ids, as strings in their
    order, of the items with an occurring window. Null and empty texts have no words. Items without words have no
    window; an item of a null id counts for n_hit and is not listed. Repeated items count once. Rows that repeat an
    id keep a row each, judged by their own text; further columns of either table are not read. Without items
    nothing is hit. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def of_items():
        return lambda prints, text, n, counts: np.full(len(prints), n == span) | (counts[text] == n)

    source = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    tests = saved(found_windows(source, list(range(1, span + 1)), gram, of_items).where("n_words IS NULL").select("item", "span", "fp", "window").distinct(), "item_windows")
    spans = sorted(r[0] for r in tests.select("span").distinct().collect())  # `span` rows at most
    shipped = sieve_of(tests)

    def of_docs():
        table, shift = shipped.value, np.uint64(64 - SIEVE_BITS)

        def wanted(prints, text, n, counts):
            place = prints >> shift
            return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

        return wanted

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("string").alias("text"))
    found = saved(found_windows(source, spans, gram, of_docs), "fingerprints")
    known = tests.select("fp", "window").distinct()
    hits = saved(found.where("n_words IS NULL").join(known, ["fp", "window"]).select("id", "version", "start", (F.col("start") + F.col("span")).alias("end"), "fp", "window").distinct(), "hits")

    own = Window.partitionBy("id", "version").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = hits.select("id", "version", "start", "end").withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    merged = begins.withColumn("part", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "version", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    covered = merged.groupBy("id", "version").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.select("id", "version", "fp", "window").distinct().join(tests.select("item", "fp", "window"), ["fp", "window"]).select("id", "version", "item").distinct().groupBy("id", "version").agg(F.sort_array(F.collect_set("item")).alias("items"))

    rows = found.where("n_words IS NOT NULL").select("id", "version", "n_words").unionByName(covered, True).unionByName(named, True)
    one = rows.groupBy("id", "version").agg(F.max("n_words").alias("n_words"), F.count("n_words").cast("int").alias("copies"), F.max("n_hit").alias("n_hit"), F.first("spans", True).alias("spans"), F.first("items", True).alias("items"))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 12: whole documents against the whole benchmark. Null and empty texts: no words, no hit, no items."""
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win), known AS (SELECT DISTINCT n, s FROM win
), occ AS (
  SELECT t.doc_id, i, lens.n, array_to_string(w[i:i + lens.n - 1], ' ') AS s
  FROM t, lens, LATERAL (SELECT unnest(range(1, len(w) - lens.n + 2)) AS i) WHERE len(w) >= lens.n
), hit AS (SELECT doc_id, i, n, s FROM occ JOIN known USING (n, s)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN win USING (n, s)) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
