"""Spelling variants: words within one inserted, deleted or replaced letter, grouped under their most frequent form.

Words meet in buckets by their letters at both ends. A pair of words that differ by one letter agrees in the first
half of the shorter word or in the rest of it, so each word has two buckets for its own length and two for the
length below. A bucket of more than ``BLOCK`` words is halved again in the same way, as often as needed, until all
but one letter is fixed; so no bucket grows with the vocabulary, and each pair meets in one bucket only.

Within a bucket a bit-sliced index holds, for every position and letter, the set of words with that letter there,
as the bits of one integer. A word is compared with all others at once: going along its letters, the sets of words
without an error and with one (at the same place after a replaced letter, one further after an inserted, one back
after a deleted one) are advanced by a few operations on whole sets. Bits stand in the order of falling frequency,
so that the lowest bit of a result is the most frequent near word, and no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import load, saved

#: Words of a bucket at most, unless all letters but one are fixed.
BLOCK = 1024
LEAST_LETTERS, LEAST_COUNT, FACTOR = 5, 3, 2
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, slips: int = 97) -> DataFrame:
    """(word, n): lower-cased runs of letters with their counts over whole texts.

    One of ``slips`` occurrences, by a checksum of id and run, loses a letter first (0: none). Null texts have no words.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, UPPER.lower()), F.lit(RUN.replace("A-Z", "")), F.lit(0))).alias("run"))
    word = F.col("run")
    if slips:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = F.pmod(h, F.length("run").cast("bigint")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(h % slips == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def with_halves(words: DataFrame, size, head, tail) -> DataFrame:
    """Two rows for each: the free letters' first half fixed besides, or the rest of them (size: of the shorter words)."""
    half = F.floor((size - head - tail) / 2).cast("int")
    ways = F.array(F.struct((head + half).alias("head"), tail.alias("tail")), F.struct(head.alias("head"), (size - head - half).alias("tail")))
    split = words.withColumn("way", F.explode(ways)).drop("head", "tail").select("*", "way.head", "way.tail").drop("way")
    return split.withColumn("first", F.substring("word", F.lit(1), F.col("head"))).withColumn("last", F.expr("right(word, tail)"))


KEY = ["size", "head", "tail", "first", "last"]


def buckets(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(size, head, tail, first, last, word, n): every word in all its buckets, none of which has more than ``block`` words unless one letter is free."""
    sized = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    now, done = saved(with_halves(sized, F.col("size"), F.lit(0), F.lit(0)), "buckets"), []
    while True:
        counts = now.groupBy(*KEY).agg(F.count("*").alias("members")).where(F.col("members") > 1)
        counts = saved(counts.withColumn("large", (F.col("members") > block) & (F.col("size") - F.col("head") - F.col("tail") > 1)), "members")
        done.append(now.join(counts.where("NOT large"), KEY, "left_semi"))
        if counts.where("large").isEmpty():
            break
        large = now.join(counts.where("large"), KEY, "left_semi").select("word", "n", "size", "head", "tail")
        now = saved(with_halves(large, F.col("size"), F.col("head"), F.col("tail")), "buckets")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*KEY, "word", "n")


def lengths_of(words: list[str]) -> dict[int, int]:
    sets: dict[int, int] = {}
    for i, w in enumerate(words):
        sets[len(w)] = sets.get(len(w), 0) | 1 << i
    return sets


def index_of(words: list[str], first: int, last: int) -> dict[tuple[int, str], int]:
    """The words with a letter at a position, as bits, for the positions from ``first`` up to ``last``."""
    members: dict[tuple[int, str], list[int]] = {}
    for i, w in enumerate(words):
        for p in range(first, min(last, len(w))):
            members.setdefault((p, w[p]), []).append(i)
    sets = {}
    for key, own in members.items():
        bits = bytearray((own[-1] >> 3) + 1)
        for i in own:
            bits[i >> 3] |= 1 << (i & 7)
        sets[key] = int.from_bytes(bits, "little")
    return sets


def near_sets(words: list[str], size: int, head: int, tail: int) -> Iterator[tuple[int, int]]:
    """(word, its near words as bits) of a bucket, whose words have ``size`` letters or one more and share their ends.

    Pairs of two longer words belong to a bucket of their own size. In a bucket by the last letters, pairs that also
    agree in all letters before these are left to the bucket that fixes the letters before.
    """
    lengths = lengths_of(words)
    short, long = lengths.get(size, 0), lengths.get(size + 1, 0)
    stop = size - tail  # free letters of a shorter word: head up to stop
    sets, every = index_of(words, head, stop + 1), (1 << len(words)) - 1
    get = sets.get
    for i, w in enumerate(words):
        # same: no error; swapped: one, in place; ahead: one letter more than w so far; behind: one less.
        same, swapped, ahead, behind = every, 0, 0, 0
        if len(w) == size:
            for p in range(head, stop):
                c = w[p]
                here, next_ = get((p, c), 0), get((p + 1, c), 0)
                swapped = swapped & here | same & ~here
                ahead = (ahead | same) & next_
                same &= here
            ahead |= same  # the further letter stands after the free ones
            if tail:
                ahead &= ~same
            near = swapped & short | ahead & long
        else:
            if not short:
                continue
            agreed = every
            for p in range(head, stop + 1):
                c = w[p]
                behind = (behind & get((p - 1, c), 0) if p > head else 0) | same
                agreed = same  # with all free letters of a shorter word, at the end
                same &= get((p, c), 0)
            if tail:
                behind &= ~agreed
            near = behind & short
        if near:
            yield i, near


def near_words(buckets_: DataFrame) -> DataFrame:
    """(word, n_near, best (minus its n, word)): how many words are near, and the most frequent of them."""
    n = int(buckets_.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    dealt = buckets_.repartition(n, *KEY).sortWithinPartitions(*KEY, F.desc("n"), "word")
    schema = "word string, n_near bigint, best_n bigint, best string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, out = None, [], [], []

        def close() -> None:
            if key is not None and len(words) > 1:
                for i, near in near_sets(words, *key[:3]):
                    best = (near & -near).bit_length() - 1
                    out.append((words[i], near.bit_count(), counts[best], words[best]))

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])
            out.clear()
            return batch

        for batch in batches:
            *keys, texts, ns = (c.to_pylist() for c in batch.columns)
            for own, word, count in zip(zip(*keys, strict=True), texts, ns, strict=True):
                if own != key:
                    close()
                    key, words, counts = own, [], []
                    if len(out) > 10_000:
                        yield full()
                words.append(word)
                counts.append(count)
        close()
        if out:
            yield full()

    found = dealt.mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each of (word, form). Each round doubles the steps that are followed.

    A form is more frequent than its word, so there are no circles, and rounds are as many as the binary
    logarithm of the longest chain.
    """
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = saved(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "further")
        step = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = saved(step, "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n): its most frequent near word, if ``factor`` times as frequent.

    Near words differ by exactly one inserted, deleted or replaced code point. Of near words of the same n the
    smallest in code-point order counts. ``root`` is the end of the chain of forms, the word itself without one.
    Words are distinct, of two letters at least; null words and counts, and shorter words, take no part. An empty
    table gives none. Words of any length are compared in full.
    """
    words = saved(words.where("word IS NOT NULL AND n IS NOT NULL AND length(word) > 1").select("word", F.col("n").cast("bigint").alias("n")), "words")
    near = near_words(buckets(words, block))
    enough = -F.col("best.n") >= F.col("n") * factor
    known = saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 13 over the words of all documents. Null and empty texts hold no words; a null doc_id counts as empty."""
    return spelling_variants(vocabulary(load(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS r FROM documents
), each AS (SELECT d, r, count(*) AS k FROM runs GROUP BY d, r
), coded AS (
  SELECT r, k, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(d, '') || ':' || r, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 | (unicode(s)::BIGINT >> 6), 128 | (unicode(s)::BIGINT & 63)] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) AS h FROM each, crc
), slipped AS (
  SELECT k, CASE WHEN xor(h, 4294967295) % 97 = 0 THEN r[1:xor(h, 4294967295) % length(r)] || r[xor(h, 4294967295) % length(r) + 2:] ELSE r END AS word FROM coded
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS s FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.s = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(o := other, m := n), struct_pack(m := -n, o := other)) AS top FROM near GROUP BY word
), known AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.m >= 2 * v.n THEN top.o END AS form, CASE WHEN top.m >= 2 * v.n THEN top.m END AS form_n FROM v LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM known
  UNION ALL SELECT walk.word, known.form FROM walk JOIN known ON walk.root = known.word WHERE known.form IS NOT NULL
), last AS (SELECT walk.word, walk.root FROM walk JOIN known ON walk.root = known.word WHERE known.form IS NULL
)
SELECT known.word, form, root, n, n_near, form_n FROM known JOIN last USING (word)
"""
