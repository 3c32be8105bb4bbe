"""SimHash fingerprints with DataFrame functions only, and permuted block tables to search them.

Terms are pairs of neighbouring words (a lone word pairs with nothing). A term's weight is half the
length of its words, from 1 to 7. Each term votes its weight for or against each of 64 bits of its hash.
A text's votes are added up within its row, so that rows never meet: repeated rows, null ids and hot
keys need no care. Sums are kept in lanes of a long: bytes for a few terms, half longs for a text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantjobs.llm.common import load, saved, whole_text

RADIUS, BLOCKS = 3, 6
SEPARATOR, LETTER = r"[\s\p{Punct}]", r"[^\s\p{Punct}]"
#: Terms added up in byte lanes before they are widened: 18 weights of 7 at most stay below 128.
CHUNK = 18
BYTES, HALVES = 0x0101010101010101, 0x000000FF000000FF
#: Copies of the few fingerprints with neighbours, as one fingerprint may belong to a third of all rows.
SALTS = 16


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-case words between white space and punctuation, each put in lower case on its own."""
    return F.transform(F.filter(F.split(text, rf"{SEPARATOR}+"), lambda w: w != ""), F.lower)


def terms(found: Column, alone: Column | None = None) -> Column:
    """Hashes of neighbouring word pairs, the weight in the lowest three bits; of a lone word where ``alone``."""

    def term(a: Column, b: Column) -> Column:
        weight = F.least(F.lit(7), F.greatest(F.lit(1), F.shiftright(F.length(a) + F.coalesce(F.length(b), F.lit(0)), 1)))
        return F.xxhash64(a, b).bitwiseAND(F.lit(~7)).bitwiseOR(weight.cast("long"))

    def of(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), term)
        return F.when((F.size(w) == 1) & (F.lit(True) if alone is None else alone), F.transform(w, lambda x: term(x, F.lit(None).cast("string")))).otherwise(pairs)

    return let(found, of)


def votes(hashes: Column, before: Column | None = None, finish=None) -> Column:
    """The signed votes of terms, added to ``before``: sum j + 8 i has bit j + 8 i in its lower half, bit j + 8 i + 32 above."""
    zero = F.lit(0).cast("long")

    def few(chunk: Column) -> Column:
        """Sums of up to CHUNK terms: lane i of sum j is bit j + 8 i."""
        drawn = F.transform(chunk, lambda h: F.struct(F.xxhash64(h).alias("x"), h.bitwiseAND(F.lit(7)).alias("w")))
        start = F.struct(*[zero.alias(f"s{j}") for j in range(8)], zero.alias("all"))
        return F.aggregate(drawn, start, lambda a, t: F.struct(*[(a[f"s{j}"] + F.shiftrightunsigned(t["x"], j).bitwiseAND(F.lit(BYTES)) * t["w"]).alias(f"s{j}") for j in range(8)], (a["all"] + t["w"]).alias("all")))

    def wider(a: Column, c: Column) -> Column:
        return F.struct(*[(a[f"v{j + 8 * i}"] + F.shiftrightunsigned(c[f"s{j}"], 8 * i).bitwiseAND(F.lit(HALVES))).alias(f"v{j + 8 * i}") for i in range(4) for j in range(8)], (a["all"] + c["all"]).alias("all"))

    def of(h: Column) -> Column:
        starts = F.when(F.size(h) > 0, F.sequence(F.lit(1), F.size(h), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        start = F.struct(*[zero.alias(f"v{j + 8 * i}") for i in range(4) for j in range(8)], zero.alias("all")) if before is None else before
        step = lambda a, at: let(few(F.slice(h, at, F.lit(CHUNK))), lambda c: wider(a, c))
        return F.aggregate(starts, start, step, finish) if finish else F.aggregate(starts, start, step)

    return let(hashes, of)


def majority(a: Column) -> Column:
    """The bits that have more than half of the votes."""
    zero = F.lit(0).cast("long")
    out = zero
    for j in range(32):
        for lane, shift in ((a[f"v{j}"].bitwiseAND(F.lit(0xFFFFFFFF)), j), (F.shiftrightunsigned(a[f"v{j}"], 32), j + 32)):
            out = out.bitwiseOR(F.when(lane * 2 > a["all"], F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(zero))
    return out


def fingerprint(text: Column) -> Column:
    """64 bits by the signed votes of a text's terms; null of null. A text without words has the fingerprint 0."""
    return votes(terms(words(text)), None, majority)


def fingerprint_pair(kept: Column, tail: Column, other: Column) -> Column:
    """(f, g): the fingerprints of kept + tail and of kept + other; the votes of what they share are added up once.

    The last word of ``kept`` may go on in the tail: it counts with each tail.
    """
    last = F.regexp_extract(kept, rf"(?<!{LETTER}){LETTER}++$", 0)  # linear: tried at beginnings of words only

    def of(x: Column) -> Column:
        shared = x["shared"]

        def rest(end: Column) -> Column:
            return terms(F.concat(F.slice(shared, F.lit(-1), F.lit(1)), words(F.concat(x["last"], end))), F.size(shared) < 2)

        return let(votes(terms(shared, F.lit(False))), lambda v: F.struct(votes(rest(tail), v, majority).alias("f"), votes(rest(other), v, majority).alias("g")))

    whole = words(F.substring(kept, F.lit(1), F.length(kept) - F.length(last)))
    return let(F.struct(whole.alias("shared"), last.alias("last")), of)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_fingerprints(prints: DataFrame, col: str = "fingerprint", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): all pairs a < b of distinct fingerprints at most ``radius`` bits apart.

    The 64 bits are cut into ``blocks``; a pair within the radius agrees on at least ``blocks - radius``
    of them, so one table for each such choice of blocks finds it. A pair is given once, by the first
    choice on which it agrees. Null fingerprints take no part.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    choices = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in choices]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col(col).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    rows = prints.where(F.col(col).isNotNull()).select(col).distinct().select(F.col(col).alias("f"), F.explode(tables).alias("e")).select("f", "e.*")
    a, b = rows.select("t", "k", F.col("f").alias("a")), rows.select("t", "k", F.col("f").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(signed))
    for i, m in reversed(list(enumerate(signed))):
        first = F.when(apart.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    return a.join(b, ["t", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & (F.col("t") == first)).select("a", "b")


def following(ids: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """(id, next_id) of distinct ids in ascending order; after the last comes the first.

    Ids are bucketed by quantiles, so that no window sees more than about ``bucket_rows`` of them.
    """
    ids = saved(ids.where("id is not null").distinct(), "ids")
    n = max(1, min(1000, ids.count() // bucket_rows))
    cuts = ids.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000)).first()[0] if n > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("id")))
    rows = ids.withColumn("bucket", bucket)
    starts = rows.groupBy("bucket").agg(F.min("id").alias("start"))  # at most n rows
    order = Window.orderBy("bucket")
    jump = starts.select("bucket", F.coalesce(F.lead("start").over(order), F.first("start").over(order)).alias("jump"))
    inside = rows.withColumn("next_id", F.lead("id").over(Window.partitionBy("bucket").orderBy("id")))
    return inside.join(F.broadcast(jump), "bucket").select("id", F.coalesce("next_id", "jump").alias("next_id"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, n_chars, kept, tail, other): each text in two parts, and what its last quarter is replaced by.

    The edited text is kept + other: the last quarter gives way to the next document's beginning.
    Null texts count as empty. Rows that repeat an id are each edited; what follows them is the next
    distinct id, of whose rows the one with the least beginning counts. A lone document follows itself.
    Rows with a null id have no next document and a null other.

    Whole texts are shuffled once, by id; both joins read that exchange. Besides them only the wanted
    beginnings, a quarter of the texts at most, move.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text"))
    known = base.where("id is not null")
    quarters = saved(known.groupBy("id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("k")), "quarters")
    after = saved(following(quarters.select("id")).join(quarters, "id"), "order")
    want = after.select(F.col("next_id").alias("id"), "k", F.col("id").alias("of"))
    heads = known.join(want, "id").select("of", F.expr("substring(text, 1, k)").alias("head")).groupBy("of").agg(F.min("head").alias("head"))
    heads = heads.join(after.select(F.col("id").alias("of"), "next_id"), "of")
    out = known.join(heads.withColumnRenamed("of", "id"), "id").select("id", "next_id", "text", "head")
    out = out.unionByName(base.where("id is null").select("id", F.lit(None).cast("bigint").alias("next_id"), "text", F.lit(None).cast("string").alias("head")))
    chars = lambda *c: F.expr("substring(%s, %s, %s)" % c)
    out = out.withColumn("_k", F.expr("cast(floor(length(text) / 4) as int)"))
    return out.select("id", "next_id", F.length("text").cast("long").alias("n_chars"), chars("text", "1", "length(text) - _k").alias("kept"), chars("text", "length(text) - _k + 1", "_k").alias("tail"), chars("head", "1", "_k").alias("other"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, n_chars, edited_sha256, f, g): the fingerprints of every row's text and edited text.

    Every row of ``docs`` gives one row, repeated ones and those of null ids too; of the latter next_id,
    edited_sha256 and g are null. Null and empty texts have the fingerprint 0.
    """
    both = fingerprint_pair(F.col("kept"), F.col("tail"), F.col("other")).alias("fg")
    texts = edited(docs, id_col, text_col).select("id", "next_id", "n_chars", F.sha2(F.concat("kept", "other"), 256).alias("edited_sha256"), both)
    return texts.select("id", "next_id", "n_chars", "edited_sha256", "fg.f", "fg.g")


def neighbours(prints: DataFrame, col: str) -> DataFrame:
    """Adds n_near, how many other distinct fingerprints lie within the radius; one that many rows share is salted."""
    near = near_fingerprints(prints, col)
    counts = near.select(F.explode(F.array("a", "b")).alias(col)).groupBy(col).agg(F.count("*").alias("n_near"))
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("_salt", F.pmod(F.xxhash64("id", "edited_sha256"), F.lit(SALTS)).cast("int"))
    return salted.join(counts, [col, "_salt"], "left").drop("_salt").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over the whole documents table; n_near counts other fingerprints within the radius.

    Repeated rows and rows without an id each keep their row. The likeness to a next document of several
    rows is that to their least fingerprint; without a next document it is null, as is near_edited.
    """
    prints = saved(fingerprints(load(spark, sf_dir, "documents")), "prints")
    after = prints.where("id is not null").groupBy(F.col("id").alias("next_id")).agg(F.min("f").alias("h"))
    hex16 = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return neighbours(prints, "f").join(after, "next_id", "left").select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        hex16("f").alias("fingerprint"),
        hex16("g").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("h")).alias("near_next"),
        "n_near",
    )
