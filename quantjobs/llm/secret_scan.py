"""Secret scans with DataFrame functions only: base patterns and a battery of randomness tests.

Candidates are long runs of letters, digits and ``+/_=-``. For each one an encoding is inferred, and
three statistics are taken against a uniform draw from its alphabet: chi-squared of the symbol counts,
the runs test about the middle of the alphabet, and the serial correlation of neighbouring symbols.
A run whose combined distance from randomness lies beyond the 99.9 % quantile of uniform draws, of its
alphabet and length class, is no secret. For the others the likelihood under a fixed model of ordinary
text, over that of the uniform draw, bounds the p-value against ordinary text (by Markov's inequality,
as the ratio's inverse has mean 1 at most under the model), whatever the size of the table. In each
length class the Benjamini-Hochberg procedure then bounds the share of false discoveries.
Numbers of ordinary text are uniform draws themselves, so a run of decimal digits gives no evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import load, saved, span_string, whole_text

KINDS = ["assign", "access", "hex", "random"]
# The patterns of the base kinds. Shorter runs are none of the kind, as runs are maximal.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Upper ends of the length classes, bins of the p-value (each of 0.1 in its logarithm), and the false-discovery rate.
CLASSES, BINS, RATE = (20, 24, 32, 48, 64, 128), 2000, 0.01
DIGITS, UPPER, LOWER, MARKS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "+/-_="
ALL = LOWER + UPPER + DIGITS + MARKS
#: Alphabets by their patterns, the first that fits counts.
ALPHABETS = (
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+=*$", UPPER + "234567="),
    ("^[a-z0-9]+$", LOWER + DIGITS),
    ("^[A-Z0-9]+$", UPPER + DIGITS),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("^", UPPER + LOWER + DIGITS + "+/-_="),
)
#: 99.9 % quantiles of the combined statistic by size of the alphabet, then length class: 20,000 uniform draws each
#: (base32 without its padding, base64 with either pair of marks), the largest of three lengths of the class.
NULL = {
    10: (28, 27, 25, 25, 27, 26, 27),
    16: (26, 24, 25, 24, 25, 24, 27),
    26: (24, 23, 23, 22, 23, 23, 23),
    33: (25, 25, 25, 25, 26, 25, 37),
    36: (23, 23, 24, 22, 22, 23, 24),
    52: (24, 24, 23, 22, 22, 22, 22),
    62: (27, 24, 23, 22, 23, 21, 23),
    67: (28, 26, 25, 24, 24, 25, 39),
}
#: The text model. Shares of what follows a lower-case letter, a capital, a digit, a mark and the beginning, in that order
#: (measured on 51,438 long runs of message catalogues and Python sources), and costs of letters after none and after
#: each letter: hundredths of -ln p, two digits to base 36, of letter pairs in catalogues of nine languages and Python
#: sources, mixed with single letters (a tenth) and all letters alike (a twentieth).
FOLLOWING = ((0.9125, 0.0129, 0.0016, 0.0731), (0.3025, 0.6074, 0.0044, 0.0857), (0.0663, 0.0180, 0.6557, 0.2600), (0.6687, 0.2126, 0.0124, 0.1063), (0.4095, 0.3194, 0.0055, 0.2657))
LETTERS = """
    7e9r86707w96ajbe86dsav8n917r8685dr8q698a9tacardedwcf
    ac9s8m7obmd19rd19idiam688b5ebva2f85o7k6la8b5ckegcecd
    5gcfcydi4pe8e7e55wadf565ckcf6mdsgy70a3b978fqehgi97fa
    5of7aqd76rf3eo4u6scm8v9ze5ck4qdngm8xc27g9mfofzgodoaj
    5oegdcbi2teqdie75texenbrdfb05ed2gv9wacbt9eekegg2did8
    9qc38b909tatacd99ddsbp7b8y54c1ayed4w5z7pbxc1dlaedpd7
    6kebdibp6m8fdrf03bfdfe8ydycb4vd8gt84ai9a8vfvfjg5dafx
    6ccvdtc63sf29wai67gae79wct7p7ccogv758za46kfbeagdesfd
    4qf4dzd93bf4ezdr5mfxf29lcib46dedgt9ibv808dfje7gqehg4
    8ab37h8j6za493ewcfcnbb7r924u7hbaeb8v6u7bd3a7epdafgbm
    4hdfdp993od4d8ej6rfj9tc4cz8u70bwgycn8mbr76cbe9gqfic8
    4idbbxd552eqcib069fzc49ydn9u5ncngw8i8x797xdjccgoeifh
    5bdddd9s4fakcoc14yeydi6xd4bc6jcmg9cp9r8m8rdqfeenbpfn
    4482dsd148eleff367glevc78waz6871gvcnbabt9df2f5gee6g0
    6ee5956f6gb16rbz6kf1bvcadna36hdeg1cn875ia1b3fdgibkdj
    bhab8y8majalakejavfibf8f754tac8ifr57788f8ab69xetf7dt
    4pdcbbc55ne2dccd7xgodq7sduc55294go5nao8g8aeufhgedfen
    aefle5dtbgfkf2fgb7grftdfencscdeffjchcsc40lftbsgqg1gc
    59csan914cdia9e46afvccbu9m9e6gdddg948o879lcedcgjb9bp
    7ge788d84zdxdo9t6ef99saycjbx7s8pewce784k8kdxdsgjb0cq
    5aesc7d04ce1ed7o5ig8drbqdhc167cqgy6z9q8t8yeodag7aldu
    849wa7ae6vbcazer7odbbu7x765sbp8qgg656p6fdtd3d9dwendv
    44egdwdm2uewenf95vgmfid4dqbz5he0gzawb8crc7eofxgcfjgd
    43esd4bt55f4e2924lgjdkc6e78p6sd4h09j9pcsb6fseug27ee7
    7hb575bh60azeodj56gqe0c9blcq965lgvcdbv4bcffdepcda8du
    6aas6zbx8vbkbdf39iak9w9y6s8k8369gz9q6k6ba9f19tg7esen
    4cc7cfcj4bfed3cs5hepdgcxar8m7td1fxcgcfb383fp9ign7har
""".split()
#: Matches that are placed in one array before it is joined to the others.
MATCHES = 256
SPANS = "array<struct<start:int,rank:int,end:int>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, m) of all non-overlapping matches, in code points, left to right.

    Matches are placed MATCHES at a time, so that arrays are not copied for each one of a text with very many.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,m:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    def some(acc: Column, chunk: Column) -> Column:
        placed = F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return F.element_at(F.transform(F.array(placed), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), 1)

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
    chunks = F.element_at(F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(MATCHES)), lambda i: F.slice(p, i, F.lit(MATCHES)))), 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(chunks, zero, some, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(kind))


def ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans (start, rank, end) of the base kinds."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    return F.concat(ranked(assign, 0), ranked(matches(text, ACCESS), 1), ranked(matches(text, HEX), 2))


def text_costs() -> list[int]:
    """Hundredths of -ln p of each character of ``ALL`` after each one, and last after none, under the text model."""
    kinds = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 5 + [4]
    letter = [*range(1, 27), *range(1, 27), *[0] * 16]
    out = []
    for before, row in zip(kinds, letter, strict=True):
        for c in range(len(ALL)):
            kind = kinds[c]
            own = int(LETTERS[row][2 * letter[c] - 2 : 2 * letter[c]], 36) if kind < 2 else math.floor(100 * math.log((10, 5)[kind - 2]))
            out.append(own + math.floor(-100 * math.log(FOLLOWING[before][kind])))
    return out


def text_cost(run: Column) -> Column:
    """Hundredths of -ln p of a run under the text model."""
    costs = F.split(F.lit(",".join(map(str, text_costs()))), ",").cast("array<int>")
    zero = F.struct(F.lit(len(ALL)).alias("p"), F.lit(0).alias("s"))

    def step(a: Column, c: Column) -> Column:
        at = F.call_function("instr", F.lit(ALL), c) - 1
        return F.struct(at.alias("p"), (a["s"] + F.get(costs, a["p"] * len(ALL) + at)).alias("s"))

    return F.aggregate(F.split(run, ""), zero, step, lambda a: a["s"])


def battery(run: Column) -> Column:
    """(n, bin) of a run: its length, and its binned -ln p against ordinary text, 0 where the tests reject randomness."""
    alphabet = F.lit(ALPHABETS[-1][1])
    for pattern, letters in reversed(ALPHABETS[:-1]):
        alphabet = F.when(run.rlike(pattern), letters).otherwise(alphabet)
    made = F.transform(F.array(F.struct(run.alias("r"), alphabet.alias("a"))), lambda x: _distance(x["r"], x["a"]))
    return F.element_at(made, 1)


def _distance(run: Column, alphabet: Column) -> Column:
    places = F.transform(F.split(run, ""), lambda c: F.call_function("instr", alphabet, c).cast("double"))
    return F.element_at(F.transform(F.array(F.struct(places.alias("v"), F.length(alphabet).cast("double").alias("k"), run.alias("r"))), lambda x: _tests(x["v"], x["k"], x["r"])), 1)


def _tests(v: Column, k: Column, run: Column) -> Column:
    n = F.size(v).cast("double")
    d0, i0 = F.lit(0.0), F.lit(0)
    start = F.struct(d0.alias("s"), d0.alias("q"), d0.alias("l"), d0.alias("p"), i0.alias("up"), i0.alias("runs"), F.lit(-1).alias("side"))

    def step(a: Column, x: Column) -> Column:
        side = F.when(x > k / 2, 1).otherwise(0)
        return F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["l"] + a["p"] * x).alias("l"), x.alias("p"), (a["up"] + side).alias("up"), (a["runs"] + F.when(side == a["side"], 0).otherwise(1)).alias("runs"), side.alias("side"))

    def counted(a: Column, x: Column) -> Column:
        same = x == a["p"]
        return F.struct(x.alias("p"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), (a["t"] + F.when(same, 2.0 * a["run"] + 1.0).otherwise(1.0)).alias("t"))

    squares = F.aggregate(F.array_sort(v), F.struct(F.lit(-1.0).alias("p"), i0.alias("run"), d0.alias("t")), counted, lambda a: a["t"])
    sums = F.aggregate(v, start, step)
    facts = F.struct(n.alias("n"), k.alias("k"), squares.alias("t"), sums.alias("a"), F.element_at(v, 1).alias("first"), run.alias("r"))
    return F.element_at(F.transform(F.array(facts), _combine), 1)


def _combine(f: Column) -> Column:
    n, k, a = f["n"], f["k"], f["a"]
    chi = (f["t"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1))
    up = a["up"].cast("double")
    mean = 2 * up * (n - up) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(var > 0, (a["runs"] - mean) / F.sqrt(var)).otherwise(6.0)
    spread = n * a["q"] - a["s"] * a["s"]
    corr = F.when(spread > 0, (n * (a["l"] + a["p"] * f["first"]) - a["s"] * a["s"]) / spread).otherwise(1.0)
    serial = (corr + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
    total = F.greatest(chi, F.lit(0.0)) * F.greatest(chi, F.lit(0.0)) + runs * runs + serial * serial
    limits = F.lit(None).cast("array<int>")
    for size, row in NULL.items():
        limits = F.when(k == size, F.array(*map(F.lit, row))).otherwise(limits)
    gain = text_cost(f["r"]) / 100 - n * F.log(k) - math.log(len(ALPHABETS))  # the alphabet was chosen among so many
    bin = F.least(F.greatest(F.floor(gain * 10), F.lit(0)), F.lit(BINS)).cast("int")
    return F.struct(n.cast("int").alias("n"), F.when((total <= F.element_at(limits, length_class(n) + 1)) & (k != len(DIGITS)), bin).otherwise(0).alias("bin"))


def length_class(n: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i, end in reversed(list(enumerate(CLASSES))):
        out = F.when(n < end, i).otherwise(out)
    return out


def analyse(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _base (spans of the base kinds) and _runs (every candidate with its statistics)."""
    whole = whole_text(text)
    runs = F.transform(matches(whole, CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["m"]).alias("b")))
    runs = F.transform(runs, lambda x: F.struct(x["start"], x["end"], length_class(x["b"]["n"]).alias("class"), x["b"]["bin"].alias("bin")))
    return docs.withColumn("_base", base_spans(whole)).withColumn("_runs", runs)


def thresholds(analysed: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Length class -> least bin that counts as random. Works on counts by class and bin, a fixed number of rows."""
    counts = analysed.select(F.explode("_runs").alias("r")).groupBy("r.class", "r.bin").count().collect()
    out = {}
    for c in range(len(CLASSES) + 1):
        tried = {r["bin"]: r["count"] for r in counts if r["class"] == c}
        m, rank, best = sum(tried.values()), 0, BINS + 1
        for b in sorted(tried, reverse=True):
            rank += tried[b]
            if math.exp(-b / 10) <= rate * rank / m:
                best = b
        out[c] = best
    return out


def secret_spans(analysed: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Adds _spans: base spans, and random runs that overlap none of them."""
    top = F.array(*[F.lit(limits[c]) for c in range(len(CLASSES) + 1)])
    random = F.filter(F.col("_runs"), lambda x: (x["bin"] >= F.element_at(top, x["class"] + 1)) & ~F.exists(F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return analysed.withColumn("_spans", F.concat("_base", ranked(random, 3)))


def redacted_text(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every group of overlapping spans replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced in ``text``; all rows and columns stay. Null texts stay null.

    Texts are scanned twice, for the thresholds and for the spans, as a table of what was found would hold them all:
    ``docs`` should be a table.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text"))
    found = analyse(rows)
    spans = secret_spans(found, thresholds(found)).withColumn("text", redacted_text(F.col("text"), F.col("_spans")))
    return spans.select(*[F.col("text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over the whole documents table.

    Null and empty texts have no spans and the digest of the empty string; repeated rows give equal rows.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = saved(analyse(docs).drop("text"), "secrets")
    ranks = F.transform("_base", lambda s: s["rank"])
    counted = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])]
    return secret_spans(found, thresholds(found)).select("doc_id", *counted, F.sha2(span_string("_base", KINDS), 256).alias("base_sha256"), span_string("_spans", KINDS).alias("spans"))
