"""Toxicity scores behind a noisy channel: obfuscated words are restored before they are scored.

Channel: a character of a text stands for itself, for a letter it imitates (``LEET``), for a repetition
of the letter before it, or for a separator thrown in. The lattice of what each character may stand for
is decoded by Viterbi, without a beam, under a character trigram model counted over all documents; the best
few readings are kept. Runs of spaced single characters are joined first. A chunk of letters none of which
follows its like has one path through its lattice, so it is taken as it is. Separators inside a word are
undone, words spaced out in groups of letters ("id iot") are not.

Classifier: word n-grams get the lower confidence bound of their log odds between toxic and clean
labelled documents; a document's score is a logistic function of its strongest word and of whether
another word is strong. Labels of held-out rows are never read, nor are doc_id, lang or source inputs.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, product, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.byte_bpe import Memo
from quantjobs.llm.common import load, saved, small_batches, with_columns_of, without

# Letters that a character may imitate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = set(" .,-_*~'\"/\\:;#%&^=<>[]{})?`´’") | set("!|+(@$")
PUNCTUATION = "".join(SEPARATORS - set("@$")) + "@$“”„«»…–—¿¡§°"
SPACED = re.compile(r"(?<!\S)\S(?:[ ._*~-]{1,3}\S){2,}(?!\S)")
JUNK = re.compile(r"([^\w\s])\1\1+")
DOUBLE = re.compile(r"((.)\2+)")
#: Costs (negative log probabilities) of an imitation, a separator and a repetition.
IMITATES, SEPARATES, REPEATS = 2.0, 3.0, 4.0
#: Labelled documents to train on, at most; readings kept of each lattice; n-gram lengths.
TRAIN_ROWS, READINGS, GRAMS = 20_000, 4, (4, 5, 6)
#: Weights below LEAST are noise; Z is the width of the confidence bound.
LEAST, Z = 1.0, 1.6
SIZE = 28


def _symbols() -> np.ndarray:
    """Code point -> 1..26 (letters, accents dropped), 27 (other letters), 0 (the rest)."""
    out = np.zeros(65536, dtype=np.uint8)
    for cp in range(65536):
        c = chr(cp)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            out[cp] = ord(base) - 96 if "a" <= base <= "z" else 27
    return out


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Character trigram counts over all whole texts: a table of fixed size (28 ** 3)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, total = _symbols(), np.zeros(SIZE**3, dtype=np.int64)
        for pdf in batches:
            joined = " ".join(["", *pdf["t"].dropna(), ""])
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            s = symbol[np.where(cp < 65536, cp, 0)].astype(np.int32)
            code = (s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:]
            total += np.bincount(code, minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    rows = docs.select(F.col(text).alias("t")).mapInPandas(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows["code"].to_numpy(dtype=np.int64)] = rows["n"]
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of the third symbol after two, interpolated with shorter contexts."""
    c3 = counts.reshape(SIZE, SIZE, SIZE)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 8 * p1) / (c2.sum(1, keepdims=True) + 8)
    p3 = (c3 + 8 * p2) / (c3.sum(2, keepdims=True) + 8)
    return -np.log(p3)


@lru_cache(65536)
def _options(o: str) -> tuple[tuple[tuple[str, int, float], ...], float | None, str]:
    """(letter, symbol, cost) of what a character may stand for, the cost to drop it if it may be, what it may repeat."""
    stands = [(c, IMITATES) for c in LEET.get(o, "")]
    if o.isalpha():
        stands.append((o, 0.0))
    drop = SEPARATES if o in SEPARATORS or not stands else None
    return tuple((c, ord(c) - 96 if "a" <= c <= "z" else 27, v) for c, v in stands), drop, o + LEET.get(o, "")


def restore(noisy: str, costs: list, readings: int = READINGS) -> list[str]:
    """The likeliest readings of a lower-case string under the channel and the trigram costs.

    ``costs`` has a row for each two symbols. A state is the last two symbols and the last character read; it
    keeps its two best paths as back pointers, so that time and memory are linear in the string.
    """
    states: dict[tuple[int, str], list] = {(0, ""): [(0.0, None)]}
    for o in noisy:
        stands, drop, repeats = _options(o)
        step: dict[tuple[int, str], list] = {}

        def put(key, v, node):
            kept = step.get(key)
            if kept is None:
                step[key] = [(v, node)]
            elif len(kept) < 2:
                kept.append((v, node))
            else:
                worst = 0 if kept[0][0] > kept[1][0] else 1
                if v < kept[worst][0]:
                    kept[worst] = (v, node)

        for (xy, last), paths in states.items():
            row, y = costs[xy], xy % SIZE * SIZE
            for c, z, extra in stands:
                more = extra + row[z]
                for v, node in paths:
                    put((y + z, c), v + more, (node, c))
            stay = REPEATS if last and last in repeats else drop
            if stay is not None:
                for v, node in paths:
                    put((xy, last), v + stay, node)
        states = step
    ends = sorted(((v + costs[xy][0], node) for (xy, _), paths in states.items() for v, node in paths), key=lambda e: e[0])
    out: list[str] = []
    for _, node in ends[: 4 * readings]:
        letters = []
        while node:
            node, c = node
            letters.append(c)
        word = "".join(reversed(letters))
        if word and word not in out:
            out.append(word)
        if len(out) == readings:
            break
    return out


def spellings(word: str, costs: list) -> set[str] | None:
    """A word of letters and what is likelier than it once repeated letters are dropped; None if there are many such paths.

    These are all paths through the lattice of such a word, so this gives what ``restore`` would.
    """
    parts = DOUBLE.split(word) if len(word) < 100 else [word] * 99
    if len(parts) == 1:
        return {word}
    if len(parts) > 10:  # four runs or more
        return None
    runs = parts[1::3]
    if math.prod(map(len, runs)) > 16:
        return None

    def cost(w: str) -> float:
        xy, total = 0, 0.0
        for c in w:
            z = ord(c) - 96 if "a" <= c <= "z" else 27
            total += costs[xy][z]
            xy = xy % SIZE * SIZE + z
        return total + costs[xy][0]

    own, out = cost(word), {word}
    for keep in product(*[range(1, len(r) + 1) for r in runs]):
        w = "".join(x for k, r, rest in zip(keep, runs, parts[3::3], strict=True) for x in (r[:k], rest))
        w = parts[0] + w
        if cost(w) + REPEATS * (len(word) - len(w)) < own:
            out.add(w)
    return out


def words_of(chunk: str, costs: list) -> set[str]:
    """Lower-case words that a chunk without white space may stand for."""
    low = JUNK.sub("", chunk.lower())
    bare = low.strip(PUNCTUATION)
    plain = bare.isalpha() and not any(c in LEET for c in low)
    if plain and (few := spellings(bare, costs)) is not None:
        return few
    out = {p for p in re.split(r"[\W\d_]+", low) if len(p) > 1}
    if any(c.isalpha() for c in low):
        noisy = "".join(c for c in low if c.isalpha() or c in LEET or c in SEPARATORS)
        found = restore(noisy, costs)
        if plain and bare in found:  # plain letters: only readings that are likelier than the word itself
            found = found[: found.index(bare) + 1]
        out.update(found)
    return out


def grams(word: str) -> Iterable[int]:
    """Hashes of a word and of its character n-grams, its ends marked; one by one for long words."""
    w = f"^{word}$".encode("utf-32-le", "surrogatepass")
    spots = [(i, i + 4 * n) for n in GRAMS for i in range(0, len(w) - 4 * n + 1, 4)] if len(w) < 4000 else ((i, i + 4 * n) for n in GRAMS for i in range(0, len(w) - 4 * n + 1, 4))
    hashes = (zlib.crc32(w[a:b]) for a, b in spots)
    return chain((zlib.crc32(w),), hashes) if len(w) >= 4000 else [zlib.crc32(w), *hashes]


def chunks_of(text: str) -> set[str]:
    """Distinct chunks between white space, and every run of spaced single characters joined."""
    out = set(text.split())
    out.update(re.sub(r"[ ._*~-]", "", m[0]) for m in SPACED.finditer(text))
    return out


def _gram_counts(costs: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = costs.reshape(SIZE * SIZE, SIZE).tolist()
        memo = Memo(lambda c: np.unique(np.fromiter((g for w in words_of(c, table) for g in grams(w)), dtype=np.int64)))
        for pdf in batches:
            for y in (0, 1):
                seen = [np.unique(np.concatenate([memo[c] for c in chunks_of(t)] or [np.zeros(0, np.int64)])) for t in pdf["text"][pdf["y"] == y]]
                if seen:
                    gram, n = np.unique(np.concatenate(seen), return_counts=True)
                    yield pd.DataFrame({"gram": gram, "toxic": n * y, "clean": n * (1 - y)})

    return run


def _evidence(costs: np.ndarray, weights: dict[int, float]):
    """text -> (strongest word's weight, half the number of strong words up to two)."""
    table = costs.reshape(SIZE * SIZE, SIZE).tolist()

    def value(chunk: str) -> float:
        return max((max(map(weights.get, grams(w), repeat(0.0))) for w in words_of(chunk, table)), default=0.0)

    memo = Memo(value)

    def of(text: str | None) -> tuple[float, float]:
        got = [v for v in map(memo.__getitem__, chunks_of(text or "")) if v > LEAST]
        return (max(got), min(len(got), 2) / 2) if got else (0.0, 0.0)

    return of


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


class Model:
    """Trigram costs, weights of n-grams (only those above LEAST) and the logistic weights."""

    def __init__(self, costs: np.ndarray, weights: dict[int, float], final: np.ndarray) -> None:
        self.costs, self.weights, self.final = costs, weights, final


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on labelled rows that aren't held out, ``train_rows`` of them at most.

    The character model counts all of ``docs``. Null labels are ignored; a document with several labels
    counts as toxic if one says so. Without labels of both kinds every score is the share of toxic ones.
    """
    costs = trigram_costs(trigram_counts(docs))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    known = labels.where(~held_out & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    total = known.count()
    share = int(2**30 * min(1.0, train_rows / max(total, 1)))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < share)
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null").select("text", "y"), "labelled")
    sizes = {int(r["y"] > 0): r["count"] for r in rows.groupBy("y").count().collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nc:
        p = (nt + 0.5) / (nt + nc + 1)
        return Model(costs, {}, np.array([0.0, 0.0, math.log(p / (1 - p))]))
    seen = rows.mapInPandas(_gram_counts(costs), "gram bigint, toxic bigint, clean bigint").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
    bound = odds - Z * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    strong = seen.where("t > 1").select("gram", bound.alias("w")).where(F.col("w") > LEAST).toPandas()
    weights = dict(zip(strong["gram"].tolist(), strong["w"].tolist(), strict=True))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _evidence(costs, weights)
        for pdf in batches:
            x = np.array([of(t) for t in pdf["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": pdf["y"].to_numpy()})

    fit = rows.mapInPandas(measure, "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])
    return Model(costs, weights, _logistic(fit[["a", "b"]].to_numpy(), fit["y"].to_numpy()))


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """Adds the score, 0 to 1, of every whole text. Null and empty texts score as texts without evidence.

    Repeated rows score alike; a column named ``out`` is replaced, all others are kept.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, out)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_columns_of(docs, f"`{out}` double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        of = _evidence(m.costs, m.weights)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([of(t) for t in pdf[text]]).reshape(-1, 2)
            pdf[out] = 1 / (1 + np.exp(-np.clip(x @ m.final[:2] + m.final[2], -30, 30)))
            yield pdf

    return docs.mapInPandas(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over the whole documents table."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, load(spark, sf_dir, "labels"))).select("doc_id", "score")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
