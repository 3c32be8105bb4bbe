"""Operators 11 to 13 and the memory of 4: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantjobs.llm import decontamination as dc
from quantjobs.llm import hard_negatives as hn
from quantjobs.llm import spelling as sp
from quantjobs.llm import topk
from quantjobs.llm.license_scan import scan as scan_licenses


# Operator 12.


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_of(text, items, span=10):
    """(words, hit words, items) of a text by plain comparison."""
    w, hit, found = words_of(text), set(), set()
    for item, body in items:
        b = words_of(body)
        n = min(span, len(b))
        known = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in known:
                hit |= set(range(k, k + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé9ß") for _ in range(rng.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(rng.randint(11, 40)))) for k in range(12)]
    items += [(20, None), (21, ""), (22, " .,! "), (23, "Only"), (24, "two Words"), (25, "one two three four five six seven eight nine"), (26, items[0][1]), (0, items[0][1]), (None, items[1][1]), (27, "ten words are one window and no more than that")]
    plain = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(20)]
    docs = [(k, t) for k, t in enumerate(plain)]
    for k in range(40):  # a passage of an item between other words, in another case and with other punctuation
        b = words_of(rng.choice(items[:12])[1])
        a, n = rng.randrange(len(b)), rng.randint(5, 25)
        docs.append((100 + k, f"{rng.choice(plain)[:50]}; {', '.join(b[a : a + n]).upper()}!{rng.choice(plain)[:50]}"))
    docs += [(200, None), (201, ""), (202, "only"), (203, "TWO\nwords two words"), (204, items[25 - 14][1]), (205, "x" * 40_000 + " only " + "y " * 30_000), (206, (items[2][1] + " ") * 300), (100, docs[25][1]), (100, "another text of the same id, only"), (100, docs[25][1]), (None, items[3][1]), (207, "one two three four five six seven eight nine ten words are one window and no more than that")]
    table = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in docs], "doc_id long, text string, n_words string, items string, id string, fp string").repartition(5)
    return docs, items, table, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")


@pytest.mark.parametrize("span,gram", [(10, 5), (10, 10), (6, 3), (4, 1)])
def test_contamination_equals_brute_force(leaks, span, gram):
    docs, items, table, tests = leaks
    got = dc.contamination(table, tests, span, gram).collect()
    want = Counter((i, *hits_of(t, items, span)[:2], tuple(hits_of(t, items, span)[2])) for i, t in docs)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and all(a["end"] < b["start"] for a, b in itertools.pairwise(r["spans"]))


def test_contamination_of_nothing(spark, leaks):
    _, _, table, tests = leaks
    assert dc.contamination(table.limit(0), tests).count() == 0
    rows = dc.contamination(table, tests.limit(0)).collect()
    assert len(rows) == table.count() and not any(r["n_hit"] or r["items"] or r["spans"] for r in rows)


def test_every_shared_span_has_a_common_fingerprint():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 60).astype(np.uint64), rng.integers(0, 2**63, 60).astype(np.uint64)
    b[20:30] = a[5:15]
    assert dc.window_fingerprints(a, 10, 5)[5] == dc.window_fingerprints(b, 10, 5)[20]
    # Neighbouring windows mostly keep the same k-gram: that is what makes the fingerprints few.
    many = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    kept = len(np.unique(dc.window_fingerprints(many, 10, 5)))
    assert 0.25 < kept / len(many) < 0.32  # 2 of 7


def test_words_don_t_run_over_texts():
    raw, start, end, owner = dc.split(pa.array(["ab", None, "", "Cd ef", " ", "gé"]))
    assert [bytes(raw[a:b]).decode() for a, b in zip(start, end, strict=True)] == ["ab", "cd", "ef", "gé"] and owner.tolist() == [0, 3, 3, 5]
    table = []
    h = dc.word_hashes(raw, start, end, table)
    again = dc.split(pa.array(["xx gé ab"]))
    assert dc.word_hashes(*again[:3], table)[1:].tolist() == [h[3], h[0]]


# Operator 13.


def near(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_of(counts, factor=2):
    mates = {w: sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: m[0] if m and counts[m[0]] >= factor * counts[w] else None for w, m in mates.items()}
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(mates[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(2)
    words = {"".join(rng.choice("aé") for _ in range(rng.randint(5, 8))) for _ in range(300)}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(150)}
    words |= {"prefix" + "".join(rng.choice("abcd") for _ in range(4)) for _ in range(120)}
    words |= {"x" * 400, "x" * 401, "x" * 399 + "y", "aaaaaaaa", "aaaaaaaaa"}
    return {w: rng.choice([3, 3, 5, 6, 12, 12, 24, 100]) for w in words}


@pytest.mark.parametrize("block", [1, 2, 7, 50, 1024])
def test_spelling_equals_brute_force(spark, counts, block):
    df = spark.createDataFrame([(w, n, "x", "x") for w, n in counts.items()] + [(None, 5, "x", "x"), ("nulls", None, "x", "x"), ("a", 9, "x", "x")], "word string, n int, form string, size string").repartition(3)
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sp.spelling_variants(df, block=block).collect()]
    assert len(got) == len(counts) and set(got) == variants_of(counts)


def test_each_pair_meets_once(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    dealt = sp.buckets(df, 4)
    met = Counter()
    for (size, head, tail, *_), rows in itertools.groupby(sorted(dealt.collect(), key=lambda r: tuple(r[c] for c in sp.KEY)), key=lambda r: tuple(r[c] for c in sp.KEY)):
        own = [r["word"] for r in rows]
        assert len(own) <= 4 or size - head - tail == 1
        for i, bits in sp.near_sets(own, size, head, tail):
            met.update((own[i], own[j]) for j in range(len(own)) if bits >> j & 1)
    assert met == Counter((a, b) for a in counts for b in counts if near(a, b))


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcÀé×÷ñ \n.9ÿŸß") for _ in range(rng.randint(0, 4000))) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, "Straße STRASSE Éclair eclair " * 50), (0, texts[0]), (None, "nobody nobody nobody nobody")]
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, run string")
    assert {r["word"]: r["n"] for r in sp.vocabulary(df).collect()} == {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    assert sp.spelling_variants(sp.vocabulary(df.limit(0))).count() == 0


# Operator 11.


def mined(rows, anchors, positives=5, k=10, low=30, high=90):
    """By plain sorting; rows are (id, label, whole numbers)."""
    out, first = [], {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        first.setdefault(i, (label, v))
    for a in sorted(x for x in first if anchors(x)):
        label, v = first[a]
        others = [(sum(map(int.__mul__, v, y)), i, z) for i, z, y in rows if i != a and len(y) == len(v)]
        best = sorted((-s, i) for s, i, z in others if z == label)[:positives]
        for s, p in best:
            s = -s
            fit = sorted((-t, i) for t, i, z in others if z != label and low * s <= 100 * t <= high * s)[:k]
            out += [(a, p, r + 1, i, s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("block,group", [(8, 3), (8192, 20_000)])
def test_hard_negatives_equal_brute_force(spark, block, group):
    rng = random.Random(6)
    vec = lambda n: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75]) for _ in range(n)]
    data = [(k, rng.randint(0, 2), vec(rng.choice([3, 3, 3, 5]))) for k in range(160)]
    data += [(200, 1, [0.0, 0.0, 0.0]), (300, None, vec(3)), (400, 1, None), (500, 1, [0.1, None, 0.2]), (600, 1, [0.1, math.nan, 0.2]), (700, 1, [math.inf, 0.1, 0.2]), (800, 1, []), (900, 7, vec(3)), (20, 2, vec(3)), (21, 0, vec(3)), (21, 0, vec(3)), (22, 1, data[22][2]), (1000, 0, vec(9)), (None, 1, vec(3))]
    df = spark.createDataFrame([(i, z, v, "x", "x") for i, z, v in data], "vec_id long, label int, embedding array<float>, id string, rank string").repartition(4)
    whole = [(i, z, [math.floor(256 * x) for x in v]) for i, z, v in data if i is not None and z is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    got = rows_of(hn.hard_negatives(df, F.col("id") % 10 == 0, block=block, group_rows=group))
    assert got == mined(whole, lambda x: x % 10 == 0) and len(got) > 300
    assert hn.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0 and hn.hard_negatives(df.where("vec_id = 20"), F.col("id") == 20).count() == 0


def test_lists_are_left_early():
    """Rows near the anchor's direction are few: the threshold ends the search long before the lists do."""
    rng = np.random.default_rng(3)
    m = rng.integers(-20, 20, (4000, 4))
    m[:50] += np.array([400, -300, 200, 0])
    orders = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
    a, ids = np.array([3, -2, 1, 0]), np.arange(4000) * 2
    best = hn.Best(np.array([[hn.LEAST]]), np.array([[hn.MOST]]), 10)
    scored = hn.go_down(a, m, orders, np.ones(4000, dtype=bool), ids, best, 0)
    want = sorted(zip(-(m @ a), ids, strict=True))[:10]
    assert list(zip(-best.scores[0, 0], best.ids[0, 0], strict=True)) == want and scored < 400


# Operator 4.


def test_topk_memory_of_a_full_group():
    """50,000 queries against a block of candidates: a worker's arrays stay below 300 MB."""
    rng = np.random.default_rng(2)
    n, dim = 50_000, 64
    m = rng.integers(-128, 128, (n, dim)).astype(np.int64)
    queries = {dim: (np.arange(n), m)}
    reach = np.full(n, 128 * 128 * dim)
    block = lambda at: SimpleNamespace(dim=dim, size=4, ids=np.arange(topk.BLOCK) + at, m=m[: topk.BLOCK].astype("<i4").tobytes())
    tracemalloc.start()
    total = topk.counted(iter([block(0), block(10**9)]), queries, {dim: (-reach, 2 * reach + 1)}, topk.BINS, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    pair, count = total[dim]
    per = np.bincount(pair // (topk.BINS + 1), weights=count, minlength=n)
    assert per.min() >= 5 and np.bincount(pair // (topk.BINS + 1)).max() <= 5


def test_topk_of_vectors_of_several_lengths(spark):
    rng = random.Random(8)
    data = [(k, [rng.randint(-3, 3) / 4 for _ in range(rng.choice([2, 3, 7]))]) for k in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in topk.top_k(df, F.col("id") % 10 == 0, bins=8).collect())
    want = []
    for q, v in data[::10]:
        own = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w, strict=True)), i) for i, w in data if i != q and len(w) == len(v))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(own)]
    assert got == sorted(want)
    assert topk.top_k(df.where("vec_id = 10"), F.col("id") % 10 == 0).count() == 0  # no candidate but itself


def test_license_scan_of_repeated_long_and_clashing_rows(spark):
    """Copies of a text, one of two million characters and one of many lines, get what a look at each line gives."""
    notice = "Licensed under the MIT License."
    long = "word " * 400_000 + "\n" + notice
    many = "\n".join([*(f"line {k}" for k in range(20_000)), "All rights reserved.", "SPDX-License-Identifier: Apache-2.0"])
    rows = [(1, long, "x"), (2, many, "y"), (3, None, "z"), (4, "", "z"), *[(5, notice, "t")] * 300]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Licenses string")
    got = scan_licenses(docs)
    assert got.columns == ["doc_id", "text", "text_digest", "text_license", "licenses"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan ExistingRDD") == 3  # documents once, two lists of digests
    found = got.groupBy("doc_id", "text_license", "licenses").count().collect()
    assert {(r[0], r[1], tuple(r[2]), r[3]) for r in found} == {(1, None, ("MIT",), 1), (2, None, ("Apache-2.0", "proprietary"), 1), (3, None, (), 1), (4, None, (), 1), (5, "MIT", ("MIT",), 300)}
