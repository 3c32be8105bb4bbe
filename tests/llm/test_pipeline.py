"""Stages and the whole pipeline, and the registered queries as they are returned, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantjobs.llm import near_dedup, pii, queries, secret_scan, stages, toxicity

P = pytest.importorskip("public_tokenizers")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with toxic texts, copies, secrets, personal data, nulls, repeated rows and a clashing column."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        rows.append((k, prose(40) + (" you total " + rng.choice(["idiot", "moron", "1d10t", "m o r o n"]) if toxic else "")))
        labels.append((k, 0, int(toxic)))
    base = prose(120)
    rows += [(1000, base), (1001, base), (1002, base + " end"), (1003, None), (1004, ""), (1005, "password = hunter22 and AKIA" + "Q" * 16 + " and " + "0a" * 14)]
    rows += [(1006, "mail a.b12@mail.example.com or +1 (555) 123-4567, 10.0.0.255 " + prose(30)), (1006, "mail a.b12@mail.example.com or +1 (555) 123-4567, 10.0.0.255 " + prose(30)), (1007, "<|endoftext|> " + prose(3000))]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", F.lit("clash")).withColumn("ids", F.lit("clash")).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = stages.without_toxic(spark, docs, path)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert sum(ids[k] for k in range(0, 400, 4)) <= 10 and sum(ids[k] for k in range(400) if k % 4) >= 295
    assert ids[1003] == ids[1004] == 1 and ids[1006] == 2
    kept = stages.deduplicated(spark, docs, path)
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert kept.columns == docs.columns and ids[1000] == 1 and ids[1001] == ids[1002] == 0 and ids[1003] == ids[1004] == 1 and ids[7] == 1
    out = stages.redacted(spark, docs, path)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == docs.columns and out.count() == len(rows)
    assert texts[1005] == ("[SECRET] and [SECRET] and [SECRET]", 34) and texts[1003][0] is None and texts[5][0] == dict(rows)[5]
    packed = stages.packed(spark, docs, path).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _ in rows)
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_whole_pipeline(spark, folder):
    path, rows = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secret_scan", "best_fit_packing"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in out}
    assert {1000, 1003, 1004, 1005, 1006, 1007} <= ids and not ids & {1001, 1002} and sum(k in ids for k in range(0, 400, 4)) <= 10
    whole = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        whole.setdefault(r["doc_id"], []).extend(r["ids"])
    assert t.decode(whole[1005][:-1]) == "[SECRET] and [SECRET] and [SECRET]" and whole[1003] == [0] and t.decode(whole[7][:-1]) == dict(rows)[7]
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def spans_text(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_registered_queries_as_returned(spark, folder):
    path, rows = folder
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    q = queries.queries()
    got = q["op2_toxicity"](spark, path).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    got = q["op3_near_dedup"](spark, path).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and {r["component_id"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {1000}
    for r in q["op5_secret_scan"](spark, path).collect():
        for t in texts[r["doc_id"]][:1]:
            base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3))
            assert r["base_sha256"] == hashlib.sha256(spans_text(base, secret_scan.KINDS).encode()).hexdigest()
            assert set(spans_text(base, secret_scan.KINDS).split(",")) <= set(r["spans"].split(","))
    for r in q["op10_pii"](spark, path).collect():
        base = pii.base_spans(texts[r["doc_id"]][0])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[1] == k for s in base) for k in range(4))
        assert r["base_sha256"] == hashlib.sha256(spans_text(base, pii.KINDS).encode()).hexdigest()
        assert set(spans_text(base, pii.KINDS).split(",")) <= set(r["spans"].split(","))
    for r in q["op8_byte_bpe"](spark, path).collect():
        assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts[r["doc_id"]]}
    got = q["op6_best_fit_packing"](spark, path).collect()
    assert all(r["start"] == 0 or r["piece"] > 0 for r in got) and max(r["offset"] + r["length"] for r in got) <= 2048
    assert toxicity.TRAIN_ROWS == 20_000 and near_dedup.BITS == 2048
