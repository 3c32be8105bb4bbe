"""What the stages of the pipeline write and shuffle on the way to their results."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quantjobs.llm import packing, secret_scan

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Rows repeated in both columns, ids with several texts, null ids, null, empty and long texts, secrets."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("data lake word query shuffle table join of the and").upper() + rng.choice("abcdefg") for _ in range(n))
    rows = [(k, prose(rng.randint(1, 60))) for k in range(120)]
    rows += [(200, prose(4000))] * 3 + [(200, prose(3000)), (201, None), (201, ""), (202, ""), (None, prose(20)), (None, None), (20, "5" + prose(3)), (2, "05" + prose(3)), (203, "password = hunter22 " + prose(5))]
    path = str(tmp_path_factory.mktemp("disk") / "documents.parquet")
    spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def written(monkeypatch):
    """Column names of every table that the operators save."""
    out = []
    for module in (packing, secret_scan):
        before = module.saved
        monkeypatch.setattr(module, "saved", lambda df, name, before=before: out.append((name, df.columns)) or before(df, name))
    return out


def test_ids_are_neither_written_nor_shuffled(docs, written):
    out = packing.pack_documents(docs)
    assert written and not any({"ids", "text"} & set(columns) for _, columns in written)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("Exchange" in line or "Join" in line for line in lines[:at])
    rows, whole = out.collect(), Counter()
    make = packing.coder(open(packing_path(), encoding="utf-8").read())
    for r in docs.collect():
        ids = np.frombuffer(make(r["text"] or ""), "<u4").tolist() + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            whole[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == whole
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spots[:-1], spots[1:], strict=True)) and spots[0][1] == 0
    assert max(a[1] + a[2] for a in spots) <= 2048
    light = packing.pack_documents(docs, with_ids=False)
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in light.collect()) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)


def packing_path():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json")


def test_a_wrong_number_of_places_is_an_error(spark):
    df = spark.createDataFrame([(1, "a b", [7]), (2, "c", [8, 9])], "doc_id long, text string, at array<int>")
    with pytest.raises(Exception, match="one element for each piece"):
        packing.tokenise(df, packing_path(), along="at").collect()
    rows = packing.tokenise(df.where("doc_id = 1"), packing_path(), along="at").collect()
    assert [(r["doc_id"], r["piece"], r["at"]) for r in rows] == [(1, 0, 7)]


def test_redaction_writes_no_texts(docs, written):
    rows = secret_scan.redact(docs).collect()
    assert not written and len(rows) == docs.count()
    before = Counter((r["doc_id"], r["text"]) for r in docs.where("doc_id <> 203 or doc_id is null").collect())
    assert Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] != 203) == before
    assert next(r["text"] for r in rows if r["doc_id"] == 203).startswith("[SECRET] ")
