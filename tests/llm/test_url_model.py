"""The naive Bayes of the URL filter: equal verdicts at every size, weights and verdicts by plain Python, planted hosts."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantjobs.llm import url_filter as uf

DATA = "/root/testdata"
JUNK_HOSTS = {"adult-x", "ads-track", "free-bets", "cheap-pills", "casino-win", "spam-farm"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_same_hosts_are_blocked_at_every_size(spark, sf):
    rows = uf.op1_url_filter(spark, f"{DATA}/{sf}").where("rule IS NULL").select(F.regexp_extract("host", r"([^.]+)\.example", 1).alias("name"), "verdict").distinct().collect()
    names = {r["name"] for r in rows}
    assert {r["name"] for r in rows if r["verdict"] == "block"} == names & JUNK_HOSTS and names & JUNK_HOSTS
    assert not {r["name"] for r in rows if r["verdict"] == "allow"} & JUNK_HOSTS


def by_hand(tokens, junk, plain, rounds=uf.ROUNDS):
    """Evidence of each (host, path) from its tokens and pages, as plain sums."""
    single = lambda t: t[:-1] if t.endswith("s") and not t.endswith("ss") and len(t) > 5 else t
    n = Counter()
    for pages, own in tokens.values():
        for t in own:
            n[t] += pages
    prior = round(1e6 * math.log(uf.JUNK_SHARE / (1 - uf.JUNK_SHARE)))
    weights = {t: abs(prior) + 1 for t in n if single(t) in {f"h:{w}" for w in junk}}
    for _ in range(rounds):
        b = Counter()
        for pages, own in tokens.values():
            if any(t in weights for t in own) and sum(weights.get(t, 0) for t in own) + prior > 0:
                for t in own:
                    b[t] += pages
        everything, blocked = sum(n.values()), sum(b.values())
        weights = {}
        for t in n:
            logs = []
            for part, whole, words in ((b[t], blocked, junk), (n[t] - b[t], everything - blocked, plain)):
                seed = (single(t)[2:] in words and t.startswith("h:")) / max(1, len(set(words)))
                logs.append(math.log((1 - uf.ALL_SHARE - uf.SEED_SHARE) * part / max(whole, 1) + uf.ALL_SHARE * n[t] / everything + uf.SEED_SHARE * seed))
            weights[t] = round(1e6 * (logs[0] - logs[1]))
    return {k: sum(weights[t] for t in own) + prior for k, (_, own) in tokens.items()}


def planted(seed=3, plain=40, pages=600):
    """(url, junk or not, whether a seed word is on the host)."""
    rng = random.Random(seed)
    words = "stone river cloud music garden paper silver window bridge forest market kitchen travel summer winter planet camera engine letter mirror".split()
    side = "best win free gold star club vip bonus".split()
    hosts = [(f"{rng.choice(['www.', 'm.', ''])}{a}{rng.choice(['', '-'])}{b}.net", False, False) for a, b in [rng.sample(words, 2) for _ in range(plain)]]
    hosts += [(f"www.{a}{rng.choice(['', '-'])}{b}.net", True, True) for a, b in [(rng.choice(side), rng.choice(["casino", "bets", "pills", "poker", "torrents"])) for _ in range(12)]]
    hosts += [(f"www.{'-'.join(rng.sample(side, 2))}.net", True, False) for _ in range(6)]
    return [(f"http://{h}/{rng.choice(['en', 'xx', 'pt'])}/{rng.randint(1, 999)}", junk, seeded) for h, junk, seeded in rng.choices(hosts, [3 if not j else 1 for _, j, _ in hosts], k=pages)]


def test_evidence_equals_plain_python_and_planted_hosts_are_found(spark):
    rows = planted()
    text = "<p>" + " ".join("stone river cloud music garden paper silver window bridge forest market kitchen travel summer winter planet camera engine letter mirror best win free gold star club vip bonus casino bets pills poker torrents".split()) + "</p>"
    df = spark.createDataFrame([(k, u, text) for k, (u, _, _) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in uf.judge(df).collect()}
    host, path = uf.parts("url")
    urls = df.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("pages"))
    counts = uf.word_counts(df).unionByName(spark.createDataFrame([(w, uf.WORD_WEIGHT) for w in dict.fromkeys([*uf.JUNK_WORDS, *uf.PLAIN_WORDS])], "word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    tokens = {}
    for r in uf.token_rows(urls, counts).collect():
        tokens.setdefault((r["host"], r["path"]), (r["pages"], []))[1].append(r["token"])
    want = by_hand(tokens, uf.JUNK_WORDS, uf.PLAIN_WORDS)
    for r in got.values():
        assert abs(r["evidence"] - want[r["host"], r["path"]]) <= len(tokens[r["host"], r["path"]][1])  # roundings of a millionth
        assert r["rule"] or r["verdict"] == ("block" if r["evidence"] > 0 else "allow")
    said = [(got[k]["verdict"] == "block", junk, seeded) for k, (_, junk, seeded) in enumerate(rows)]
    right, found = sum(b and j for b, j, _ in said), sum(b for b, _, _ in said)
    assert right >= 0.98 * found  # precision
    assert sum(b for b, _, s in said if s) >= 0.98 * sum(s for _, _, s in said)  # recall of hosts with a seed word
    unseeded = [b for b, j, s in said if j and not s]
    print(f"precision {right / found:.2f}, recall with a seed word {sum(b for b, _, s in said if s) / sum(s for _, _, s in said):.2f}, without {sum(unseeded) / len(unseeded):.2f}")
    assert sum(unseeded) >= 0.5 * len(unseeded)  # hosts of words learnt beside seed words


def test_ties_and_clashing_columns(spark):
    """No evidence either way allows; columns named like the results are replaced."""
    df = spark.createDataFrame([(1, "http://abc.net/x", None, "a", "b", 1, "c", "d"), (2, None, None, "a", "b", 1, "c", "d")], "page_id long, url string, html string, host string, path string, evidence int, RULE string, verdict string")
    rows = uf.judge(df).collect()
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {(1, "abc.net", "/x", None, "allow"), (2, "", "", None, "allow")}
    assert [c.lower() for c in uf.judge(df).columns].count("rule") == 1
