"""URL filters: rules by host and path, and naive Bayes over words segmented from hosts and paths.

Concatenated names are split by Viterbi under a unigram model of words: the counts of all words of the
pages' own texts and of the seed words. Candidate pieces are looked up by a join, so that no vocabulary is
broadcast. Runs of digits are tokens of their own.

The tokens of hosts and paths then feed a multinomial naive Bayes model, which decides where no rule does. As
pages carry no labels, it starts from seed words: hosts that hold a word of junk hosts are block pages, all
others are allow pages. What the model then blocks are the block pages of the next round. Classes are smoothed by
shares, not by counts, and the prior is a parameter, so that verdicts don't depend on the size of the table. The
rules' verdicts teach it nothing: they speak of places, not of words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import load, saved, small_batches, without

#: (verdict, rule) of the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Words that stand for junk hosts and for plain ones; a plural counts as its singular.
JUNK_WORDS = "spam farm cheap pill casino poker viagra porn adult xxx escort loan payday replica warez torrent crack keygen clickbait malware phishing bet betting lottery jackpot pharma discount ad adserver tracker track popup".split()
PLAIN_WORDS = "blog news doc wiki library school science history article guide research journal university museum archive forum support help learn education".split()
#: Parts of all pages and of the seed words in either class's distribution of tokens; share of junk pages that is assumed.
ALL_SHARE, SEED_SHARE, JUNK_SHARE = 0.5, 0.1, 0.05
#: Occurrences of a seed word in the unigram model; longest piece that is looked up, that of a host's label; salts of frequent tokens; rounds.
WORD_WEIGHT, LONGEST, SALTS, ROUNDS = 20, 63, 16, 2
TAG, WORD = re.compile(r"<[^>]*>"), re.compile(r"[a-z]{2,}")


def parts(url: str) -> tuple[Column, Column]:
    """(host, path) of a url column; both empty for null and where there is no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): how often each lower-case word of letters occurs in the texts of all pages."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for pdf in batches:
            for x in pdf["h"].dropna():
                seen.update(WORD.findall(TAG.sub(" ", x.lower())))
            if len(seen) > 200_000:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return pages.select(F.col(html).alias("h")).mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, counts: dict[str, int], total: float) -> list[str]:
    """Likeliest split of a name; an unknown piece costs a tenth more for each of its letters."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        found = []
        for start in range(max(0, end - LONGEST), end):
            piece = name[start:end]
            p = counts[piece] / total if piece in counts else 10.0 / (total * 10 ** len(piece))
            found.append((best[start][0] - math.log(p), start))
        best.append(min(found))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names of letters, split under the unigram counts."""
    n = F.length("name")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), n)).alias("a"))
    pieces = starts.select("name", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - F.col("a") + 1))).alias("m"))
    pieces = pieces.select("name", F.expr("substring(name, a, m)").alias("word")).distinct()
    known = pieces.join(counts, "word").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))  # a name has few pieces
    total = float(counts.agg(F.sum("n")).first()[0] or 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [viterbi(x, dict(c or {}), total) for x, c in zip(pdf["name"], pdf["counts"], strict=True)]
            if words:
                yield pd.DataFrame({"name": pdf["name"].astype(object).to_numpy(), "words": words})

    return names.join(known, "name", "left").mapInPandas(run, "name string, words array<string>")


def token_rows(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, path, pages, token): the segmented tokens of each distinct host and path; a token is marked by its side."""
    runs = lambda c, side: F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+|[0-9]+)"), F.lit(1)), lambda x: F.struct(F.lit(side).alias("side"), x.alias("name")))
    rows = urls.select("host", "path", "pages", F.explode(F.concat(runs(F.col("host"), "h"), runs(F.col("path"), "p"))).alias("e")).select("host", "path", "pages", "e.*")
    word = F.col("name").rlike("^[a-z]{2,}$")
    split = segmented(rows.where(word).select("name").distinct(), counts)
    out = rows.where(word).join(split, "name").select("host", "path", "pages", "side", F.explode("words").alias("w"))
    other = rows.where(~word).select("host", "path", "pages", "side", F.when(F.col("name").rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length("name"))).otherwise(F.col("name")).alias("w"))
    return out.unionByName(other).select("host", "path", "pages", F.concat("side", F.lit(":"), "w").alias("token"))


def singular(token: Column) -> Column:
    """A token without its plural ending, of four letters and more."""
    return F.when(F.endswith(token, F.lit("s")) & ~F.endswith(token, F.lit("ss")) & (F.length(token) > 5), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def evidence_of(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """(host, path, w): the sum of the token weights, of urls that hold a weighted token. Frequent tokens are salted."""
    spread_ = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = tokens.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    return salted.join(spread_, ["token", "salt"]).groupBy("host", "path").agg(F.sum("w").alias("w"))


def odds(n: Column, block: Column, totals: tuple[float, float], seeds: tuple[Column, Column]) -> Column:
    """Log odds of block of a token on ``n`` pages, ``block`` of them block pages, from the totals of both and its share of either class's seeds.

    A class's distribution is a mixture of shares, so that a table of any size gives the same odds for the same urls: of its
    own pages, of all pages, and of its seed words.
    """
    everything, blocked = totals
    own = 1 - ALL_SHARE - SEED_SHARE
    mix = lambda part, whole, seed: own * part / max(whole, 1.0) + ALL_SHARE * n / max(everything, 1.0) + SEED_SHARE * seed
    return F.log(mix(block, blocked, seeds[0])) - F.log(mix(n - block, everything - blocked, seeds[1]))


def learn(tokens: DataFrame, urls: DataFrame, junk: list[str], plain: list[str], rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(token, w), log odds of block in millionths, and the prior's, after some rounds of naive Bayes from the seed words.

    The prior is a parameter, as pages that hold seed words say nothing of how many junk pages there are.
    """
    spark = tokens.sparkSession
    named = {f"h:{w}": 1 for w in junk} | {f"h:{w}": 0 for w in plain}
    seeds = F.broadcast(spark.createDataFrame(list(named.items()), "stem string, junk int"))  # two short lists
    total = tokens.groupBy("token").agg(F.sum("pages").alias("n"))
    facts = saved(total.withColumn("stem", singular(F.col("token"))).join(seeds, "stem", "left").select("token", "n", "junk"), "facts")
    everything = float(facts.agg(F.sum("n")).first()[0] or 0)
    prior = round(1e6 * math.log(JUNK_SHARE / (1 - JUNK_SHARE)))
    weights = facts.where("junk = 1").select("token", F.lit(abs(prior) + 1).cast("bigint").alias("w"))  # a seed word on the host suffices at first
    for _ in range(max(1, rounds)):
        blocked = saved(evidence_of(tokens, weights).where(F.col("w") + prior > 0).select("host", "path"), "blocked")
        own = tokens.join(blocked, ["host", "path"], "left_semi").groupBy("token").agg(F.sum("pages").alias("b"))
        table = saved(facts.join(own, "token", "left").select("token", "n", "junk", F.coalesce("b", F.lit(0)).alias("b")), "learnt")
        found = float(table.agg(F.sum("b")).first()[0] or 0)
        share = lambda y: F.when(F.col("junk") == y, 1.0 / max(1, sum(x == y for x in named.values()))).otherwise(0.0)
        w = odds(F.col("n"), F.col("b"), (everything, found), (share(1), share(0)))
        weights = table.select("token", F.round(w * 1e6).cast("bigint").alias("w"))
    return weights, prior


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, junk: list[str] = JUNK_WORDS, plain: list[str] = PLAIN_WORDS) -> DataFrame:
    """Adds host, path, rule, verdict and evidence (log odds of block, in millionths) to every page.

    Null urls and urls without ``://`` have an empty host and path and are allowed unless a rule fits.
    Repeated pages count as often as they occur; other columns are kept, those of the new names replaced.
    Evidence of 0 allows.
    """
    pages = without(pages, "host", "path", "rule", "verdict", "evidence")
    host, path = parts(url)
    urls = saved(pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("pages")), "urls")
    seeds = pages.sparkSession.createDataFrame([(w, WORD_WEIGHT) for w in dict.fromkeys([*junk, *plain])], "word string, n bigint")
    counts = saved(word_counts(pages, html).unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens = saved(token_rows(urls, counts), "tokens")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    weights, prior = learn(tokens, urls, junk, plain)
    judged = urls.join(evidence_of(tokens, weights), ["host", "path"], "left").select("host", "path", (F.coalesce("w", F.lit(0)) + prior).cast("bigint").alias("evidence"), rule.alias("rule"), verdict.alias("said"))
    out = judged.select("host", "path", "evidence", "rule", F.coalesce("said", F.when((F.col("evidence") > 0) & (F.col("host") != ""), "block").otherwise("allow")).alias("verdict"))
    return pages.withColumns({"host": host, "path": path}).join(out, ["host", "path"]).select(*pages.columns, "host", "path", "rule", "verdict", "evidence")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over the whole pages table."""
    return judge(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "evidence")
