"""URL filter: rules first, then words segmented from hosts, judged by naive Bayes.

Host labels are split into words by Viterbi under a unigram model, whose counts come from the words of all pages. Only
substrings of labels that occur as words are joined to them, so the model is never broadcast. Multinomial naive Bayes over
host words and path tokens is trained on all pages, labelled by a short list of seed words and their inflections in the
segmented host: seeds say which hosts are bad for sure, and the counts carry that to the words that go with them. The model
holds each seed with a count of one at least, so joined hosts split at seeds that no page's text has. Hosts and path patterns are judged
once each. A word has 2 to 63 letters, as a label of a host name has 63 at most; longer runs of letters are no words.

Cases. Null url, or none with `://`: host and path empty, no rule, verdict by the method (an empty page has the prior
alone: allow). Null page_id: kept. Repeated rows: each gets a row. Very long urls and pages: read whole. Ties: a score of 0 is
allow; of equal splits the one with the longest last word. No page with a seed: all allowed but by rules. Empty
table: empty result. Extra columns, of any name: ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, table, written

#: (host, path, verdict): the contract's rules.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Words that mark a host as bad.
SEEDS = ("adult", "bet", "betting", "casino", "escort", "gambling", "hack", "loans", "malware", "payday", "phishing", "pills", "poker", "porn", "sex", "spam", "torrent", "viagra", "warez", "xxx")
INFLECTED = {
    "adult": ("adults",), "bet": ("bets",), "casino": ("casinos",), "escort": ("escorts", "escorted", "escorting"), "gambling": ("gamble", "gambles", "gambled"),
    "hack": ("hacks", "hacked", "hacking"), "loans": ("loan",), "payday": ("paydays",), "phishing": ("phish", "phished"), "pills": ("pill",),
    "spam": ("spams", "spammed", "spamming"), "torrent": ("torrents", "torrented", "torrenting"),
}
LONGEST = 63
_WORD = re.compile(r"(?<![a-z])[a-z]{2,%d}(?![a-z])" % LONGEST)
_TAG = re.compile(r"<(script|style)\b.*?</\1>|<[^>]*>", re.S)


def located(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    p = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    p = p.withColumn("path", F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"^[^?#]*", 0))
    return p.select("page_id", F.translate("host", UPPER, LOWER).alias("host"), "path")


def rule_of(host: Column, path: Column, rules: list = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text), and its verdict; null if none."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # longer ones come to stand outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, floor: list[str]) -> DataFrame:
    """word, n: over the text of all pages, counted per task first; words of floor have 1 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["word", "n"])
            c.clear()
            return b

        for batch in batches:
            for html in batch.column(0):
                c.update(_WORD.findall(_TAG.sub(" ", html.as_py() or "").lower()))
                if len(c) > 200_000:
                    yield out()
        if c:
            yield out()

    counted = pages.select("html").mapInArrow(run, "word string, n long")
    least = pages.sparkSession.createDataFrame([(w, 0) for w in floor], "word string, n long")
    return counted.union(least).groupBy("word").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split. An unknown stretch costs as its letters' count of tens; of equal splits the longest last word wins."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(label) + 1):
        found = []
        for i in range(max(0, j - LONGEST), j):
            w = label[i:j]
            n = counts.get(w)
            p = math.log(n / total) if n else -math.log(max(total, 2)) - (j - i) * math.log(10)
            found.append((best[i][0] + p, i))
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    out, j = [], len(label)
    while j:
        i = best[j][1]
        out.append(label[i:j])
        j = i
    return out[::-1]


def segmented(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """host, words."""
    labels = hosts.select("host", F.explode(F.filter(F.split("host", r"[^a-z]+"), lambda x: x != "")).alias("label"))
    label = labels.select("label").distinct()
    subs = label.select("label", F.explode(F.expr(f"sequence(1, length(label))")).alias("i"))
    subs = subs.select("label", F.explode(F.expr(f"transform(sequence(1, least({LONGEST}, length(label) - i + 1)), k -> substring(label, i, k))")).alias("word")).distinct()
    known = subs.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, {} if k is None else {r["word"]: r["n"] for r in k}, total) for x, k in zip(label, known)])

    split_labels = label.join(known, "label", "left").select("label", split("label", "known").alias("words"))
    return labels.join(split_labels, "label").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))


def judged(pages: DataFrame, rules: list = RULES, seeds: tuple = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block)."""
    spark = pages.sparkSession
    at = located(pages).withColumn("pattern", F.regexp_replace(F.lower("path"), "[0-9]+", "0"))
    at = written(at, "urls")
    seeds = sorted({x for s in seeds for x in (s, *INFLECTED.get(s, ()))})
    counts = written(word_counts(pages, seeds), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    hosts = written(segmented(at.select("host").distinct(), counts, total), "hosts")
    patterns = at.select("pattern").distinct().select("pattern", F.filter(F.split("pattern", "[^\\p{L}\\p{N}]+"), lambda x: x != "").alias("tokens"))
    both = at.groupBy("host", "pattern").agg(F.count("*").alias("k"))
    bad = hosts.select("host", F.arrays_overlap("words", F.array(*map(F.lit, seeds))).alias("bad"))
    both = written(both.join(bad, "host", "left").withColumn("bad", F.coalesce("bad", F.lit(False))), "pairs")
    host_words = hosts.select("host", F.explode(F.transform("words", lambda w: F.concat(F.lit("h:"), w))).alias("t"))
    path_words = patterns.select("pattern", F.explode(F.transform("tokens", lambda w: F.concat(F.lit("p:"), w))).alias("t"))
    seen = both.groupBy("host", "bad").agg(F.sum("k").alias("k")).join(host_words, "host").select("t", "bad", "k")
    seen = seen.union(both.groupBy("pattern", "bad").agg(F.sum("k").alias("k")).join(path_words, "pattern").select("t", "bad", "k"))
    nb = seen.groupBy("t").agg(F.sum(F.when(F.col("bad"), F.col("k")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("bad"), F.col("k")).otherwise(0)).alias("a"))
    nb = written(nb, "bayes")
    sums = nb.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    pages_by = {r["bad"]: r["k"] for r in both.groupBy("bad").agg(F.sum("k").alias("k")).collect()}
    na, nbad, v = (sums[0] or 0), (sums[1] or 0), sums[2]
    prior = math.log((pages_by.get(True, 0) + 1) / (pages_by.get(False, 0) + 1))
    odds = nb.select("t", (F.log((F.col("b") + 1) / F.lit(nbad + v + 1.0)) - F.log((F.col("a") + 1) / F.lit(na + v + 1.0))).alias("odds"))
    hs = host_words.join(odds, "t").groupBy("host").agg(F.sum("odds").alias("host_score"))
    ps = path_words.join(odds, "t").groupBy("pattern").agg(F.sum("odds").alias("path_score"))
    hs, ps = written(hs, "scores"), written(ps, "scores")
    out = at.join(broadcast_if_small(hs, hs.count()), "host", "left").join(broadcast_if_small(ps, ps.count()), "pattern", "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    out = out.withColumn("score", F.round(score, 6)).withColumn("rule", name)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9_url_filter}
SQL: dict = {}
