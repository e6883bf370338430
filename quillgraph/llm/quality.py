"""Quality rules with adaptive thresholds.

Each document gets whole-text measures. Their distributions per language and source are kept as mergeable
quantile sketches: counts of logarithmic buckets (16 a doubling, so a quantile is known within 1/16), which merge
by adding counts and do not depend on the order of the rows. Fences at a quartile plus some interquartile ranges
replace fixed cutoffs; a joined filter applies them. Groups of few documents take the sketch of their language, merged
from its sources, and languages of few documents that of the whole corpus.

Cases. Null or blank text: no words, base_failed. Null language or source: a group of its own. Repeated rows:
counted and judged each. Very long texts: measured whole. Ties: values on a fence are kept. Empty table: empty result. Extra columns: ignored by `measures`, kept by `filter_documents`
even if they bear a measure's name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS_CHARS, broadcast_if_small, table, words, written


@dataclass(frozen=True)
class Fences:
    """spread: interquartile ranges beyond a quartile; least: documents a group needs for thresholds of its own."""

    spread: int = 3
    least: int = 50
    #: measure, least interquartile range, whether there is a fence below too
    floors: tuple = (("symbols_pm", 20, False), ("word_len_c", 40, True), ("dup_lines_pm", 60, False), ("repeat_pm", 40, False))


PRODUCTION = Fences()
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_measures(docs: DataFrame) -> DataFrame:
    """docs as struct column `doc`, and its measures, all long; one scan of JVM expressions."""
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce("text", F.lit("")).alias("t"))
    has_word = lambda x: F.length(F.trim(x, F.lit(WS_CHARS))) > 0
    d = d.withColumns({"w": words(F.col("t")), "lines": F.filter(F.split("t", "\n"), has_word)})
    d = d.withColumn("n_words", F.size("w").cast("long"))
    # 64-bit hashes of the 3-word windows in order; the last two zipped rows are short and cut off
    zipped = F.arrays_zip(F.col("w"), F.expr("slice(w, 2, size(w))"), F.expr("slice(w, 3, size(w))"))
    d = d.withColumn("h", F.when(F.col("n_words") >= 3, F.transform(zipped, lambda x: F.xxhash64(x["w"], x["1"], x["2"]))))
    d = d.withColumn("h", F.expr("CASE WHEN h IS NULL THEN array() ELSE slice(h, 1, size(h) - 2) END"))
    # repeated windows meet when sorted by hash; texts without any, nearly all, skip the sort
    d = d.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN array_sort(transform(h, (x, i) -> struct(x AS h, i AS i))) ELSE array() END"))
    d = d.withColumn("z", F.expr("filter(transform(arrays_zip(s, slice(s, 2, size(s))), x -> struct(x.s AS a, x['1'] AS b)), x -> x.a.h = x.b.h)"))
    d = d.withColumn("p", F.expr("array_union(transform(z, x -> x.a.i), transform(z, x -> x.b.i))"))
    n = lambda c: c.cast("long")
    return d.select(
        "doc", "n_words",
        n(F.length(F.translate("t", WS_CHARS, ""))).alias("word_chars"),
        n(F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).alias("n_symbols"),
        n(F.size("lines")).alias("n_lines"),
        n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        n(F.expr("size(array_union(array_union(p, transform(p, x -> x + 1)), transform(p, x -> x + 2)))")).alias("n_repeat_words"),
    )


def scaled() -> dict[str, Column]:
    """The measures that are fenced, as integers: per mille, and hundredths of a character."""
    per = lambda a, b, k: F.when(F.col(b) > 0, F.expr(f"({k} * {a}) div {b}")).otherwise(F.lit(0).cast("long"))
    return {
        "symbols_pm": per("n_symbols", "word_chars", 1000), "word_len_c": per("word_chars", "n_words", 100),
        "dup_lines_pm": per("n_dup_lines", "n_lines", 1000), "repeat_pm": per("n_repeat_words", "n_words", 1000),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(c: str) -> str:
    """SQL of a value's bucket: itself below 16, else 16 to a doubling."""
    return f"CASE WHEN {c} < 16 THEN {c} ELSE (length(bin({c})) - 5) * 16 + shiftright({c}, length(bin({c})) - 5) END"


def value(b: str) -> str:
    """SQL of a bucket's least value."""
    return f"CASE WHEN {b} < 32 THEN {b} ELSE shiftleft({b} % 16 + 16, CAST({b} div 16 - 1 AS INT)) END"


def sketch(m: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: mergeable by adding n. Documents that fail the base rules do not count."""
    names = [f"'{x}', {x}" for x in scaled()]
    long = m.filter(~base_failed()).withColumns(scaled()).select("lang", "source", F.expr(f"stack({len(names)}, {', '.join(names)}) AS (measure, v)"))
    return long.groupBy("lang", "source", "measure", F.expr(bucket("v")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
    """Merges the sketches to the keys and reads n, q1 and q3 of each measure."""
    s = s.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    s = s.withColumns({"cum": F.sum("n").over(by.orderBy("bucket")), "all": F.sum("n").over(by)})
    at = lambda q: F.min(F.when(4 * F.col("cum") >= q * F.col("all"), F.col("bucket")))
    s = s.groupBy(*keys, "measure").agg(F.max("all").alias("n"), at(1).alias("b1"), at(3).alias("b3"))
    return s.select(*keys, "measure", "n", F.expr(value("b1")).alias("q1"), F.expr(value("b3")).alias("q3"))


def thresholds(s: DataFrame, rule: Fences = PRODUCTION) -> DataFrame:
    """lang, source, and lo_ and hi_ of each measure: of the group, else of its language, else of the whole corpus."""
    a, b, c = quartiles(s, ["lang", "source"]), quartiles(s, ["lang"]), quartiles(s, [])
    b = b.select(F.col("lang").alias("lang_"), F.col("measure").alias("measure_"), *(F.col(x).alias(f"{x}_l") for x in ("n", "q1", "q3")))
    c = c.select(F.col("measure").alias("measure__"), *(F.col(x).alias(f"{x}_a") for x in ("q1", "q3")))
    j = a.join(b, a["lang"].eqNullSafe(b["lang_"]) & (a["measure"] == b["measure_"])).join(c, a["measure"] == c["measure__"])
    pick = lambda q: F.when(F.col("n") >= rule.least, F.col(q)).when(F.col("n_l") >= rule.least, F.col(f"{q}_l")).otherwise(F.col(f"{q}_a"))
    j = j.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for name, floor, below in rule.floors:
        fence = rule.spread * F.greatest(F.col("q3") - F.col("q1"), F.lit(floor).cast("long"))
        out.append(F.max(F.when(F.col("measure") == name, F.col("q3") + fence)).alias(f"hi_{name}"))
        if below:
            out.append(F.max(F.when(F.col("measure") == name, F.col("q1") - fence)).alias(f"lo_{name}"))
    return j.groupBy("lang", "source").agg(*out)


def judged(m: DataFrame, th: DataFrame, rule: Fences = PRODUCTION) -> DataFrame:
    """m with base_failed and kept. A group without thresholds holds only documents that fail the base rules."""
    m = m.withColumns(scaled())
    th = th.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    j = m.join(th, m["lang"].eqNullSafe(th["lang_"]) & m["source"].eqNullSafe(th["source_"]), "left")
    good = F.lit(True)
    for name, _, below in rule.floors:
        good = good & F.coalesce(F.col(name) <= F.col(f"hi_{name}"), F.lit(True))
        if below:
            good = good & F.coalesce(F.col(name) >= F.col(f"lo_{name}"), F.lit(True))
    return j.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & good)


def assess(docs: DataFrame, rule: Fences = PRODUCTION) -> DataFrame:
    """doc_id, base measures, base_failed, kept. The scan of the texts runs once; its small rows are written."""
    m = with_measures(docs).select("doc.doc_id", "doc.lang", "doc.source", *BASE[1:], "n_lines")
    m = written(m, "quality")
    th = written(thresholds(sketch(m), rule), "fences")
    return judged(m, broadcast_if_small(th, th.count()), rule).select(*BASE, "base_failed", "kept")


def filter_documents(docs: DataFrame, rule: Fences = PRODUCTION) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    m = written(with_measures(docs), "quality")
    flat = m.select("doc", "doc.lang", "doc.source", *BASE[1:], "n_lines")
    th = written(thresholds(sketch(flat.drop("doc")), rule), "fences")
    return judged(flat, broadcast_if_small(th, th.count()), rule).filter("kept").select("doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB's SQL, written apart from the above."""
    r = PRODUCTION
    ws = r"[\x20\x09-\x0D]+"
    fence = lambda name: next(f for n, f, _ in r.floors if n == name)
    hi = lambda m: f"x.{m} <= (SELECT q3 + {r.spread} * greatest(q3 - q1, {fence(m)}) FROM pick p WHERE p.measure = '{m}' AND p.lang IS NOT DISTINCT FROM x.lang AND p.source IS NOT DISTINCT FROM x.source)"
    lo = f"x.word_len_c >= (SELECT q1 - {r.spread} * greatest(q3 - q1, {fence('word_len_c')}) FROM pick p WHERE p.measure = 'word_len_c' AND p.lang IS NOT DISTINCT FROM x.lang AND p.source IS NOT DISTINCT FROM x.source)"

    def quart(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""{name}_c AS (SELECT {k}measure, b, sum(n) n FROM sk GROUP BY {k}measure, b),
        {name}_w AS (SELECT *, sum(n) OVER (PARTITION BY {k}measure ORDER BY b) cum, sum(n) OVER (PARTITION BY {k}measure) total FROM {name}_c),
        {name} AS (SELECT {k}measure, max(total) n, min(b) FILTER (4 * cum >= total) b1, min(b) FILTER (4 * cum >= 3 * total) b3 FROM {name}_w GROUP BY {k}measure)"""

    val = lambda b: f"(CASE WHEN {b} < 32 THEN {b} ELSE (({b} % 16 + 16)::BIGINT << ({b} // 16 - 1)::INT) END)"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') t FROM documents),
a AS (SELECT *, list_filter(regexp_split_to_array(t, '{ws}'), lambda x: x <> '') w,
      list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{ws}', '', 'g')) > 0) l FROM d),
win AS (SELECT doc_id, i, w[i] || chr(0) || w[i+1] || chr(0) || w[i+2] k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM a)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + o) n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS (SELECT a.doc_id, lang, source, len(w)::BIGINT n_words, length(regexp_replace(t, '{ws}', '', 'g'))::BIGINT word_chars,
      (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT n_symbols, len(l) n_lines, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines,
      coalesce(cov.n, 0)::BIGINT n_repeat_words FROM a LEFT JOIN cov USING (doc_id)),
x AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed,
      CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END symbols_pm,
      CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END word_len_c,
      CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END dup_lines_pm,
      CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END repeat_pm FROM m),
lg AS (SELECT lang, source, unnest(['symbols_pm', 'word_len_c', 'dup_lines_pm', 'repeat_pm']) measure, unnest([symbols_pm, word_len_c, dup_lines_pm, repeat_pm]) v FROM x WHERE NOT base_failed),
sk AS (SELECT lang, source, measure, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)::INT) END b, count(*) n FROM lg GROUP BY ALL),
{quart("qa", "lang, source")},
{quart("qb", "lang")},
{quart("qc", "")},
pick AS (SELECT qa.lang, qa.source, qa.measure, {val("b1")} q1, {val("b3")} q3 FROM (
  SELECT qa.lang, qa.source, qa.measure, CASE WHEN qa.n >= {r.least} THEN qa.b1 WHEN qb.n >= {r.least} THEN qb.b1 ELSE qc.b1 END b1,
  CASE WHEN qa.n >= {r.least} THEN qa.b3 WHEN qb.n >= {r.least} THEN qb.b3 ELSE qc.b3 END b3
  FROM qa JOIN qb ON qa.lang IS NOT DISTINCT FROM qb.lang AND qa.measure = qb.measure JOIN qc ON qa.measure = qc.measure) qa)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {hi("symbols_pm")} AND {hi("word_len_c")} AND {lo} AND {hi("dup_lines_pm")} AND {hi("repeat_pm")} AS kept
FROM x
"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {"op6_quality_rules": _sql()}
