"""The pipeline against a brute-force version of each stage."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillgraph.llm")
pipeline = pytest.importorskip("corpus_pipeline")
import duckdb  # noqa: E402
import public_tokenizers as P  # noqa: E402

from quillgraph.llm import quality  # noqa: E402

from test_operators import closure, words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made() -> list[tuple]:
    r = random.Random(11)
    vocabulary = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts: list = [None, "", "too short", "#$% | " * 40 + text(30), "one line\n" * 60 + text(20), "x" * 3000 + " " + text(60), text(4000)]
    texts += [text(r.randint(40, 260)) for _ in range(110)]
    for k in (20, 30, 31, 32):  # exact copies, and chains of near ones
        w = texts[k].split()
        for step in range(5):
            w[(7 * step + 3) % len(w)] = f"new{step}"
            texts += [" ".join(w), " ".join(w)]
    return [(i, t, ["en", "de", None][i % 9 // 4], ["a", "b", "c", None][(i % 10 > 4) + (i % 10 > 7) + (i % 10 > 8)], len(t or "")) for i, t in enumerate(texts)]


def mixed(docs: list[tuple]) -> Counter:
    """How often each document is taken whole."""
    sizes: Counter = Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:  # fills the sources that reach three times their size, then shares the rest anew
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    out: Counter = Counter()
    md5 = lambda b: hashlib.md5(b).hexdigest()
    for s in order:
        goal, at = math.floor(target[s] + 0.5), 0
        stream = sorted((md5(f"{i}|{md5((t or '').encode())}".encode()), i, len(words(t))) for i, t, _, x, _ in docs if x == s)
        passes, rest = divmod(goal, sizes[s])
        for _, i, n in stream:
            out[i] += (passes + (0 < 2 * n <= 2 * max(0, rest - at) + n)) * (n > 0)
            at += n
    return +out


def test_pipeline_against_brute_force(spark, tmp_path):
    data = made()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, by_id = dict(pipeline.STAGES), {d[0]: d for d in data}
    same = lambda df: sorted(tuple(r) for r in df.collect())

    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    good = {i for (i,) in con.execute(f"SELECT doc_id FROM ({quality.SQL['op6_quality_rules']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in kept.collect()} == good and not good & {0, 1, 2, 4} and 6 in good

    single = stages["near_dedup"](spark, kept, str(tmp_path))
    label = closure({i: [by_id[i][1]] for i in good}, 80, 5)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(label.values())) and len(set(label.values())) < len(good) - 15

    mix = stages["source_mix"](spark, single, str(tmp_path))
    want = mixed([by_id[i] for i in set(label.values())])
    assert Counter(r["doc_id"] for r in mix.collect()) == want
    assert {tuple(r) for r in mix.collect()} <= set(data) and max(want.values()) > 1

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha, rows = lambda b: hashlib.sha256(b).hexdigest(), []
    for i, k in want.items():
        ids = np.array(enc.encode_ordinary(by_id[i][1]), "<u4")
        rows += [(i, len(ids), sha(ids.tobytes()), sha(by_id[i][1].encode()))] * k
    assert same(stages["byte_bpe"](spark, mix, str(tmp_path))) == sorted(rows)
    assert same(pipeline.run(spark, str(tmp_path))) == sorted(rows)


@pytest.mark.parametrize("source", ["b", None])
def test_mix_takes_as_many_copies_as_the_target_asks(spark, source):
    """A thousand rows of one id and text, far above the target of their source, beside ten long documents."""
    rows = [(5, "ten words " * 5, "en", source, k) for k in range(1000)] + [(k, "long " * 1000, "en", "a", 0) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = Counter((r["doc_id"], r["n_chars"]) for r in dict(pipeline.STAGES)["source_mix"](spark, docs, "").collect())
    copies = {k: n for k, n in got.items() if k[0] == 5}
    assert sum(copies.values()) == 571 and set(copies.values()) == {1}  # two sevenths of 20,000 words are 5,714
    assert sum(n for k, n in got.items() if k[0] != 5) == 14 and max(got.values()) == 2


def test_mix_repeats_copies(spark):
    """Three copies of ten words and a target of twice their words and a half: each twice, and one or two of them once more."""
    rows = [(5, "ten words " * 5, "en", "a", k) for k in range(3)] + [(6, "w " * 75, "en", "b", 0)]
    got = Counter(r["doc_id"] for r in dict(pipeline.STAGES)["source_mix"](spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got[5] == 8  # five sevenths of 105 words are 75: two passes and 15 words, of which the second ten are half in
