"""Empty tables, repeated rows, ties, very long texts and clashing columns, where test_operators has none; urls by brute force."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillgraph.llm")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillgraph.llm import bpe, licenses, mixing, quality, separators, tokenfile, topk, urls  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
NAMES = "words w h t s z p n lines key bucket bucket_ size source_ source__ kind last taken target position offset doc digest pass kept n_words before passes end_key times license_id".split()


@pytest.fixture(scope="module")
def clashing(spark):
    data = [(1, "one two three " * 40, "en", "a"), (1, "one two three " * 40, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " ".join(f"w{k}" for k in range(30_000)), "en", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(f"x-{n}").alias(n) for n in NAMES))


def test_clashing_columns_repeated_rows_and_long_texts(spark, clashing):
    plain = clashing.select("doc_id", "text", "lang", "source")
    known = licenses.known_licenses(spark)
    runs = [
        quality.assess, mixing.mix, lambda d: licenses.scan(d, known, known.count()), lambda d: bpe.digests(d, RANKS),
        lambda d: tokenfile.read_files(*tokenfile.write_files(d, P.path("byte_bpe_50k.json"))),
    ]
    for run in runs:
        got, want = (sorted(map(str, run(d).collect())) for d in (clashing, plain))
        assert got == want and len(got) == 5
    for run in (quality.filter_documents, mixing.mix_documents):
        out = run(clashing)
        assert out.columns == clashing.columns
        assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, run(plain).collect()))
    assert sum(r["taken"] for r in mixing.mix(plain).collect()) <= 3 * (2 * 120 + 30_000)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    known = licenses.known_licenses(spark)
    assert licenses.scan(d, known, known.count()).count() == bpe.digests(d, RANKS).count() == bpe.encode(d, RANKS).count() == 0
    files, order, folder = separators.write_flat(d, P.path("byte_bpe_50k.json"))
    assert separators.scan(files, folder).count() == order.count() == 0
    assert mixing.mix_documents(d).count() == quality.filter_documents(d).count() == 0
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_encoded_offsets_lead_back_to_the_text(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "it's  they'll\n\n café 12³  中文!?  ", "x" * 4000, "the tree " * 900]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    for r in bpe.encode(df, RANKS).collect():
        text = "" if r["doc_id"] == 9 else texts[r["doc_id"]]
        ids, raw, offs = np.frombuffer(r["ids"], "<u4").tolist(), text.encode(), r["offsets"]
        assert ids == enc.encode_ordinary(text) and offs[-1] == len(raw)
        assert [raw[a:b] for a, b in zip(offs, offs[1:])] == [enc.decode_single_token_bytes(i) for i in ids]


def test_top_k_ties_repeated_rows_and_sparse_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 16)
    monkeypatch.setattr(topk, "MOST_BLOCK", 16)
    r = random.Random(3)
    v = [(i, [float(r.choice([0, 0, 0, 1, 2, -1])) for _ in range(r.choice([4, 6]))]) for i in range(150)]
    v += [(7, v[7][1]), (50, v[50][1]), (151, [2.0**40] * 4), (152, [])]
    q = topk.quantised(spark.createDataFrame(v, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.search(q.filter("vec_id % 50 = 0"), q).collect()))
    want = []
    for i in (0, 50, 100):
        mine = next(e for k, e in v if k == i)
        s = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(mine, e)), j) for j, e in v if j != i)[:5]
        want += [(i, k, j, -x) for k, (x, j) in enumerate(s, 1)]
    assert got == want


def test_postings_scatter_like_a_product():
    r = np.random.default_rng(4)
    for share in (0.1, 0.9, 1.0):
        q, v = (r.integers(1, 300, (n, 9)) * (r.random((n, 9)) < share) for n in (17, 40))
        for kind in (np.float64, np.int64):
            assert (topk.accumulate(q.astype(kind), topk.inverted(v, kind), len(v)) == q @ v.T).all()


def best_split(label: str, counts: dict, total: int) -> float:
    """Log probability of the likeliest split, over all splits."""
    cost = lambda w: math.log(counts[w] / total) if w in counts else -math.log(max(total, 2)) - len(w) * math.log(10)
    if not label:
        return 0.0
    return max(cost(label[:k]) + best_split(label[k:], counts, total) for k in range(1, len(label) + 1))


def test_viterbi_finds_the_likeliest_split():
    r = random.Random(6)
    counts = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(15)}
    total = sum(counts.values())
    for _ in range(60):
        label = "".join(r.choice("abc") for _ in range(r.randint(1, 11)))
        split = urls.viterbi(label, counts, total)
        mine = sum(math.log(counts[w] / total) if w in counts else -math.log(total) - len(w) * math.log(10) for w in split)
        assert "".join(split) == label and mine == pytest.approx(best_split(label, counts, total))
    long = "supercalifragilisticexpialidocious"
    assert urls.viterbi("the" + long, {long: 3, "the": 9, "super": 50}, 62) == ["the", long]


def brute_urls(data: list[tuple]) -> list[float]:
    """Scores recomputed in plain Python."""
    counts: Counter = Counter()
    for _, _, html in data:
        counts.update(w for w in re.findall("[a-z]+", re.sub(r"<[^>]*>", " ", html or "").lower()) if 2 <= len(w) <= 63)
    bad_words = {x for s in urls.SEEDS for x in (s, *urls.INFLECTED.get(s, ()))}
    counts.update({w: 1 for w in bad_words if w not in counts})
    total, pages = sum(counts.values()), []
    for _, url, _ in data:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0].lower()
        split = [w for label in re.findall("[a-z]+", host.lower()) for w in urls.viterbi(label, counts, total)]
        tokens = [x for x in re.split(r"[\W_]+", re.sub("[0-9]+", "0", path)) if x]
        pages.append((["h:" + w for w in split] + ["p:" + x for x in tokens], bool(bad_words & set(split))))
    seen: dict = {True: Counter(), False: Counter()}
    for ts, bad in pages:
        seen[bad].update(ts)
    size, v = {k: sum(c.values()) for k, c in seen.items()}, len(seen[True] | seen[False])
    odds = lambda t: math.log((seen[True][t] + 1) / (size[True] + v + 1)) - math.log((seen[False][t] + 1) / (size[False] + v + 1))
    prior = math.log((1 + sum(b for _, b in pages)) / (1 + sum(not b for _, b in pages)))
    return [prior + sum(map(odds, ts)) for ts, _ in pages]


def test_urls_by_brute_force_and_beyond_the_seeds(spark):
    r = random.Random(9)
    shady, fine = ["jackpot", "slots", "bonus", "lucky", "spins"], ["garden", "river", "school", "museum", "recipes"]
    seeds = ["casino", "poker", "bets"]
    text = " ".join(shady + fine + seeds + ["news", "about"]) * 3
    data, hidden, k = [], set(), 0
    for _ in range(120):
        words = r.sample(shady, 2)
        if r.random() < 0.25:  # a bad host that no seed gives away
            hidden.add(k)
        else:
            words.insert(r.randrange(3), r.choice(seeds))
        data.append((k, f"http://{''.join(words)}.example.test/play/{r.randrange(99)}", text))
        k += 1
    good = range(k, k + 200)
    data += [(j, f"https://{''.join(r.sample(fine, 2))}.example.test/{r.choice(['news', 'about'])}/{r.randrange(99)}?q=1", text) for j in good]
    data += [(900, None, None), (901, "none", "<p>casino"), (5, data[5][1], text)]
    rows = urls.judged(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    got, want = sorted((x["page_id"], x["score"]) for x in rows), sorted((i, s) for (i, *_), s in zip(data, brute_urls(data)))
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)
    blocked = {x["page_id"] for x in rows if x["verdict"] == "block"}
    assert len(hidden) > 15 and hidden <= blocked and not blocked & set(good) and 900 not in blocked
