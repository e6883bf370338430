"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("quillgraph.llm")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillgraph.llm import bpe, licenses, minhash, mixing, quality, scoring, separators, tokenfile, topk, urls  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def made() -> list[tuple]:
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeiounrst") for _ in range(r.randint(1, 7))) for _ in range(300)]
    texts: list = [None, "", " \t\n ", "one", "Two words", "x" * 5000, "it's  they'll\n\n café 12³  !?  "]
    for _ in range(40):
        texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 200))))
    base = [r.choice(vocabulary) for _ in range(150)]
    for k in range(12):  # near copies
        w = list(base)
        w[r.randrange(150)] = f"changed{k}"
        texts.append(" ".join(w).upper() if k % 2 else " ".join(w))
    texts += [texts[10]] * 3 + ["same line here\n" * 30, "### $$$ %%% " * 40, " ".join(vocabulary) * 20]
    out = [(i, t, ["en", None][i % 7 == 0], ["a", "b", "c", None][i % 4], len(t or ""), 1) for i, t in enumerate(texts)]
    return out + [(None, "no id at all here", "en", "a", 3, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_measures(docs, empty):
    got = rows(quality.assess(docs))
    for i, t, *_ in made():
        w = words(t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + o for k, x in enumerate(win) if win.count(x) > 1 for o in range(3)} if len(win) < 3000 else None
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        if rep is not None:
            assert r["n_repeat_words"] == len(rep)
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.assess(empty).count() == 0
    assert quality.filter_documents(docs).columns == docs.columns


def test_mix_reaches_targets(docs, empty):
    out = mixing.mix(docs).collect()
    for s in ("a", "b", "c", None):
        mine = [r for r, d in ((r, d) for r in out for d in made() if d[0] == r["doc_id"]) if d[3] == s]
        assert sum(r["taken"] for r in mine) == math.floor(mine[0]["target"] + 0.5)
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert sum({r["source_size"]: r["target"] for r in out}.values()) == pytest.approx(sum(r["size"] for r in out))
    assert out == mixing.mix(docs.repartition(2)).collect()
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and {r["text"] for r in mixed.collect()} <= {t for _, t, *_ in made()}


def closure(found: dict, percent: int = 80, size: int = 4) -> dict:
    """Least id of each id's component, by comparing all pairs and following chains to their end. found: id to texts."""
    sets = []
    for i, texts in found.items():
        for t in texts:
            w = words(lowered(t))
            sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())))
    label = {i: i for i in found}
    linked = [(i, j) for i, a in sets for j, b in sets if a and b and i < j and 100 * len(a & b) >= percent * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_near_duplicates(docs, empty):
    got = rows(minhash.components(docs))
    assert {i: got[i]["component_id"] for i in got if i is not None} == closure({i: [t] for i, t, *_ in made() if i is not None})
    for i, t, *_ in made():
        w = words(lowered(t))
        assert got[i]["n_shingles"] == (len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) or bool(w))
    assert minhash.components(empty).count() == 0 and minhash.filter_documents(empty).count() == 0


def test_near_duplicates_by_chains_repeated_ids_and_clashing_columns(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    chain = []
    for k in range(9):  # each link changes more words; the ends share nothing like 80 %
        chain.append((100 - k, " ".join(base)))
        base[10 * k + 5] = f"n{k}"
        base[10 * k + 9] = f"m{k}"
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    data = [*chain, (3, x), (5, x), (5, y), (7, y), (7, y), (9, None), (9, "alone with few"), (None, x)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in data], "doc_id long, text string, gone long, node long, doc long")
    found: dict = {}
    for i, t in data:
        if i is not None:
            found.setdefault(i, []).append(t)
    want = closure(found)
    for i, j in ((5, 3), (7, 3)):  # by the id that they share
        assert want[i] == j
    for r in minhash.components(df).collect():
        assert r["component_id"] == (None if r["doc_id"] is None else 9 if r["doc_id"] == 9 else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])
    out = minhash.filter_documents(df)
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == sorted([0, 3, 9, 9, *{v for i, v in want.items() if i > 50}])


def test_chunks_find_links_between_components(spark):
    a, b = np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64)
    side = lambda node, s: [(node, node, s.tobytes())]
    kind = "array<struct<node:long,l:long,set:binary>>"
    met = spark.createDataFrame([(side(1, a), side(2, b)), (side(1, a), side(3, b + np.uint64(60)))], f"x {kind}, y {kind}")
    assert [tuple(r) for r in met.mapInArrow(lambda it: minhash.across(it, 80), "a long, b long").collect()] == [(1, 2)]


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    d = spark.createDataFrame([(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-licence").replace(",", " ;")), (3, mit + " more"), (4, None), (5, " ")], "doc_id long, text string")
    got = rows(licenses.scan(d, licenses.known_licenses(spark), len(licenses.KNOWN)))
    assert [got[k]["license_id"] for k in range(1, 6)] == ["MIT", "MIT", None, None, None] and got[4]["digest"] is None


def test_top_k(spark):
    r = random.Random(1)
    v = [(i, [r.choice([0.0, 0.5, -0.25, r.random()]) for _ in range(8)]) for i in range(120)] + [(200, None), (201, [None] * 8), (202, [float("nan")] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    q = topk.quantised(df)
    got = sorted(map(tuple, topk.search(q.filter("vec_id % 50 = 0"), q).collect()))
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in v[:120]}
    want = []
    for i in (0, 50, 100):
        s = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in ints if j != i)[:5]
        want += [(i, k, j, -x) for k, (x, j) in enumerate(s, 1)]
    assert got == want
    assert topk.search(q.limit(0), q.limit(0)).count() == 0


def test_token_files_and_separators(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    got, counts = rows(tokenfile.read_files(*tokenfile.write_files(docs, path, block_ids=500))), {}
    files, order, folder = separators.write_flat(docs, path)
    for r in separators.scan(files, folder, block_ids=64).join(order, ["file", "ordinal"]).collect():
        counts[r["doc_id"]] = r["n_tokens"]
    start = 0
    for i, text, *_ in sorted(made(), key=lambda d: (d[0] is not None, d[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.array([*ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(raw), zlib.crc32(raw.tobytes()))
        assert counts[i] == len(plain.encode(text or "", add_special_tokens=False).ids)
        start += len(raw)
    assert tokenfile.read_files(*tokenfile.write_files(empty, path)).count() == 0


def test_block_code_round_trip():
    ids = np.array([5, 70_000, 5, 2**31, 9, 5], np.uint32)
    docs, lengths, back = tokenfile.decode_block(tokenfile.encode_block([None, 3], [2, 4], ids))
    assert docs == [None, 3] and lengths.tolist() == [2, 4] and back.tolist() == ids.tolist()


def test_byte_bpe_equals_library(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.digests(docs, RANKS))
    for i, t, *_ in made():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(ids.tobytes()), sha((t or "").encode()))
    r, rng = bpe.Ranks(RANKS), random.Random(2)
    parts = list(" '\n\tab1²٣é中!\x1c\x85　") + ["'s", "'ll", "'re", " '", "  ", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in r.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_urls(spark):
    good, bad = "news of the garden and the tree " * 5, "cheap pills casino spam win " * 5
    data = [(k, f"http://www.gardentree{k % 3}.example.org/en/{k}", good) for k in range(30)] + [(100 + k, f"https://cheappillscasino.example.org/fr/win{k}", bad) for k in range(10)]
    data += [(200, "http://a.example.com/en/7x", ""), (201, "http://EXAMPLE.com/en/8", ""), (202, None, None), (203, "nothing", ""), (204, "http://com/en/?q", None)]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert {got[k]["verdict"] for k in range(30)} == {"allow"} and {got[100 + k]["verdict"] for k in range(10)} == {"block"}
    assert (got[200]["rule"], got[200]["verdict"]) == ("example.com/en/7", "allow") and (got[201]["rule"], got[201]["host"]) == ("com/en/", "example.com")
    assert got[202]["host"] == got[203]["path"] == "" and got[204]["verdict"] == "block"


def test_pitman_yor(docs, empty):
    got = rows(scoring.score(docs))
    training = [lowered(t) for i, t, *_ in made() if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    n = sum(len(words(t)) + 1 for t in training)
    assert all(r["train_tokens"] == n for r in got.values())
    assert all(got[i]["n_tokens"] == len(words(t)) + 1 and got[i]["score"] < 0 for i, t, *_ in made())
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert scoring.score(empty).count() == 0


def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "source_mix", "byte_bpe"]
    d = docs.drop("size").withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns
        d = out
    assert pipeline.STAGES[-1][1](spark, d, "").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
