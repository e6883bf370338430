"""Line dedup, hard negatives and vector codes against brute force; cuckoo filters; changes of a line index and back."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("quillgraph.llm")
from pyspark.sql import functions as F  # noqa: E402

from quillgraph.llm import linededup, negatives, vectorcode  # noqa: E402
from quillgraph.llm.cuckoo import Cuckoo, Full  # noqa: E402
from quillgraph.llm.linededup import LineIndex  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int"


def test_a_cuckoo_filter_forgets_what_it_is_told_to():
    r = np.random.default_rng(3)
    f, held = Cuckoo(6000), defaultdict(int)
    for _ in range(12):
        new = r.integers(0, 2**63, 400, dtype=np.uint64)
        some = np.concatenate([new, new[:100]])
        f.insert(some)
        for h in some.tolist():
            held[h] += 1
        gone = np.array(r.choice(sorted(held), 150, replace=False), np.uint64)
        f.delete(gone)
        for h in gone.tolist():
            held[h] -= 1
            if not held[h]:
                del held[h]
        keys = np.array(sorted(held), np.uint64)
        assert (f.copies(keys) >= [held[k] for k in keys.tolist()]).all()
        assert f.fill.sum() == sum(held.values()) == np.count_nonzero(f.table)
        assert Cuckoo.of_bytes(f.to_bytes()).copies(keys).tolist() == f.copies(keys).tolist()
    strange = r.integers(0, 2**63, 20_000, dtype=np.uint64)
    assert (f.copies(strange) > 0).mean() < 0.002
    with pytest.raises(Full):
        Cuckoo(8).insert(np.arange(1000, dtype=np.uint64) << np.uint64(48))
    with pytest.raises(KeyError):
        Cuckoo(8).delete(np.array([77], np.uint64))


def lines_by_hand(rows):
    """The contract in plain Python: id to (n_lines, n_dropped, kept text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(n, start=0, seed=1):
    r = random.Random(seed)
    pool = [f"Shared LINE number {k} é" for k in range(30)] + ["short", "123456789", "0123456789", "éééééééééé", "  padded \t line here \r"]
    return [(start + i, "\n".join([r.choice(pool) for _ in range(r.randint(0, 6))] + ["a line of everyone", f"line of {start + i} alone"][: r.randint(0, 2)])) for i in range(n)]


def changed(index, docs):
    return sorted(map(tuple, linededup.rewritten(docs, index.losing(linededup.postings(docs))).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def state_of(index):
    out = {}
    for r in index.state.collect():
        s = linededup.Shard.read(r["filter"], r["refs"])
        assert (s.filter.copies(s.refs.h2.view(np.uint64)) >= s.refs.copies()).all() and s.filter.fill.sum() == s.refs.copies().sum()
        out |= {(a, b): tuple(x) for a, b, *x in zip(*(a.tolist() for a in s.refs.arrays()))}
    return out


def test_line_dedup(spark):
    rows = line_rows(120) + [(None, "a line of everyone"), (500, None), (501, ""), (7, "again the line of seven\nagain the line of seven"), (502, "Again the LINE of seven  "), (503, ("very long " * 9 + "\n") * 3000 + "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("h1"), F.lit("y").alias("lost")).repartition(5)
    got = sorted(map(tuple, linededup.dedup(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    assert got == lines_by_hand(rows)
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_line_index_goes_there_and_back(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD", 40)  # several shards, and more of them later
    a, b = line_rows(60), line_rows(90, start=-50, seed=2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = LineIndex(spark).insert(frame(a))
    b = [(i, t) for i, t in b if i < 0]  # smaller ids than all of a: they take over every shared line
    two = one.insert(frame(b))
    assert two.shards > 1 and changed(two, frame(a + b)) == lines_by_hand(a + b)
    assert state_of(two) == state_of(LineIndex(spark).insert(frame(a + b)))
    back = two.delete(frame(b).select("doc_id"))
    assert state_of(back) == state_of(one) and changed(back, frame(a)) == lines_by_hand(a)
    some = [(i, t) for i, t in a if i % 3 == 0]
    less = back.delete(frame(some).select("doc_id"))
    assert changed(less, frame([x for x in a if x not in some])) == lines_by_hand([x for x in a if x not in some])
    assert state_of(less.insert(frame(some))) == state_of(one)
    assert LineIndex(spark).delete(frame(a)).total == 0


def vectors(n, dims=32, seed=4, clusters=6):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(clusters, dims)) * 0.3
    out = [(i, [float(np.float32(x)) for x in mid[r.integers(clusters)] + r.normal(size=dims) * 0.1], int(r.integers(4))) for i in range(n)]
    out += [(n + 1, None, 1), (n + 2, [None] + [0.5] * (dims - 1), 2), (n + 3, [float("nan")] * dims, 0), (n + 4, [float("inf")] * dims, 0), (n + 5, out[3][1], None), (None, out[4][1], 2), (n + 6, [], 1), (n + 7, [0.25] * 5, 1)]
    return out + [(n + 10 + k, out[0][1], 3) for k in range(40)]  # one common vector


def negatives_by_hand(rows, anchors):
    rows = [(i, y, np.array(w)) for i, y, w in rows]
    dims = max(len(w) for *_, w in rows)
    rows = [(i, y, np.pad(w, (0, dims - len(w)))) for i, y, w in rows]
    out = []
    for a, y, q in (x for x in rows if x[0] in anchors):
        score = [(-int(q @ w), i, z) for i, z, w in rows if i != a]
        for p, i, _ in sorted(x for x in score if x[2] == y)[:5]:
            far = [x for x in sorted(x for x in score if x[2] != y) if -50 * p <= -100 * x[0] <= -95 * p]
            out += [(a, i, k + 1, x[1], -p, -x[0]) for k, x in enumerate(far[:3])]
    return sorted(out)


@pytest.mark.parametrize("waves", [negatives.WAVES, (1, 2, 3, negatives.K_MOST)])
def test_hard_negatives(spark, monkeypatch, waves):
    monkeypatch.setattr(negatives, "WAVES", waves)
    monkeypatch.setattr(negatives, "LEAST_PART", 20)
    made = vectors(400)
    df = spark.createDataFrame(made, VECTORS).select("*", F.lit(1).alias("score"), F.lit("x").alias("list")).repartition(3)
    rows = negatives.labelled(df, F.col("label"))
    held = sorted((r["vec_id"], r["label"], r["w"]) for r in rows.collect())
    assert len(held) == 400 + 2 + 40
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, negatives.mine(rows, rows.filter("vec_id % 20 = 0")).select(cols).collect()))
    want = negatives_by_hand(held, {i for i, *_ in held if i % 20 == 0})
    assert got == want and len(got) > 50
    empty = negatives.labelled(df, F.col("label")).limit(0)
    assert negatives.mine(empty, empty).count() == 0
    one = rows.filter("vec_id = 0")
    assert negatives.mine(one, one).count() == 0


def test_clusters_are_skipped_only_if_they_cannot_matter():
    """A bound equal to the k-th score is visited, one strictly below is not; windows exclude clusters from both sides."""
    c = np.array([[10.0, 0], [0, 10.0], [-10.0, 0]])
    ix = negatives.Index(None, c, np.zeros(3), np.ones(3, np.int64), np.arange(3), 2)
    ask = lambda lo, hi, kth: sorted(negatives.visits(ix, np.array([[1, 0]]), np.array([lo]), np.array([hi]), [np.array([kth])], [(0, 1)], 0, 3)[1].tolist())
    big = negatives.NO_MOST
    assert ask(-big, big, 0) == [0, 1] and ask(-big, big, 1) == [0] and ask(-big, big, -10) == [0, 1, 2]
    assert ask(-big, 5, -big) == [1, 2] and ask(-5, 5, -big) == [1] and ask(11, big, -big) == []


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, label, integers), in order of ids."""
    x = np.array([w for *_, w in rows]).reshape(len(rows), parts, -1)
    book = x[:entries].copy()
    for step in range(rounds + 1):
        d = ((x[:, None] - book[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=1)
        if step < rounds:
            for p in range(parts):
                for k in range(len(book)):
                    mine = x[code[:, p] == k, p]
                    if len(mine):
                        book[k, p] = mine.sum(axis=0) // len(mine)
    error = np.take_along_axis(d, code[:, None], 1).sum(axis=(1, 2))
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for k in range(len(book)) for v in book[k, p]).encode()).hexdigest()
    total = defaultdict(int)
    for (_, y, _), e in zip(rows, error):
        total[y] += int(e)
    return {(i, "".join(f"{k:02x}" for k in code[n]), int(error[n]), total[y], digest) for n, (i, y, _) in enumerate(rows)}


@pytest.mark.parametrize("n", [300, 20])
def test_vector_codes(spark, n):
    made = [v for v in vectors(n) if v[1] is None or len(v[1]) == 32]
    df = spark.createDataFrame(made, VECTORS).select("*", F.lit(1).alias("error"), F.lit("x").alias("w")).repartition(7)
    codes, books = vectorcode.compress(df)
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"], vectorcode.digest_of(books)) for r in vectorcode.with_label_errors(codes).collect()}
    held = [(r["vec_id"], r["label"], r["w"]) for r in vectorcode.quantised(df).orderBy(F.col("vec_id").asc_nulls_last()).collect()]
    assert got == codes_by_hand(held)
    assert len(held) == n + 2 + 40 and len({r[1] for r in got}) > 1
    back = {r["vec_id"]: r["w"] for r in vectorcode.decoded(codes, books).collect()}
    error = {r["vec_id"]: r["error"] for r in codes.collect()}
    assert all(sum((a - b) ** 2 for a, b in zip(w, back[i])) == error[i] for i, _, w in held)


def test_vector_codes_of_odd_tables(spark):
    codes, books = vectorcode.compress(spark.createDataFrame([], VECTORS))
    assert codes.count() == 0 and vectorcode.with_label_errors(codes).count() == 0 and books.size == 0
    rows = [(1, [0.5] * 20, 1), (1, [0.25] * 20, 1), (2, [1.0], None), (3, [], None)]  # unlike lengths, a repeated id
    codes, books = vectorcode.compress(spark.createDataFrame(rows, VECTORS))
    assert books.shape == (16, 4, 2) and [r["error"] for r in codes.collect()] == [0] * 4
