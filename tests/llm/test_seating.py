"""The Pitman-Yor model: numbers, single draws, the score against brute force, and draws that no partitioning changes."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillgraph.llm")
from quillgraph.llm import packing, scoring, seating  # noqa: E402

SMALL = scoring.Model(block_tokens=300, part_pairs=400, range_tokens=500)


def test_packing_round_trip():
    a = [np.array([1, 300, 7], np.uint64), np.array([-5, 2**40], np.int64), np.zeros(0, np.uint64), np.array([0.5, -1.25], np.float32), np.array([3, 9, 2**60], np.uint64)]
    got = packing.unpack(packing.pack(*a[:4], packing.gaps(a[4])))
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(a, got[:4])) and (packing.from_gaps(got[4]) == a[4]).all()


def test_stirling_numbers():
    d, s = 0.6, {(0, 0): 1.0}
    for c in range(12):
        for t in range(c + 2):
            s[c + 1, t] = s.get((c, t - 1), 0.0) + (c - d * t) * s.get((c, t), 0.0)
    got = np.exp(seating.stirling(d)[:13, :13])
    assert all(got[c, t] == pytest.approx(max(v, 0.0)) for (c, t), v in s.items() if t and c)
    assert seating.lgamma(np.array([0.1, 1.0, 77.5])) == pytest.approx([math.lgamma(x) for x in (0.1, 1.0, 77.5)], abs=1e-9)
    exact, log = np.full(1500, -np.inf), -np.inf
    exact[0] = 0.0
    for c in range(1, 1400):  # row by row, far beyond the table
        stay = exact + np.log(np.maximum(c - d * np.arange(1, 1501), 1e-300))
        exact = np.logaddexp(stay, np.concatenate([[log], exact[:-1]]))
    t = np.array([1, 2, 7, 40, 200, 900])
    assert seating.numbers(np.full(6, 1400), t, d) == pytest.approx(exact[t - 1], abs=0.05)


@pytest.mark.parametrize("c", [3, 20])
def test_tables_of_a_dish_are_those_of_customers_seated_one_by_one(c):
    """All seatings of c customers that one by one take a table of n customers with n - d, a new one with (s + d t) p, weighed by
    what the draws leave out, have the drawn number of tables."""
    d, s, p, n = 0.6, 1.5, 0.3, 6000
    rng, t, weight = np.random.default_rng(1), np.ones(n), np.zeros(n)
    for k in range(1, c):
        new, old = (s + d * t) * p, k - d * t
        weight += np.log(new + old)
        t += rng.random(n) < new / (new + old)
    weight = np.exp(weight - weight.max())
    got = seating.drawn(np.full(n, c), np.zeros(n), np.full(n, p), None, d, s, rng)
    assert got.mean() == pytest.approx((t * weight).sum() / weight.sum(), rel=0.06) and got.min() >= 1 and got.max() <= c


def test_tables_of_many_customers():
    d, s, p, c = 0.6, 1.5, 0.3, 700
    log = np.full(c + 1, -np.inf)
    log[1] = 0.0
    for k in range(1, c):
        log[1:] = np.logaddexp(log[1:] + np.log(np.maximum(k - d * np.arange(1, c + 1), 1e-300)), log[:-1])
    t = np.arange(1, c + 1)
    w = log[1:] + np.cumsum(np.log((s + d * (5 + t - 1)) * p))
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    got = seating.drawn(np.full(8000, c), np.full(8000, 5), np.full(8000, p), None, d, s, np.random.default_rng(1))
    assert got.mean() == pytest.approx((w * t).sum(), rel=0.03) and got.std() == pytest.approx(np.sqrt((w * t**2).sum() - (w * t).sum() ** 2), rel=0.06)


def texts() -> list[tuple]:
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    out = [(k, " ".join(words[min(39, int(x))] for x in r.zipf(1.5, r.integers(1, 60)))) for k in range(60)]
    return out + [(100, None), (101, " \n"), (None, "no id"), (7, "W1 w2"), (7, "W1 w2"), (103, "w1 " * 900), (104, "never seen words only")]


@pytest.fixture(scope="module")
def scored(spark):
    d = spark.createDataFrame([(*x, 1, "a") for x in texts()], "doc_id long, text string, n long, at string")
    return d, scoring.score(d.repartition(3), SMALL).collect()


def test_base_and_counts_by_brute_force(scored):
    cut = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if w] + ["<end>"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts() if not held(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for i, t in texts())
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored[1])
    assert got == want and all(r["score"] < 0 for r in scored[1])
    assert sum(r["score"] for r in scored[1]) > sum(r["base_score"] for r in scored[1])


def test_no_partitioning_changes_a_score(scored):
    other = scoring.score(scored[0].repartition(1), scoring.Model(**{**SMALL.__dict__, "block_tokens": 1000})).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in rows)
    assert key(other) == key(scored[1])
    p = {r["held_out"]: r for r in scoring.perplexity(scored[0].sparkSession.createDataFrame(scored[1])).collect()}
    assert p[False]["perplexity"] < p[False]["base_perplexity"]


def test_chances_sum_to_one():
    """Of a context's words and the unknown one, with any seats."""
    r = np.random.default_rng(0)
    v, d, s = 30, 0.7, 1.3
    c = r.integers(0, 9, v) * (r.random(v) < 0.5)
    t = np.where(c > 0, 1 + (r.random(v) * (c - 1)).astype(int), 0)
    above = r.integers(1, 9, v)
    served = np.minimum(above, 1 + r.integers(0, 3, v))
    root = scoring.Root(0.4, 2.0, int(above.sum()), int(served.sum()), 1 / (v + 1))
    words = np.append(root.chance(above, served), root.chance(np.zeros(1), np.zeros(1)))
    assert words.sum() == pytest.approx(1)
    chance = (np.append(np.maximum(c - d * t, 0), 0) + (s + d * t.sum()) * words) / (s + c.sum())
    assert chance.sum() == pytest.approx(1)
