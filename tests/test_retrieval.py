"""Retrieval by tokens against all pairs, and that a token of all texts joins few of them."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names, persons


def texts(seed: int, n: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    rare = [f"w{k}" for k in range(60)]
    out = [(k, " ".join(["university", *r.choices(rare, k=r.randint(0, 6)), *r.choices(["of", "the"], k=r.randint(0, 2))])) for k in range(n)]
    return [*out, (n, ""), (n + 1, None), (n + 2, "--"), (n + 3, "University!"), (n + 4, " ".join(rare))]


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 2 / 3, 0.8, 1.0])
def test_token_jaccard_equals_all_pairs(spark, least):
    left, right = texts(1, 120), texts(2, 90)
    sets = [[(i, set((t or "").lower().replace("!", " ").replace("-", " ").split())) for i, t in x] for x in (left, right)]
    want = {(i, j): len(a & b) / len(a | b) for i, a in sets[0] for j, b in sets[1] if a & b and len(a & b) / len(a | b) >= least}
    got = names.token_jaccard(*(spark.createDataFrame(x, "id long, text string") for x in (left, right)), least).collect()
    assert len(got) == len(want) and all(r["jaccard"] == pytest.approx(want[r["id_a"], r["id_b"]]) for r in got)
    nobody = spark.createDataFrame([], "id long, text string")
    assert names.token_jaccard(nobody, nobody, least).count() == 0


def test_tiers_by_words_equal_all_pairs(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(25)]
    known = [(k, " ".join(["common", *r.sample(words, r.randint(1, 5))]), None, None, r.choice(["AA", "BB"])) for k in range(60)]
    asked = [(k, " ".join(["common", *r.sample([*words, "other"], r.randint(0, 5)), "zz"]), r.choice(["AA", None])) for k in range(80)]
    got = persons.institution_tiers(spark.createDataFrame(asked, "id long, inst string, country_code string"), spark.createDataFrame(known, "institution_idx long, display_name string, alternatives array<string>, acronyms array<string>, country_code string"), 0.6)
    hits = 0
    for row in got.collect():
        _, inst, cc = asked[row["id"]]
        a = set(inst.split())
        found = sorted((-len(a & set(x.split())) / len(a), k) for k, x, _, _, c in known if cc in (None, c) and a & set(x.split()))
        best = found[0] if found and -found[0][0] >= 0.6 else None
        assert (row["score"], row["institution_idx"]) == ((pytest.approx(-best[0]), best[1]) if best else (None, None))
        hits += best is not None
    assert 5 < hits < 80


def test_prefixes_leave_common_tokens_out(spark):
    d = spark.createDataFrame([(k, f"university x{k} y{k}") for k in range(200)], "id long, text string")
    sets = names.by_rarity([d.select("id", names.tokens(F.col("text")).alias("set"))])[0]
    assert sets.filter(F.col("set")[2] == "university").count() == 200
    assert sets.filter(F.array_contains(F.slice("set", 1, names.prefix(F.size("set"), F.size("set") * 0.6)), "university")).count() == 0
