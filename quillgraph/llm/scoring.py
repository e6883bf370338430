"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Each preceding word is a restaurant whose customers are the words that follow it in training texts; all share the parent
restaurant of single words, whose customers are their tables, and whose base is uniform over the vocabulary and one unknown
word. Seatings are sampled by Gibbs (seating.py), contexts and parent in turn, discounts and strengths of both levels with them;
after burn-in, predictive probabilities are averaged over samples.

How it runs. Texts become blocks of word numbers, written once to files; everything later reads the blocks. Words are numbered by
ranges of their hashes, pairs dealt to parts by their context (a very frequent context by the pair), and each exchange
between blocks, parts and ranges is a shuffle of packed arrays: a block sends each pair once, however many of its documents hold
it, and gets one number back for it. Contexts sample inside their part, the parent inside a range; tables and customers go
between them once a sweep. Parts, ranges and the order inside them follow from the words alone, and so do the draws: any
partitioning of the input, and any retried task, gives the same scores.

Cases. Null or blank text: its end token alone. Null id: its crc32 is that of the empty text. Repeated rows: each
learned from and scored. Very long text: a block of its own size. Ties: none, nothing is ranked. No training text: a uniform
model of one unknown word. Empty table: empty result. Extra columns, of any name: ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seating
from .common import Hashes, byte_words, mix64, shared_path, table, written
from .packing import from_gaps, gaps, pack, unpack
from .shards import Reader, Shard


@dataclass(frozen=True)
class Model:
    burn_in: int = 2  # sweeps before the first kept one
    samples: int = 2
    folds: int = 7
    held: int = 2
    seed: int = 17
    block_tokens: int = 2_000_000
    part_pairs: int = 2_000_000
    range_tokens: int = 5_000_000
    #: a context of more customers, and of more than this share of all, is dealt by pairs
    hot: int = 500_000
    hot_share: float = 5e-5


PRODUCTION = Model()
END = 2  # a hash that no word is given
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ROW_REST = ["name", "place", "bytes", "n", "x", "y", "z"]
ROW = "at long, of long, name string, place long, bytes long, n long, x binary, y binary, z binary"


def record(rows: list[dict]) -> pa.Table:
    kinds = {"at": pa.int64(), "of": pa.int64(), "name": pa.string(), "place": pa.int64(), "bytes": pa.int64(), "n": pa.int64(), "x": pa.binary(), "y": pa.binary(), "z": pa.binary()}
    return pa.table({k: pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items()})


def grouped(df: DataFrame, n: int, f) -> DataFrame:
    """f (of a list of rows with one `at`, in order of `of`) over all groups, written; a group is a task's, groups are many."""

    def run(t: pa.Table) -> pa.Table:
        return record(list(f(t.sort_by("of").to_pylist())))

    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, min(2 * n, 20_000))
    return df.repartition(parts, "at").groupBy("at").applyInArrow(run, ROW)


# texts to blocks


def write_blocks(docs: DataFrame, folder: str, m: Model) -> DataFrame:
    """Blocks (at: number; name, place, bytes: file; n: tokens). A file's block holds document ids, null flags, held-out
    flags, lengths, the distinct words' hashes, their counts in training, and the tokens as numbers of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shard, rows, held, size = Hashes(), None, [], [], 0

        def flush() -> dict:
            flat = np.concatenate([h for _, _, h in held])
            words, seq = np.unique(flat, return_inverse=True)
            lengths, out = np.array([len(h) for _, _, h in held], np.uint64), np.array([o for _, o, _ in held], np.uint8)
            learnt = np.bincount(seq[np.repeat(out == 0, lengths.astype(np.int64))], minlength=len(words)).astype(np.uint64)
            ids = np.array([0 if d is None else d for d, _, _ in held], np.int64)
            data = pack(ids, np.array([d is None for d, _, _ in held], np.uint8), out, lengths, words, learnt, seq.astype(np.uint32))
            row = {"at": (TaskContext.get().partitionId() << 33) + len(rows), "name": shard.name, "place": shard.write(data), "bytes": len(data), "n": len(flat)}
            held.clear()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard is None:
                    shard = Shard(folder, TaskContext.get().partitionId(), TaskContext.get().taskAttemptId())
                h = hashes.of([*byte_words(text.as_py()), b""])
                h[-1] = END
                out = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m.folds == m.held
                held.append((doc_id, out, h))
                size += len(h)
                if size >= m.block_tokens:
                    rows.append(flush())
                    size = 0
        if held:
            rows.append(flush())
        if shard is not None:
            shard.close()
            yield from record(rows).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW)


def send_words(blocks: DataFrame, folder: str, ranges: int) -> DataFrame:
    """Of each block and range of hashes: the hashes and their counts in training."""
    starts = np.array([-(-(r << 64) // ranges) for r in range(ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, _, words, learnt, _ = unpack(reader.read(row["name"], row["place"], row["bytes"]))
                words, cuts = words.astype(np.uint64), [*np.searchsorted(words.astype(np.uint64), starts).tolist(), len(words)]
                out = [{"at": r, "of": row["at"], "x": pack(gaps(words[a:b])), "y": pack(learnt[a:b])} for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield from record(out).to_batches()

    return blocks.mapInArrow(run, ROW)


def number_words(rows: list[dict]) -> Iterator[dict]:
    """A range's words (of: -1; n of them; x: counts), and each block's numbers and counts of its words there."""
    got = [from_gaps(unpack(r["x"])[0]) for r in rows]
    words, back = np.unique(np.concatenate(got), return_inverse=True)
    c = np.bincount(back, np.concatenate([unpack(r["y"])[0] for r in rows]).astype(np.float64), len(words)).astype(np.uint64)
    yield {"at": rows[0]["at"], "of": -1, "n": len(words), "place": int((c > 0).sum()), "bytes": int(c.sum()), "x": pack(c)}
    at = 0
    for r, g in zip(rows, got):
        i = back[at : at + len(g)]
        yield {"at": rows[0]["at"], "of": r["of"], "x": pack(gaps(i)), "y": pack(c[i])}
        at += len(g)


# blocks to pairs


@dataclass
class Numbered:
    """A block with global word numbers and its distinct pairs, in order of their parts."""

    ids: list
    held: np.ndarray
    starts: np.ndarray
    counts: np.ndarray  # of each token's word, in training
    key: np.ndarray  # distinct pairs, ascending: context << 32 | word
    back: np.ndarray  # each token's pair
    part: np.ndarray  # of each pair
    learnt: np.ndarray  # tokens of each pair in training


def numbered(rows: list[dict], folder: str, bases: np.ndarray, parts: int, hot: int) -> Numbered:
    """rows: the block's own (of: -1), then of each range its numbers and counts."""
    own, rows = rows[0], rows[1:]
    docs, null, held, lengths, words, _, seq = unpack(Reader(folder).read(own["name"], own["place"], own["bytes"]))
    number = np.concatenate([from_gaps(unpack(r["x"])[0]) + np.uint64(bases[r["of"]]) for r in rows])
    c = np.concatenate([unpack(r["y"])[0] for r in rows]).astype(np.int64)
    end = number[np.searchsorted(words, END)]
    starts = np.cumsum(lengths.astype(np.int64)) - lengths.astype(np.int64)
    w = number[seq]
    context = np.concatenate([[end], w[:-1]])
    context[starts] = end  # no word follows an end, so its number stands for a text's start
    key, back = np.unique(context << np.uint64(32) | w, return_inverse=True)
    of = key >> np.uint64(32)
    often = c[np.searchsorted(number, of)]  # numbers ascend with hashes
    part = mix64(np.where(often > hot, key, of)) % np.uint64(parts)
    learnt = np.bincount(back[np.repeat(held == 0, lengths.astype(np.int64))], minlength=len(key))
    return Numbered([None if z else int(d) for d, z in zip(docs, null)], held, starts, c[seq], key, back, part.astype(np.int64), learnt)


def by_part(b: Numbered) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Pairs in order of (part, pair), and where each part's lie."""
    order = np.argsort(b.part, kind="stable")
    p = b.part[order]
    cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
    return order, [(int(p[x]), x, y) for x, y in zip(cuts, cuts[1:])]


def send_pairs(rows: list[dict], *how) -> Iterator[dict]:
    b = numbered(rows, *how)
    order, cuts = by_part(b)
    for part, x, y in cuts:
        i = order[x:y]
        yield {"at": part, "of": rows[0]["at"], "x": pack(gaps(b.key[i])), "y": pack(b.learnt[i].astype(np.uint64))}


class Part:
    """The pairs of a part: contexts, words and restaurants; read from its file."""

    def __init__(self, key: np.ndarray, c: np.ndarray, bases: np.ndarray):
        self.key, self.c = key.astype(np.uint64), c.astype(np.int64)
        context, word = self.key >> np.uint64(32), self.key & np.uint64(0xFFFFFFFF)
        rooms, self.room = np.unique(context, return_inverse=True)
        self.ids = np.unique(np.concatenate([rooms, word]))
        self.room_at, self.word_at = np.searchsorted(self.ids, rooms), np.searchsorted(self.ids, word)
        cuts = [*np.searchsorted(self.ids, bases).tolist(), len(self.ids)]
        self.cuts = [(r, x, y) for r, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]

    def asks(self, me: int, bases: np.ndarray, t: np.ndarray, tables: np.ndarray) -> Iterator[dict]:
        """To each range: its words here, the tables that serve them, and of contexts the tables here."""
        up, mine = np.bincount(self.word_at, t, len(self.ids)).astype(np.uint64), np.zeros(len(self.ids), np.uint64)
        mine[self.room_at] = tables.astype(np.uint64)
        for r, x, y in self.cuts:
            yield {"at": r, "of": me, "x": pack(gaps(self.ids[x:y] - np.uint64(bases[r]))), "y": pack(up[x:y]), "z": pack(mine[x:y])}


def merge_pairs(rows: list[dict], folder: str, bases: np.ndarray) -> Iterator[dict]:
    """A part's own row (of: -1, its file, x: tables of its pairs of several customers), and what it asks of the ranges."""
    got = [from_gaps(unpack(r["x"])[0]) for r in rows]
    key, back = np.unique(np.concatenate(got), return_inverse=True)
    c = np.bincount(back, np.concatenate([unpack(r["y"])[0] for r in rows]).astype(np.float64), len(key)).astype(np.int64)
    shard = Shard(folder, rows[0]["at"], TaskContext.get().taskAttemptId())
    data = pack(gaps(key), c.astype(np.uint64))
    place = shard.write(data)
    at, wanted = 0, []
    for g in got:
        wanted.append(gaps(back[at : at + len(g)]))
        at += len(g)
    more = pack(np.array([r["of"] for r in rows], np.int64), np.array([len(g) for g in got], np.uint64), np.concatenate(wanted))
    shard.write(more)
    shard.close()
    p = Part(key, c, bases)
    t = np.minimum(c, 1)
    yield {"at": -1, "of": rows[0]["at"], "name": shard.name, "place": place, "bytes": len(data), "n": len(more), "x": pack(np.ones(int((c > 1).sum()), np.uint64)), "y": pack(np.array([(c == 1).sum(), (c == 2).sum()], np.uint64))}
    yield from p.asks(rows[0]["at"], bases, t, np.bincount(p.room, t, len(p.room_at)))


# sampling


def seat_words(rows: list[dict], base: float, d: float, strength: float, total: int, seed: list[int]) -> Iterator[dict]:
    """One sweep of the parent restaurant over a range: its own row (of: -1; x: counts, y: tables or none yet), then what parts
    ask. Yields the row anew (z: chances of the seating by the grid), and to each part customers, tables, counts and contexts' tables."""
    own, rows = rows[0], rows[1:]
    c = unpack(own["x"])[0].astype(np.int64)
    asked = [from_gaps(unpack(r["x"])[0]).astype(np.int64) for r in rows]
    customers, rooms = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for r, i in zip(rows, asked):
        customers[i] += unpack(r["y"])[0].astype(np.int64)
        rooms[i] += unpack(r["z"])[0].astype(np.int64)
    t = np.minimum(np.minimum(customers, 1) if own["y"] is None else np.maximum(unpack(own["y"])[0].astype(np.int64), np.minimum(customers, 1)), customers)
    tables = np.array([max(total, int(t.sum()))])
    parent = lambda i: (np.full(len(i), base), None)
    live = np.flatnonzero(customers > 0)
    seating.sweep(customers, t, np.zeros(len(c), np.int64), tables, parent, d, strength, np.random.default_rng([*seed, own["at"]]))
    none = np.zeros(0, np.int64)
    logs = np.array([seating.likelihood(customers[live], t[live], none, none, x, y) for x, y in seating.grid(d, strength)])
    yield {"at": -1, "of": own["at"], "x": own["x"], "y": pack(t.astype(np.uint64)), "z": pack(logs), "n": int(customers.sum()), "place": int(t.sum())}
    for r, i in zip(rows, asked):
        yield {"at": r["of"], "of": own["at"], "x": pack(customers[i].astype(np.uint64)), "y": pack(t[i].astype(np.uint64)), "z": pack(c[i].astype(np.uint64), rooms[i].astype(np.uint64))}


@dataclass(frozen=True)
class Root:
    """The parent restaurant's totals and parameters."""

    d: float
    strength: float
    customers: int
    tables: int
    base: float

    def chance(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (c - self.d * t + (self.strength + self.d * self.tables) * self.base) / (self.strength + self.customers)


def told(p: Part, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Customers, tables, counts and contexts' tables of the part's words, as the ranges told them."""
    two = [unpack(r["z"]) for r in rows]
    joined = lambda arrays: np.concatenate(arrays).astype(np.int64)
    return joined([unpack(r["x"])[0] for r in rows]), joined([unpack(r["y"])[0] for r in rows]), joined([a for a, _ in two]), joined([b for _, b in two])


def read_part(own: dict, folder: str, bases: np.ndarray) -> Part:
    g, c = unpack(Reader(folder).read(own["name"], own["place"], own["bytes"]))
    return Part(from_gaps(g), c, bases)


def seat_contexts(rows: list[dict], folder: str, bases: np.ndarray, hot: int, root: Root, d: float, strength: float, sweeps: int, seed: list[int]) -> Iterator[dict]:
    """Sweeps of a part's restaurants against the parent that the ranges told. Yields the part's row anew and its asks."""
    own, rows = rows[0], rows[1:]
    p = read_part(own, folder, bases)
    customers, served, c, rooms = told(p, rows)
    t = np.minimum(p.c, 1)
    t[p.c > 1] = unpack(own["x"])[0].astype(np.int64)
    here = np.bincount(p.room, t, len(p.room_at)).astype(np.int64)
    split = c[p.room_at] > hot  # contexts whose other pairs lie in other parts
    elsewhere = np.where(split, rooms[p.room_at] - here, 0)
    tables, rng = here + elsewhere, np.random.default_rng([*seed, own["at"]])
    first = t.copy()

    def parent(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = p.word_at[i]
        # tables moved in this sweep count as the parent's customers
        others = np.maximum(customers[w] - first[i], 0)
        kept = np.minimum(served[w], others)
        spare = root.strength + root.d * (root.tables - (served[w] - kept))
        return others - root.d * kept + spare * root.base, root.strength + root.customers - first[i]

    for _ in range(sweeps):
        seating.sweep(p.c, t, p.room, tables, parent, d, strength, rng)
    here = tables - elsewhere
    # a split context's own terms are counted by the part of its number alone
    whole = ~split
    full = np.bincount(p.room, p.c, len(p.room_at)).astype(np.int64)
    open_, has = p.c > 0, whole & (full > 0)
    logs = np.array([seating.likelihood(p.c[open_], t[open_], full[has], tables[has], x, y) for x, y in seating.grid(d, strength)])
    yield {**own, "at": -1, "of": own["at"], "x": pack(t[p.c > 1].astype(np.uint64)), "z": pack(logs)}
    yield from p.asks(own["at"], bases, t, np.where(split, here, 0))


def answer(rows: list[dict], folder: str, bases: np.ndarray, hot: int, roots: list[Root], hyper: list[tuple[float, float]]) -> Iterator[dict]:
    """log10 of each pair's averaged probability, to the blocks that hold it. rows: of each sample the part's row and the ranges'."""
    total, p = 0.0, None
    for k, root in enumerate(roots):
        mine = [r for r in rows if r["of"] >> 32 == k]
        own, mine = mine[0], mine[1:]
        p = read_part(own, folder, bases) if p is None else p
        customers, served, c, rooms = told(p, mine)
        t = np.minimum(p.c, 1)
        t[p.c > 1] = unpack(own["x"])[0].astype(np.int64)
        tables = np.where(c[p.room_at] > hot, rooms[p.room_at], np.bincount(p.room, t, len(p.room_at)))[p.room]
        d, strength = hyper[k]
        chance = root.chance(customers, served)[p.word_at]
        total = total + (np.maximum(p.c - d * t, 0) + (strength + d * tables) * chance) / (strength + c[p.room_at][p.room])
    logs = np.log10(total / len(roots)).astype(np.float32)
    blocks, sizes, wanted = unpack(Reader(folder).read(own["name"], own["place"] + own["bytes"], own["n"]))
    at = 0
    for b, n in zip(blocks.tolist(), sizes.astype(np.int64).tolist()):
        yield {"at": b, "of": (1 << 40) + own["at"], "x": pack(logs[from_gaps(wanted[at : at + n]).astype(np.int64)])}
        at += n


def score_block(rows: list[dict], folder: str, bases: np.ndarray, parts: int, hot: int, n: int, v: int) -> pa.Table:
    """rows: the block's own, of each range its numbers, of each part its pairs' logarithms."""
    logs = [r for r in rows if r["of"] >= 1 << 40]
    b = numbered(rows[: len(rows) - len(logs)], folder, bases, parts, hot)
    order, _ = by_part(b)
    log = np.empty(len(b.key))
    log[order] = np.concatenate([unpack(r["x"])[0] for r in logs])
    add = lambda x: np.add.reduceat(x, b.starts)
    base = np.log10((b.counts + 1) / (n + v + 1))
    size = np.diff([*b.starts, len(b.back)])
    return pa.table({
        "doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.held > 0), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(add((b.counts > 0).astype(np.int64)), pa.int64()),
        "train_tokens": pa.array(np.full(len(size), n), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(log[b.back])),
    })


def score(docs: DataFrame, m: Model = PRODUCTION) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, of all docs; log10."""
    spark = docs.sparkSession
    folder = shared_path(spark, "model")
    blocks = written(write_blocks(docs, folder, m), "blocks")
    tokens, count = blocks.agg(F.sum("n"), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    ranges, parts = tokens // m.range_tokens + 1, tokens // m.part_pairs + 1
    spread = blocks.repartition(max(1, min(count, 20_000)))
    named = written(grouped(send_words(spread, folder, ranges), ranges, number_words), "words")
    sizes = {r["at"]: (r["n"], r["place"], r["bytes"]) for r in named.filter("of = -1").select("at", "n", "place", "bytes").collect()}
    ends = np.cumsum([sizes.get(r, (0, 0, 0))[0] for r in range(ranges)], dtype=np.uint64)
    bases = np.concatenate([[np.uint64(0)], ends[:-1]]).astype(np.uint64)
    if int(ends[-1]) >= 1 << 32:
        raise ValueError("more words than 32 bits number")
    v, n = sum(s[1] for s in sizes.values()), sum(s[2] for s in sizes.values())
    hot = max(m.hot, int(m.hot_share * n))
    swapped = [F.col("of").alias("at"), F.col("at").alias("of"), *ROW_REST]
    of_blocks = blocks.withColumn("of", F.lit(-1).cast("long")).unionByName(named.filter("of >= 0").select(*swapped))
    how = (folder, bases, parts, hot)
    # what the parts hold, and what they ask of the ranges
    asks = written(grouped(grouped(of_blocks, count, lambda rows: send_pairs(rows, *how)), parts, lambda rows: merge_pairs(rows, folder, bases)), "parts")
    own = asks.filter("at = -1")
    one, two = np.sum([unpack(r["y"])[0] for r in own.select("y").collect()], axis=0, dtype=np.int64).tolist()
    d = round(min(0.95, max(0.05, one / (one + 2 * two))), 3) if one else 0.5
    now, above, rng = (d, 1.0), (d, 1.0), np.random.default_rng(m.seed)
    state, tables, kept = named.filter("of = -1").withColumn("y", F.lit(None).cast("binary")), v, []
    for k in range(-1, m.samples + 1):
        if k >= 0:  # the contexts: burn-in first, then a sweep a sample
            run = (folder, bases, hot, root, *now, m.burn_in if k == 0 else 1, [m.seed, 2, k])
            told_parts = own.select(*swapped).unionByName(down.filter("at >= 0"))
            asks = written(grouped(told_parts, parts, lambda rows, run=run: seat_contexts(rows, *run)), "contexts")
            own = asks.filter("at = -1")
        # their parent
        run = (1 / (v + 1), *above, tables, [m.seed, 1, k + 1])
        down = written(grouped(state.unionByName(asks.filter("at >= 0")), ranges, lambda rows, run=run: seat_words(rows, *run)), "parent")
        tops = down.filter("at = -1").select("of", "n", "place", "z").orderBy("of").collect()
        customers, tables = sum(r["n"] for r in tops), sum(r["place"] for r in tops)
        root, state = Root(*above, customers, tables, 1 / (v + 1)), down.filter("at = -1").select(*swapped)
        if k > 0:
            kept.append((own, down.filter("at >= 0"), root, now))
        if k >= 0 and customers:  # discounts and strengths for the next sweep
            none = np.zeros(0, np.int64)
            whole = [seating.likelihood(none, none, np.array([customers]), np.array([tables]), *g) for g in seating.grid(*above)]
            above = seating.chosen(seating.grid(*above), np.sum([unpack(r["z"])[0] for r in tops], axis=0) + whole, rng)
            logs = np.sum([unpack(r["z"])[0] for r in own.select("of", "z").orderBy("of").collect()], axis=0)
            now = seating.chosen(seating.grid(*now), logs, rng)
    answers = None
    for k, (mine, told_words, _, _) in enumerate(kept):
        at = F.lit(k << 32)
        mine = mine.select(F.col("of").alias("at"), at.alias("of"), *ROW_REST).unionByName(told_words.withColumn("of", at + 1 + F.col("of")))
        answers = mine if answers is None else answers.unionByName(mine)
    run = (folder, bases, hot, [x[2] for x in kept], [x[3] for x in kept])
    answers = of_blocks.unionByName(grouped(answers, parts, lambda rows: answer(rows, *run)))
    spread = max(2 * spark.sparkContext.defaultParallelism, min(2 * count, 20_000))
    return answers.repartition(spread, "at").groupBy("at").applyInArrow(lambda t: score_block(t.sort_by("of").to_pylist(), *how, n, v), RESULT)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity of the model and of the base."""
    g = scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    return g.select("held_out", "n_tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.col("b") / F.col("n_tokens")).alias("base_perplexity"))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pitman_yor": op1_pitman_yor}
SQL: dict = {}
