"""Reversible line dedup: sharded cuckoo filters before exact reference-count tables.

An index of line keys has postings (a row for each line key of each document), and shards. A shard holds some tens of thousands of
keys: for each the exact count of its references and its first and last document, and a cuckoo filter that holds one copy of a
key with one document and two of a key with more. Inserting documents adds references: keys of which the filter knows no
copy are new and are never looked up. Deleting documents counts the keys that they held anew from the postings left, and the
filter forgets copies, so a document that comes and goes leaves the index as it was. To decide on a line, its key is looked
up in the exact table only where the filter has two copies.

References are summed by block before they go to shards, so a line of every document is one row a block. When lines are
decided on, keys with more than a ten-thousandth of all postings (at most ten thousand keys, therefore) are joined by broadcast, and
never meet in a shard. Keys are 128-bit hashes.

Cases. Null or empty text: one empty line. A row of null id holds no keys and loses no lines. Rows that share an id are one
document: it keeps its lines where it is the smallest that holds them, in all its rows. Very long texts and lines: whole. Repeated
lines of one document are kept or lost together. Empty tables: empty result. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, broadcast_if_small, table, written
from .cuckoo import Cuckoo, Full
from .packing import pack, unpack

LEAST = 10
BLANK = b" \t\n\x0b\x0c\r"
#: Keys a shard is meant for, rows that a task sums at once, and the share of postings beyond which a key is hot.
SHARD, BLOCK, HOT = 65_536, 1 << 20, 10_000
#: Shards are dealt to so many tasks at most; a task holds one shard at a time.
MOST_TASKS = 20_000
POSTING = "doc_id long, h1 long, h2 long"
ROW = "shard long, kind int, h1 long, h2 long, n long, first long, last long, filter binary, refs binary, hot binary"


def line_keys(text: bytes, least: int = LEAST) -> list[bytes | None]:
    """The hashed key of each line; None where the key has fewer than least code points."""
    import xxhash

    out = []
    for line in text.split(b"\n"):
        k = line.strip(BLANK)
        long_enough = len(k) >= 4 * least or (len(k) >= least and len(k.decode("utf-8", "surrogatepass")) >= least)
        out.append(xxhash.xxh3_128_digest(k.translate(LOWER_BYTES)) if long_enough else None)
    return out


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, h1, h2: the keys of each document's lines, once a row of docs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                mine = set(line_keys(text or b"", least))
                mine.discard(None)
                ids.append(np.full(len(mine), doc, np.int64))
                keys.extend(mine)
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids or [np.zeros(0, np.int64)])), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(found, POSTING)


@dataclass
class References:
    """Keys in ascending order with their counts of references, first and last documents."""

    h1: np.ndarray
    h2: np.ndarray
    n: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def summed(h1, h2, n, first, last) -> References:
        """Equal keys become one."""
        order = np.lexsort((h2, h1))
        h1, h2, n, first, last = (a[order] for a in (h1, h2, n, first, last))
        if not len(h1):
            return References(h1, h2, n, first, last)
        at = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        return References(h1[at], h2[at], np.add.reduceat(n, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at))

    def arrays(self) -> list[np.ndarray]:
        return [self.h1, self.h2, self.n, self.first, self.last]

    def pick(self, which: np.ndarray) -> References:
        return References(*(a[which] for a in self.arrays()))

    def repeated(self) -> np.ndarray:
        return self.first < self.last

    def copies(self) -> np.ndarray:
        return 1 + self.repeated().astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Where each key stands; -1 if nowhere."""
        at = np.searchsorted(self.h1, h1)
        out = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        while len(todo):  # more than once only where two keys share their first half
            at_ = at[todo]
            inside = at_ < len(self.h1)
            todo, at_ = todo[inside], at_[inside]
            todo, at_ = todo[self.h1[at_] == h1[todo]], at_[self.h1[at_] == h1[todo]]
            same = self.h2[at_] == h2[todo]
            out[todo[same]] = at_[same]
            todo = todo[~same]
            at[todo] += 1
        return out


NONE = [np.zeros(0, np.int64)] * 5


class Shard:
    """The exact table of a shard, and its filter."""

    def __init__(self, refs: References, cuckoo: Cuckoo):
        self.refs, self.filter = refs, cuckoo

    @staticmethod
    def read(cuckoo: bytes | None, refs: bytes | None) -> Shard:
        return Shard(References(*unpack(refs)), Cuckoo.of_bytes(cuckoo)) if refs else Shard(References(*NONE), Cuckoo(0))

    def _refilter(self, add: np.ndarray) -> None:
        try:
            if not self.filter.room(len(add)):
                raise Full
            self.filter.insert(add)
        except Full:  # the table has all that the filter must hold
            held, entries = np.repeat(self.refs.h2, self.refs.copies()).view(np.uint64), 2 * int(self.refs.copies().sum())
            while True:
                self.filter = Cuckoo(entries)
                try:
                    self.filter.insert(held)
                    return
                except Full:
                    entries *= 2

    def insert(self, new: References) -> None:
        """Adds references. Keys that the filter does not know are not looked up."""
        at = np.full(len(new.h1), -1, np.int64)
        maybe = np.flatnonzero(self.filter.copies(new.h2.view(np.uint64)) > 0)
        at[maybe] = self.refs.find(new.h1[maybe], new.h2[maybe])
        known = at >= 0
        before, at = self.refs.copies()[at[known]], at[known]
        self.refs.n[at] += new.n[known]
        self.refs.first[at] = np.minimum(self.refs.first[at], new.first[known])
        self.refs.last[at] = np.maximum(self.refs.last[at], new.last[known])
        more, fresh = self.refs.copies()[at] - before, new.pick(~known)
        add = np.concatenate([np.repeat(new.h2[known], more), np.repeat(fresh.h2, fresh.copies())]).view(np.uint64)
        if len(fresh.h1):
            self.refs = References.summed(*(np.concatenate(x) for x in zip(self.refs.arrays(), fresh.arrays())))
        self._refilter(add)

    def recount(self, now: References) -> None:
        """Sets known keys to the counts given; a count of 0 removes the key."""
        at = self.refs.find(now.h1, now.h2)
        now, at = now.pick(at >= 0), at[at >= 0]
        before = self.refs.copies()[at]
        after = np.where(now.n > 0, now.copies(), 0)
        self.filter.delete(np.repeat(now.h2, before - after).view(np.uint64))
        for mine, theirs in zip(self.refs.arrays()[2:], now.arrays()[2:]):
            mine[at] = theirs
        self.refs = self.refs.pick(self.refs.n > 0)

    def losing(self, doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which postings lose their lines. Where the filter has one copy or none, the exact table is not asked."""
        out = np.zeros(len(doc), bool)
        maybe = np.flatnonzero(self.filter.copies(h2.view(np.uint64)) > 1)
        at = self.refs.find(h1[maybe], h2[maybe])
        maybe, at = maybe[at >= 0], at[at >= 0]
        out[maybe] = doc[maybe] > self.refs.first[at]
        return out

    def row(self, shard: int, total: int) -> pa.RecordBatch:
        hot = self.refs.pick(self.refs.repeated() & (self.refs.n * HOT > total))
        cells = [shard, 0, None, None, None, None, None, self.filter.to_bytes(), pack(*self.refs.arrays()), pack(*hot.arrays())]
        return batch_of(*([c] for c in cells))


def batch_of(*columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in ROW.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def summed_by_block(rows: DataFrame, shards: int) -> DataFrame:
    """Postings as references, equal keys of a block of rows summed before they are shuffled."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            doc, h1, h2 = (np.concatenate(x) for x in zip(*held))
            r = References.summed(h1, h2, np.ones(len(doc), np.int64), doc, doc)
            k, none = len(r.h1), [None] * len(r.h1)
            return batch_of(r.h1 % shards, np.ones(k, np.int32), *r.arrays(), none, none, none)

        for batch in batches:
            held.append(longs(batch, "doc_id", "h1", "h2"))
            size += batch.num_rows
            if size >= BLOCK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(f, ROW)


def shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of one shard and kind; rows come sorted by both."""
    for batch in batches:
        shard, kind = longs(batch, "shard", "kind")
        cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(shard) else []
        for a, b in zip(cuts, cuts[1:]):
            yield int(shard[a]), batch.slice(a, b - a)


def met(state: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """Each shard's state, and after it the rows that are for it, in one task."""
    both = state.unionByName(rows) if state is not None else rows
    tasks = min(MOST_TASKS, max(shards, rows.sparkSession.sparkContext.defaultParallelism))
    return both.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")


def changed(state: DataFrame | None, rows: DataFrame, shards: int, total: int, how: Callable[[Shard, References], None]) -> DataFrame:
    """States after references meet them; shards without any stay as they are."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, held, size = None, None, [], 0

        def settle() -> None:
            nonlocal held, size
            if held:
                held = [References.summed(*(np.concatenate(x) for x in zip(*held))).arrays()]
                size = 0

        def done() -> pa.RecordBatch:
            settle()
            if held:
                how(mine, References(*held[0]))
            return mine.row(at, total)

        for shard, run in shard_runs(batches):
            if shard != at:
                if at is not None:
                    yield done()
                at, mine, held, size = shard, Shard.read(None, None), [], 0
            if run.column("kind")[0].as_py() == 0:
                mine = Shard.read(run.column("filter")[0].as_py(), run.column("refs")[0].as_py())
                continue
            held.append(longs(run, "h1", "h2", "n", "first", "last"))
            size += run.num_rows
            if size >= BLOCK:
                settle()
        if at is not None:
            yield done()

    return met(state, rows, shards).mapInArrow(f, ROW)


@dataclass(frozen=True)
class LineIndex:
    """Postings and shards of documents. Every change makes a new index; the tables of the old one stay until the driver ends."""

    spark: SparkSession
    least: int = LEAST
    shards: int = 1
    total: int = 0
    postings: DataFrame | None = None
    state: DataFrame | None = None

    def _state(self, rows: DataFrame, how: Callable[[Shard, References], None], total: int) -> DataFrame:
        return written(changed(self.state, rows, self.shards, total, how), "line-shards")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs in it."""
        new = written(postings(docs, self.least), "line-postings")
        both = new if self.postings is None else self.postings.unionByName(new)
        total = self.total + new.count()
        out = replace(self, total=total, postings=both)
        if total > 2 * SHARD * self.shards:  # more shards, and the state anew from the postings
            out, new = replace(out, shards=-(-total // SHARD), state=None), both
        return replace(out, state=out._state(summed_by_block(new, out.shards), Shard.insert, total))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of these ids. Lines that they had kept come back in the next document that holds them."""
        if self.postings is None:
            return self
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        touched = written(self.postings.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct(), "line-touched")
        left = written(self.postings.join(ids, "doc_id", "left_anti"), "line-postings")
        again = left.join(broadcast_if_small(touched, touched.count()), ["h1", "h2"], "left_semi").select("doc_id", "h1", "h2")
        none = touched.select(F.pmod("h1", F.lit(self.shards)).alias("shard"), F.lit(1).alias("kind"), "h1", "h2", F.lit(0).cast("long").alias("n"), F.lit(2**63 - 1).alias("first"), F.lit(-(2**63)).alias("last"), *(F.lit(None).cast("binary").alias(c) for c in ("filter", "refs", "hot")))
        total = left.count()
        state = self._state(summed_by_block(again, self.shards).unionByName(none), Shard.recount, total)
        return replace(self, total=total, postings=left, state=state)

    def hot(self) -> DataFrame:
        """h1, h2, first of keys with more than a HOT-th of all postings: at most HOT rows."""
        total = self.total

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in batch.column("hot").to_pylist():
                    r = References(*unpack(cell))
                    r = r.pick(r.n * HOT > total)
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (r.h1, r.h2, r.first)], names=["h1", "h2", "first"])

        return self.state.select("hot").mapInArrow(f, "h1 long, h2 long, first long")

    def losing(self, rows: DataFrame | None = None) -> DataFrame:
        """doc_id, key: the lines that documents of these postings (by default all) lose."""
        rows = self.postings if rows is None else rows
        hot = F.broadcast(written(self.hot(), "line-hot"))
        cold = rows.join(hot, ["h1", "h2"], "left_anti")
        none = [F.lit(None).cast("binary").alias(c) for c in ("filter", "refs", "hot")]
        cold = cold.select(F.pmod("h1", F.lit(self.shards)).alias("shard"), F.lit(1).alias("kind"), "h1", "h2", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("first"), F.col("doc_id").alias("last"), *none)

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, mine = None, None
            for shard, run in shard_runs(batches):
                if run.column("kind")[0].as_py() == 0:
                    at, mine = shard, Shard.read(run.column("filter")[0].as_py(), run.column("refs")[0].as_py())
                elif at == shard:
                    doc, h1, h2 = longs(run, "first", "h1", "h2")
                    lose = mine.losing(doc, h1, h2)
                    yield pa.RecordBatch.from_arrays([pa.array(a[lose]) for a in (doc, h1, h2)], names=["doc_id", "h1", "h2"])

        often = rows.join(hot, ["h1", "h2"]).filter("doc_id > first").select("doc_id", "h1", "h2")
        return met(self.state, cold, self.shards).mapInArrow(f, POSTING).unionByName(often)


def rewritten(docs: DataFrame, losing: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of each row of docs, its lost lines left out."""
    lost = losing.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            lost = batch.column("lost")
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                gone = lost[k].values if lost[k].is_valid else None
                n = text.count(b"\n") + 1
                if gone is not None and len(gone):
                    pairs = np.stack([gone.field(x).to_numpy(zero_copy_only=False) for x in ("h1", "h2")], axis=1)
                    away = {p.tobytes() for p in pairs}
                    kept = [line for line, key in zip(text.split(b"\n"), line_keys(text, least)) if key not in away]
                    n_dropped.append(n - len(kept))
                    text = b"\n".join(kept)
                else:
                    n_dropped.append(0)
                n_lines.append(n)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return mine.join(lost, "doc_id", "left").mapInArrow(f, "doc_id long, text string, n_lines long, n_dropped long")


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Documents without lines that a smaller document holds: an index of all of them, and their texts rewritten by it."""
    index = LineIndex(docs.sparkSession, least).insert(docs)
    return rewritten(docs, index.losing(), least)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op11_line_dedup": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, 1 + len(string_split(t, chr(10))))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id <> first, false) AS lost FROM k LEFT JOIN h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
}
QUERIES = {"op11_line_dedup": op11_line_dedup}
