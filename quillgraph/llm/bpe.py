"""Byte-level BPE without regular expressions.

Pre-tokenisation: texts become code-point arrays, a table gives each code point's class, and neighbours refine it
(last white space of a run, apostrophe of a contraction). A finite automaton over these symbols marks where pieces begin.
Its transition functions compose associatively, so all blocks of a text run at once from every state, a doubling scan
composes the blocks, and a second pass runs each from its true state. The slices between marks go through a cache of
merged pairs. Byte offsets of tokens follow from the ids' lengths, and decoding is a table lookup.

Cases. Null text: no tokens, like the empty one. White space alone, control characters, any length of one piece (merging takes
n log n): as the library would. Repeated rows: each gets a row. Empty table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .encoding import Cache

LETTER, NUMBER, OTHER, LAST_BLANK, LAST_SPACE, SPACE, APOSTROPHE_1, APOSTROPHE_2, FIRST, STAY = 0, 1, 2, 3, 4, 5, 6, 7, 8, 16
#: Automaton states. ONE and TWO: so many letters of a contraction are still to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, TWO, ONE, ENDED = range(9)
STATES, BLOCK = 9, 64
#: Up to so many bytes pairs are searched in turn; longer pieces use a heap.
SHORT, NONE = 48, 1 << 40
#: Code points that are white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at the symbol. FIRST is added to the symbol that begins a text."""
    if symbol == STAY:
        return state, False
    if symbol >= FIRST:
        state, symbol = START, symbol - FIRST
    if state in (TWO, ONE):
        return (ONE if state == TWO else ENDED), False
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    if symbol in runs:
        return runs[symbol], state not in (runs[symbol], AFTER_BLANK)
    if symbol in (APOSTROPHE_1, APOSTROPHE_2):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (ONE if symbol == APOSTROPHE_1 else TWO), True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if symbol == LAST_BLANK else IN_SPACE), True


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of code points, and next state and mark by 16 * symbol + state."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[WHITE] = SPACE
    nxt, mark = np.zeros(17 * 16, np.uint8), np.zeros(17 * 16, bool)
    for symbol in range(17):
        for state in range(STATES):
            nxt[16 * symbol + state], mark[16 * symbol + state] = step(state, symbol)
    return kinds, nxt, mark


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; first: where texts begin."""
    kinds, _, _ = tables()
    s = kinds[cp]
    n = len(cp)
    ends = np.zeros(n, bool)  # the text's last
    ends[np.append(first[1:], n) - 1] = True

    def after(k: int) -> np.ndarray:
        """Code points k places on; 0 beyond the end of the text."""
        out = np.zeros(n, cp.dtype)
        out[: n - k] = cp[k:]
        for j in range(k):
            out[: n - j][ends[j:]] = 0
        return out

    space = s == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~ends[:-1]
    s[last] = LAST_SPACE
    s[last & (cp == 0x20)] = LAST_BLANK
    at = np.flatnonzero(cp == ord("'"))
    if len(at):
        a, b = after(1)[at], after(2)[at]
        s[at[np.isin(a, [ord(c) for c in "stmd"])]] = APOSTROPHE_1
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        s[at[two]] = APOSTROPHE_2
    s[first] += FIRST
    return s


def marks(s: np.ndarray) -> np.ndarray:
    """Where pieces begin, by a scan of transition functions."""
    _, nxt, mark = tables()
    n = len(s)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, STAY, np.uint16)
    padded[:n] = s
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * 16
    f = np.repeat(np.arange(STATES, dtype=np.uint16)[:, None], blocks, 1)  # each block's function, from every state
    for j in range(BLOCK):
        f = nxt[columns[j] + f].astype(np.uint16)
    d = 1
    while d < blocks:  # composes with what the scan has for the blocks before
        g = f.copy()
        g[:, d:] = np.take_along_axis(f[:, d:], f[:, :-d].astype(np.intp), 0)
        f, d = g, 2 * d
    state = np.concatenate([[START], f[START, :-1]]).astype(np.uint16)
    out = np.empty((BLOCK, blocks), bool)
    for j in range(BLOCK):
        at = columns[j] + state
        out[j], state = mark[at], nxt[at]
    return out.T.ravel()[:n]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as UTF-8, byte offsets at which pieces begin (and the end), and how many pieces each text has."""
    text = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    if not text:
        return b"", np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.flatnonzero(marks(symbols(cp, starts[lengths > 0])))
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.cumsum(size)
    where = np.append(ends[begins] - size[begins], ends[-1])
    per = np.searchsorted(begins, starts + lengths) - np.searchsorted(begins, starts)
    return text.encode("utf-8", "surrogatepass"), where, per


class Ranks:
    """A vocabulary of mergeable ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes[rank] = piece
        self.cache = Cache(lambda p: np.array(self.merged(p), "<u4").tobytes(), 250_000)

    def merged(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, the first of equals, until none is left."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, get = len(piece), self.ranks.get
        if n <= SHORT:
            parts = [piece[i : i + 1] for i in range(n)]
            pairs = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
            while pairs and (least := min(pairs)) < NONE:
                i = pairs.index(least)
                parts[i : i + 2] = [x := parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] + x, NONE)
                if i < len(pairs):
                    pairs[i] = get(x + parts[i + 1], NONE)
            return [self.ranks[x] for x in parts]
        end = list(range(1, n + 1))  # of the part that begins here; 0 where none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            m = end[i]
            if not m or m >= j or m >= n or end[m] != j:  # one of its parts has merged meanwhile
                continue
            end[i], end[m] = j, 0
            if j < n:
                before[j] = i
                if (r := get(piece[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (b := before[i]) >= 0 and (r := get(piece[b:j])) is not None:
                heapq.heappush(heap, (r, b, j))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        raw, where, per = slices(texts)
        w = where.tolist()
        ids = list(map(self.cache.__getitem__, [raw[a:b] for a, b in zip(w, w[1:])]))
        out, at = [], 0
        for n in per.tolist():
            out.append(b"".join(ids[at : at + n]))
            at += n
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the text, and the text's length."""
        return np.concatenate([[0], np.cumsum([len(self.bytes[i]) for i in ids.tolist()], dtype=np.int64)])


def groups(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in groups of about so many characters; a longer text stands alone."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), offsets of the tokens in bytes (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Ranks(vocabulary)
        for batch in batches:
            at = 0
            for texts in groups([t or "" for t in batch.column(1).to_pylist()]):
                ids = r.encode(texts)
                offs = [r.offsets(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array(offs, pa.list_(pa.int64()))], names=["doc_id", "ids", "offsets"])
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, offsets array<long>")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and of the bytes that they decode to. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Ranks(vocabulary)
        for batch in batches:
            at = 0
            for texts in groups([t or "" for t in batch.column(1).to_pylist()]):
                ids = r.encode(texts)
                sha = lambda b: hashlib.sha256(b).hexdigest()
                back = [sha(r.decode(np.frombuffer(x, "<u4"))) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids)), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
SQL: dict = {}
