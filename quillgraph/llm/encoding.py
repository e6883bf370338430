"""Whole texts to ids with the tokenizers library, each different word of a task looked up in a cache.

A byte-level vocabulary never joins a character with a blank or line feed that follows it, so a text may be cut before
every blank or line feed that stands after a character which isn't white space, and the pieces encoded apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import single_threaded

#: White space that needs the careful way: any but single blanks and line feeds.
_RARE = re.compile(r"[^\S \n]|\x00|\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def keys(text: str) -> list[str]:
    """The pieces of a text, as the cache names them: a piece that begins with a blank without it, one that begins with a line
    feed as it is, and any other, like a text's first, with a zero before it."""
    if _RARE.search(text):
        return ["\0" + p for p in _CUT.split(text)]
    if "\n" in text:
        text = text.replace("\n", " \n")
    out = text.split(" ")
    out[0] = "\0" + out[0]
    return out


class Cache(dict):
    """Bounded: when full, the later half of the entries goes, the earlier stay, which hold the frequent pieces."""

    def __init__(self, make, most: int = 300_000):
        self.make, self.most = make, most

    def __missing__(self, piece):
        if len(self) >= self.most:
            for _ in range(self.most // 2):
                self.popitem()
        self[piece] = x = self.make(piece)
        return x


#: Texts are worked on in groups of about so many characters, so that few pieces are held at once.
GROUP = 1 << 20


def groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


#: So many pieces make one text for the library, which costs it less than as many texts.
JOINED = 256


class Encoder:
    """Ids of texts as bytes of little-endian unsigned integers of the given kind.

    The pieces of a group of texts that no cache entry knows go to the library in one call, those that may be joined a few hundred
    to a text; the bytes that each id stands for tell where a piece ends. A full cache drops its later half before a group, so
    the earlier entries stay, which hold the frequent pieces. plain: special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str, kind: str = "<u2", plain: bool = False, most: int = 1_000_000):
        single_threaded()
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = plain
        if self.t.get_vocab_size() > np.iinfo(kind).max + 1:
            raise ValueError(f"the vocabulary does not fit {kind}")
        special = {i: t.content for i, t in self.t.get_added_tokens_decoder().items()}
        self.bytes = np.zeros(self.t.get_vocab_size(), np.int64)
        for token, i in self.t.get_vocab().items():  # a byte-level token has one character for each byte
            self.bytes[i] = len(special[i].encode()) if i in special else len(token)
        self.kind, self.most = np.dtype(kind), most
        self.cache: dict[str, bytes] = {}

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, keys: list[str], pieces: list[str]) -> None:
        """Learns keys whose pieces begin with a blank or line feed and end with neither, many to a text."""
        ids = np.fromiter(chain.from_iterable(self.ids_of(["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)])), self.kind)
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in pieces], dtype=np.int64)
        cum = np.cumsum(self.bytes[ids])
        last = np.searchsorted(cum, ends)
        if len(ends) and (last[-1] + 1 != len(cum) or (cum[last] != ends).any()):
            raise ValueError("the library's ids cross the pieces of a text")
        raw, at = ids.tobytes(), 0
        for key, end in zip(keys, ((last + 1) * self.kind.itemsize).tolist()):
            self.cache[key] = raw[at:end]
            at = end

    def learn(self, new: list[str]) -> None:
        plain = [k for k in new if k and k[0] not in "\0\n"]
        self.together(plain, [" " + k for k in plain])
        lines = [k for k in new if k[:1] == "\n" and len(k) > 1]
        self.together(lines, lines)
        rest = [k for k in new if k in ("", "\n") or k[0] == "\0"]
        for key, x in zip(rest, self.ids_of([k[1:] if k[:1] == "\0" else k or " " for k in rest])):
            self.cache[key] = np.array(x, self.kind).tobytes()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; null: none."""
        for group in groups(texts):
            cut = [keys(t) if t else [] for t in group]
            if len(self.cache) >= self.most:
                for _ in range(self.most // 2):
                    self.cache.popitem()
            flat = list(chain.from_iterable(cut))
            found = list(map(self.cache.get, flat))
            new = [i for i, x in enumerate(found) if x is None]
            self.learn(list({flat[i] for i in new}))
            for i in new:
                found[i] = self.cache[flat[i]]
            at = 0
            for c in cut:
                yield b"".join(found[at : at + len(c)])
                at += len(c)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    """One for all tasks of a worker process, so that later tasks find its cache filled."""
    return Encoder(path, plain=plain)
