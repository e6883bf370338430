"""Integer arrays as short byte strings, so that a shuffle of many small numbers carries few bytes."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any plain types; bytes of equal weight stand together, and all is compressed."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        a = narrow(a) if a.dtype.kind in "iu" and a.dtype != np.int64 else np.ascontiguousarray(a)
        head.append(struct.pack("<4sQ", a.dtype.str.encode(), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = b"".join(head + body)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    n, at, kinds = struct.unpack_from("<I", raw)[0], 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sQ", raw, at)
        kinds.append((np.dtype(kind.rstrip(b"\0").decode()), size))
        at += 12
    out = []
    for kind, size in kinds:
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, size).T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Ascending unsigned integers as differences."""
    return np.diff(a.astype(np.uint64), prepend=np.uint64(0))


def from_gaps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint64)
