"""Packed columns for exchanges: many integers in one binary value.

An operator that moves hundreds of millions of small integers sends them as sorted,
delta-coded byte planes instead of rows; a row is one (sender batch, bucket) pair.
"""

from __future__ import annotations

import struct

import numpy as np


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _planes(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def pack(*columns: np.ndarray, level: int = 1) -> bytes:
    """Columns of one length.  The first must be sorted if it is uint64: it is delta-coded."""
    import zstandard

    head, body = struct.pack("<BI", len(columns), len(columns[0])), b""
    for k, c in enumerate(columns):
        if k == 0 and c.dtype == np.uint64:
            c = np.diff(c, prepend=np.uint64(0))
        head += c.dtype.str.encode().ljust(4)
        body += _planes(c)
    return head + zstandard.ZstdCompressor(level=level).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n_cols, n = struct.unpack_from("<BI", blob)
    kinds = [np.dtype(blob[5 + 4 * k : 9 + 4 * k].decode().strip()) for k in range(n_cols)]
    if not n:
        return [np.zeros(0, k) for k in kinds]
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5 + 4 * n_cols :], max_output_size=n * sum(k.itemsize for k in kinds) or 1), np.uint8), 0, []
    for k, kind in enumerate(kinds):
        size = n * kind.itemsize
        c = np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, n).T).reshape(-1).view(kind)
        out.append(np.cumsum(c, dtype=np.uint64) if k == 0 and kind == np.uint64 else c)
        at += size
    return out


def slices(batch, column: int, most: int):
    """Slices of an Arrow batch of about ``most`` bytes in a string column; a longer string is a slice of its own."""
    import pyarrow.compute as pc

    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(n):
        before = n[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(n, before + most, side="right")))
        yield batch.slice(first, end - first)
        first = end


def text_units(batch, most: int):
    """``slices`` of (doc_id, text) as (ids, known, texts as bytes); only one slice is unpacked at a time."""
    import pyarrow.compute as pc

    for part in slices(batch, 1, most):
        ids = part.column(0)
        texts = [b"" if t is None else t.encode("utf-8", "replace") for t in part.column(1).to_pylist()]
        yield pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8), texts


def chunks(texts: list[bytes], most: int = 1 << 21):
    """Slices of ``texts`` of about ``most`` bytes; a longer text is a slice of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and (size + len(t) > most or k - first >= 60_000):
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
