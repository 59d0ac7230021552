"""Whole columns of texts cut into words with numpy and Arrow: no Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

DELIMITER = np.zeros(256, bool)
DELIMITER[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    codes: np.ndarray  # of every word, an index into dictionary
    dictionary: pa.Array  # the different words, as bytes
    starts: np.ndarray  # words of text i: codes[starts[i]:starts[i + 1]]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text starts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, each of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text. lower: A to Z become a to z."""
    data, offsets = text_buffer(texts)
    if not len(data):
        return Words(np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64))
    if lower:
        data = LOWER[data]
    gap = DELIMITER[data]
    start = ~gap
    start[1:] &= gap[:-1]
    inner = offsets[offsets < len(data)]
    start[inner] = ~gap[inner]
    kept = data[~gap]
    at = np.flatnonzero(start[~gap])
    ends = np.append(at, len(kept)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    coded = array.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(np.flatnonzero(start), offsets))


def hashes(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit halves of the 128-bit hash of each word."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(x) for x in dictionary.to_pylist()]), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two adjacent sequences from the hashes of each."""
    return mix(left * M2 + (right ^ M1))


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive values, by doubling: log n passes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    whole, length, power, width = None, 0, mix(h), 1
    while True:
        if n & width:
            m = len(power) - length
            whole, length = (power if whole is None else joined(whole[:m], power[length : length + len(whole)])), length + width
        width *= 2
        if width > n:
            return whole[: len(h) - n + 1]
        half = width // 2
        power = joined(power[:-half], power[half:])
