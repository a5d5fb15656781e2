"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: Odd multipliers that tell the places of a shingle's words apart (from splitmix64's constants).
_PLACE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place(k: int) -> np.uint64:
    """The multiplier of the word at place ``k``: one of its own for each, none of them a start value."""
    return _PLACE[k] if k < 4 else mix(np.array([k], np.uint64) * _PLACE[0])[0] | np.uint64(1)


def coded_words(texts: list[str], lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts: distinct words, each place's word, first places.

    The last array has one entry more than there are texts.  ``lower`` lower-cases A-Z only.
    """
    data = [t.encode() for t in texts]
    if lower:
        data = [d.lower() for d in data]
    lengths = np.fromiter(map(len, data), np.int64, len(data)) + 1
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    ink = ~_BLANK[joined]
    begins = np.flatnonzero(ink & np.append(True, ~ink[:-1]))
    ends = np.flatnonzero(ink & np.append(~ink[1:], True)) + 1
    offsets = np.append(0, np.cumsum(ends - begins)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined[ink].tobytes())])
    coded = words.dictionary_encode()
    first = np.searchsorted(begins, np.append(0, np.cumsum(lengths)))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), first


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in order, A-Z lower-cased, and each text's first index."""
    distinct, places, first = coded_words(texts, lower=True)
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return each[places] if len(places) else np.zeros(0, np.uint64), first


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, sorted; of fewer words the whole is one run."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    start = _PLACE[4] if width == size else mix(np.array([_PLACE[4] if width == 4 else place(width)], np.uint64))[0]
    total = np.full(n - width + 1, start, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * place(k) + np.uint64(k)
    return np.unique(mix(total))
