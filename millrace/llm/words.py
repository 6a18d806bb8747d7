"""Words and word shingles of whole Arrow columns, by numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[0x20, *range(0x09, 0x0E)]] = 0x20
_LOWER = _SPACES.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words one after another, and the number of words of each text; null: none.

    White space is the space and tab to carriage return; ``lower`` changes A-Z only.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer((_LOWER if lower else _SPACES)[raw]))
    parts = pc.split_pattern(plain, " ")
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    per = pc.list_value_length(parts).to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    edges = np.concatenate([[0], np.cumsum(per)])
    return flat.filter(real), np.diff(upto[edges])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is hashed once.

    Every byte and its place in the word give a number, mixed over 64 bits; a word's hash
    is the mix of their sum and its length.
    """
    coded = flat.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.uint64)
    _, at, data = coded.dictionary.buffers()
    ends = np.frombuffer(at, np.int64)[coded.dictionary.offset :][: len(coded.dictionary) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(raw), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    sums = np.add.reduceat(mixed(raw + (place << np.uint64(8)) + np.uint64(0x9E3779B97F4A7C15)), starts)
    return mixed(sums + sizes.astype(np.uint64))[coded.indices.to_numpy()]


def rolling(hashed: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` words, by its first word; windows may span texts.

    The words' hashes are spread over 64 bits already: a sum with an odd factor for each
    place, mixed once, tells windows apart.
    """
    n = max(0, len(hashed) - width + 1)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashed[k : k + n] * factors[k]
    return mixed(total)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, of lower-cased words; a text with fewer
    words than ``width`` has its whole sequence as one, one without words none."""
    flat, counts = words(texts, lower=True)
    hashed = word_hashes(flat)
    windows = rolling(hashed, width)
    ends = np.cumsum(counts)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= width:
            out.append(np.unique(windows[end - n : end - width + 1]))
        elif n:
            out.append(rolling(hashed[end - n : end], n) ^ np.uint64(n))
        else:
            out.append(hashed[:0])
    return out


def digest(found: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()
