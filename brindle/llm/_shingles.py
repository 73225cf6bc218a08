"""Words and word shingles of whole texts as 64-bit hashes, computed for a batch at a time over its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

#: Bytes that are hashed at once: some arrays of eight bytes for each.
CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all (the finalizer of a common hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base below the n-th, and of its inverse modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (_BASE, inverse))
    return _POWERS


_POWERS = (np.ones(1, np.uint64),) * 2


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array, end to end, and where each begins (and the last ends); a null is empty."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if texts.null_count:
        sizes = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if sizes.sum() != offsets[-1] - offsets[0]:  # a null may have bytes
            return text_bytes(texts.fill_null(""))
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number of the first text, bytes and offsets of about ``most`` bytes of whole texts at a time."""
    raw, offsets = text_bytes(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes of a kind, by default all but ASCII white space; a run ends where its text does."""
    word = kind[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]  # where texts that aren't empty begin
    first[filled] = word[filled]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = word[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, *, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where the words of each text begin (and the last end)."""
    begin, end = word_spans(raw, offsets)
    powers, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64)), np.searchsorted(begin, offsets)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_hashes(raw: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each run of letters and digits a hash of it and of its first bytes, for each length in ``prefixes``; and where those of each text begin."""
    begin, end = word_spans(raw, offsets, _ALNUM)
    powers, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    stops = [end, *[np.minimum(begin + n, end) for n in prefixes]]
    return [mixed((sums[stop] - sums[begin]) * inverse[begin] + np.uint64(k)) for k, stop in enumerate(stops)], np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all runs of ``width`` words; of fewer words, the hash of all as one; of none, none."""
    width = min(width, len(words))
    if not width:
        return words
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ words[k : len(words) - width + 1 + k]) * _STEP
        h ^= h >> np.uint64(29)
    return mixed(h)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for _, raw, offsets in chunks(texts):
        words, at = word_hashes(raw, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(shingle_hashes(words[a:b], width))
