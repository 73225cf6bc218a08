"""Whole-text encoding with the tokenizers library, by distinct segments.

A byte-level BPE never merges across a space that follows a non-space character, so a text may be cut in front of
every such space and each distinct segment encoded once.  Words repeat, so this takes a fraction of the time that
encoding the running text takes, and gives the same ids.  The segments of a batch are told apart by Arrow's dictionary
encoding, and the ids of its texts are gathered from those of its distinct segments, so Python sees only the new ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shingles import text_bytes

#: Segments that a worker keeps between batches (some 30 MB), the second half only if they repeat; the rest is encoded once for each batch.
KEPT_SEGMENTS = 1_000_000
#: Bytes of the longest segments that are kept: longer ones rarely come again.
KEPT_LENGTH = 12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def segment_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text that isn't empty, and at each space behind a character that isn't white space."""
    starts = np.zeros(len(raw), bool)
    starts[1:] = (raw[1:] == 0x20) & ~_SPACE[raw[:-1]]
    at = np.flatnonzero(starts)
    wide = raw[at - 1] >= 0x80
    if wide.any():  # the character before has several bytes: not all of these are letters
        w = at[wide]
        c, b, a = raw[w - 1].astype(np.int64), raw[w - 2].astype(np.int64), raw[np.maximum(w - 3, 0)].astype(np.int64)
        three = a << 16 | b << 8 | c
        space = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        space |= (three == 0xE19A80) | (three == 0xE2819F) | (three == 0xE38080)
        space |= (three >= 0xE28080) & (three <= 0xE2808A) | (three == 0xE280A8) | (three == 0xE280A9) | (three == 0xE280AF)
        starts[w[space]] = False
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


class SegmentEncoder:
    """Encodes texts to little-endian ids of ``width`` bytes each; texts that spell a special token stay ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)  # no segment comes twice
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each token; the vocabulary writes a byte as a character
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)
        self.kept = pa.array([], pa.large_string())  # segments, whose ids stand in ``ids`` up to ``ends``
        self.ids, self.ends = np.empty(0, self.dtype), np.zeros(1, np.int64)

    def _learn(self, unseen: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments end to end, and the number of each.

        Segments that begin with a space and don't end in one are encoded as one text, cut again by the bytes of its tokens.
        """
        joins = np.fromiter((x[0] == " " and not x[-1].isspace() for x in unseen), bool, len(unseen))
        n, parts = np.zeros(len(unseen), np.int64), {}
        inner, outer = np.flatnonzero(joins), np.flatnonzero(~joins)
        for e, k in zip(self.tokenizer.encode_batch_fast([unseen[k] for k in outer.tolist()], add_special_tokens=False), outer.tolist(), strict=True):
            n[k], parts[k] = len(e.ids), e.ids
        flat = []
        for i in range(0, len(inner), 10_000):
            some = inner[i : i + 10_000]
            text = [unseen[k] for k in some.tolist()]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(text)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in text), np.int64, len(text)))
            n[some] = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1, prepend=0)
            flat.append(ids)
        out = np.empty(n.sum(), self.dtype)
        out[np.repeat(joins, n)] = np.concatenate([*flat, np.empty(0, self.dtype)])
        begin = np.cumsum(n) - n
        for k, ids in parts.items():
            out[begin[k] : begin[k] + n[k]] = ids
        return out, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where those of each begin (and the last end); a null or empty text has none."""
        raw, offsets = text_bytes(texts)
        begin = segment_starts(raw, offsets)
        if not len(begin):
            return np.empty(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        bounds = np.append(begin, len(raw))
        segments = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        which, distinct = segments.indices.to_numpy(), segments.dictionary

        place = pc.fill_null(pc.index_in(distinct, self.kept), -1).to_numpy()
        unseen = np.flatnonzero(place < 0)
        news = distinct.take(pa.array(unseen))
        new, n_new = self._learn(news.to_pylist())
        table, first = np.concatenate([self.ids, new]), np.empty(len(distinct), np.int64)
        n = np.empty(len(distinct), np.int64)
        seen = place[place >= 0]
        first[place >= 0], n[place >= 0] = self.ends[seen], self.ends[seen + 1] - self.ends[seen]
        first[unseen], n[unseen] = len(self.ids) + np.cumsum(n_new) - n_new, n_new
        if len(self.kept) < KEPT_SEGMENTS:
            self._keep(news, np.bincount(which, minlength=len(distinct))[unseen], new, n_new)

        sizes = n[which]
        ends = np.cumsum(sizes)
        out = table[np.arange(ends[-1]) + np.repeat(first[which] - (ends - sizes), sizes)]
        return out, np.concatenate([[0], ends])[np.searchsorted(begin, offsets)]

    def _keep(self, news: pa.Array, count: np.ndarray, new: np.ndarray, n_new: np.ndarray) -> None:
        """Keeps new segments, first all that aren't long, then those that came more than once in their batch."""
        keep = np.asarray(pc.binary_length(news)) <= KEPT_LENGTH
        if len(self.kept) > KEPT_SEGMENTS // 2:
            keep &= count > 1
        self.kept = pa.concat_arrays([self.kept, news.filter(pa.array(keep))])
        self.ids = np.concatenate([self.ids, new[np.repeat(keep, n_new)]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_new[keep])])


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each worker process and vocabulary, so that its segments stay over the tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def encoded(texts: pa.Array, path: str, end_id: int, most: int = 8 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number of the first text, the ids of it and the texts after it, each with its end id, and where each begins.

    About ``most`` bytes of text at a time, so that a batch of long texts needs no more memory than another.
    """
    enc = encoder(path)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        ids, offsets = enc.encode(texts.slice(a, b - a))
        yield a, np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
        a = b


def as_binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The ids of each text as bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * ids.itemsize), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def cut(places: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of runs of ids that stand at ``places``, cut at every multiple of ``length``.

    For each piece the number of its run, of its window, the ids of the run before it and its own.
    """
    first, last = places // length, (places + sizes - 1) // length
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    begin = np.maximum(window * length, places[row])
    return row, window, begin - places[row], np.minimum((window + 1) * length, places[row] + sizes[row]) - begin
