"""Words and word pairs of many texts at once: numpy cuts a slab of texts, numbers stand for words, and characters are compared where a number is met."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import ship

#: Characters of the texts that are cut together; a longer text is cut alone, its words numbered and compared in pieces of about as many.
SLAB = 1 << 19

#: Bytes, just under the most up to which glibc keeps what is freed.
KEPT = 31 << 20

#: Of the polynomial whose value is a word's number.
BASE = 0x9E3779B97F4A7C15


class Cut(NamedTuple):
    """The words of a slab in order: where each begins, its length, text and number; the first words of pairs, and the pairs' numbers."""

    whole: str
    points: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    one: np.ndarray
    first: np.ndarray
    two: np.ndarray

    def numbers(self, grams: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all terms of so many words, and the terms' numbers."""
        return (np.arange(len(self.one)), self.one) if grams == 1 else (self.first, self.two)

    def terms(self, i: np.ndarray, grams: int) -> list[str]:
        """The terms that begin with words i."""
        words = [[self.whole[a : a + n] for a, n in zip(self.start[j].tolist(), self.length[j].tolist(), strict=True)] for j in (i, i + 1)[:grams]]
        return list(map(" ".join, zip(*words, strict=True)))


@cache
def _letters() -> np.ndarray:
    """Whether a code point stands in words, as ``\\w`` has it."""
    found = np.zeros(0x110000, bool)
    for m in re.finditer(r"\w+", "".join(map(chr, range(0x110000)))):
        found[m.start() : m.end()] = True
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))


def _pieces(length: np.ndarray) -> Iterator[slice]:
    """Slices of some words each, of about SLAB characters."""
    before = np.cumsum(length) - length
    edges = np.unique(np.searchsorted(before, np.arange(0, before[-1] + 1, SLAB))).tolist() + [len(length)] if len(length) else []
    for a, b in zip(edges, edges[1:]):
        yield slice(a, b)


def _places(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of some words begins if they stand side by side, and the place of each character in its word."""
    end = np.cumsum(length)
    return end - length, np.arange(end[-1]) - np.repeat(end - length, length)


def _numbers(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each word, from sums over the characters before its start and its end."""
    out = np.zeros(len(start), np.uint64)
    for piece in _pieces(length):
        low, own = start[piece][0], length[piece]
        begin = start[piece] - low
        n = int(begin[-1] + own[-1])
        powers, inverse = _powers(max(2 * SLAB, 1 << n.bit_length()))
        before = np.zeros(n + 1, np.uint64)
        np.multiply(points[low : low + n], powers[:n], out=before[1:])
        np.cumsum(before, out=before)
        out[piece] = (before[begin + own] - before[begin]) * inverse[begin]
    return _mixed(out + length.astype(np.uint64))


def _same(a: Cut, i: np.ndarray, b: Cut, j: np.ndarray, grams: int) -> np.ndarray:
    """Whether the terms that begin with words i of a slab have the characters of those that begin with words j of another."""
    same = np.ones(len(i), bool)
    for k in range(grams):
        same &= a.length[i + k] == b.length[j + k]
    for k in range(grams):
        at = np.flatnonzero(same)
        for piece in _pieces(a.length[i[at] + k]):
            some = at[piece]
            x, y = i[some] + k, j[some] + k
            begin, place = _places(a.length[x])
            other = a.points[np.repeat(a.start[x], a.length[x]) + place] != b.points[np.repeat(b.start[y], a.length[x]) + place]
            same[some] = ~np.logical_or.reduceat(other, begin)
    return same


class Terms:
    """Terms that are looked for: their words cut, and their numbers in order."""

    def __init__(self, terms: Iterable[str], size: int = 1 << 16):  # a power of two
        self.names = list(terms)
        self.cut, self.size = cut(self.names, grams=2), size
        self.at, self.opened = {}, np.zeros(size, bool)
        words = np.bincount(self.cut.text, minlength=len(self.names))
        for grams in (1, 2):
            first, number = self.cut.numbers(grams)
            own = words[self.cut.text[first]] == grams
            first, number = first[own], number[own]
            order = np.argsort(number, kind="stable")
            self.at[grams] = first[order], number[order], len(np.unique(number)) == len(number)
            self.opened[number & np.uint64(size - 1)] = True
        self.index = {t: k for k, t in enumerate(self.names)}

    def found(self, c: Cut, grams: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the terms of ``grams`` words that are looked for, and which these are."""
        first, number = c.numbers(grams)
        own, known, distinct = self.at[grams]
        at = np.flatnonzero(self.opened[(number & np.uint64(self.size - 1)).view(np.int64)])
        if not len(known) or not len(at):
            return first[:0], first[:0]
        i = first[at]
        if not distinct:  # two of the terms share a number
            which = np.array([self.index.get(t, -1) for t in c.terms(i, grams)])
            return i[which >= 0], which[which >= 0]
        place = np.minimum(np.searchsorted(known, number[at]), len(known) - 1)
        met = known[place] == number[at]
        i, j = i[met], own[place[met]]
        same = _same(c, i, self.cut, j, grams)
        return i[same], self.cut.text[j[same]]


@lru_cache(8)
def _stopped(stop: tuple[str, ...]) -> Terms:
    return Terms(stop)


def cut(texts: list[str], stop: tuple[str, ...] = (), grams: int = 2) -> Cut:
    """The words of the texts, of two letters, digits or underscores at least, without those of ``stop``, and the pairs that follow each other in a text."""
    whole = "\n".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    inside = _letters()[points]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate([[0] * bool(len(inside) and inside[0]), edge, [len(inside)] * bool(len(inside) and inside[-1])]).astype(np.int64)
    start, length = edge[::2], edge[1::2] - edge[::2]
    long = length > 1
    start, length = start[long], length[long]
    one = _numbers(points, start, length)
    begin = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begin), prepend=0))
    none = np.zeros(0, np.int64)
    c = Cut(whole, points, start, length, text, one, none, one[:0])
    if stop and len(one):
        kept = np.ones(len(one), bool)
        kept[_stopped(stop).found(c, 1)[0]] = False
        c = c._replace(start=start[kept], length=length[kept], text=text[kept], one=one[kept])
    if grams == 2 and len(c.one) > 1:
        first = np.flatnonzero(c.text[:-1] == c.text[1:])
        c = c._replace(first=first, two=_mixed(c.one[first] * np.uint64(0x9E3779B97F4A7C15) + c.one[first + 1] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return c


def counted(c: Cut, row: np.ndarray, opened: np.ndarray, grams: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The terms of ``grams`` words whose counters are opened, how often they occur, and in how many rows."""
    first, number = c.numbers(grams)
    at = np.flatnonzero(opened[(number & np.uint64(len(opened) - 1)).view(np.int64)])
    i = first[at]
    coded = pa.array(number[at]).dictionary_encode()
    code, k = coded.indices.to_numpy(), len(coded.dictionary)
    lead = np.zeros(k, np.int64)
    lead[code] = i
    names = c.terms(lead, grams)
    if len(i) and not _same(c, i, c, lead[code], grams).all():  # terms that share a number
        coded = pa.array(c.terms(i, grams)).dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        k = len(names)
    if not k:
        return [], lead, lead
    return names, np.bincount(code, minlength=k), np.bincount(pa.array(row[c.text[i]] * k + code).unique().to_numpy() % k, minlength=k)


def slabs(column: pa.ListArray) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts of a few rows after another, and the row of each text."""
    np.empty(KEPT, np.uint8)  # freed at once: from then on the allocator keeps the arrays of a slab for the next one
    texts, rows, size = [], [], 0
    for i, own in enumerate(column):
        own = own.as_py()
        n = sum(map(len, own))
        if texts and size + n > SLAB:
            yield texts, np.array(rows, np.int64)
            texts, rows, size = [], [], 0
        texts += own
        rows += [i] * len(own)
        size += n
    if texts:
        yield texts, np.array(rows, np.int64)


def characters(docs: DataFrame, *, key: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """(key, n, counts): the characters of each text, and how many of each kind of ASCII characters; bytes are counted, a text at a time."""
    ship(docs.sparkSession)
    found = np.zeros((256, 1 + len(kinds)), np.int64)
    found[:, 0] = [b & 0xC0 != 0x80 for b in range(256)]  # where a character begins
    for j, kind in enumerate(kinds):
        found[list(kind.encode("ascii")), 1 + j] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            own = np.array([np.bincount(raw[a:b], minlength=256) @ found for a, b in zip(offsets, offsets[1:])], np.int64).reshape(-1, 1 + len(kinds))
            counts = pa.ListArray.from_arrays(pa.array(range(0, own.shape[0] * len(kinds) + 1, len(kinds)), pa.int32()), pa.array(own[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own[:, 0]), counts], [key, "n", "counts"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n long, counts array<long>")
