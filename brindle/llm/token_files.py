"""Token-id files: fixed-size blocks of ids, turned into byte or bit planes, each plane compressed with zstandard.

A file is a Parquet folder whose rows are blocks, ordered by (shard, block).  A block has a number of ids (BLOCK but for a
shard's last), the bytes of an id, whether its planes are of bits, its compressed planes, and an entry of the chunk index: the place of its first id in the shard and the
pieces of documents in it.  Parquet gives the folder the commit protocol, the column pruning (the index is read without
the planes) and the reach of any store that Spark reads; the planes are opaque to it.

Shards are ranges of doc_id; the ids of a shard stand in ascending order of doc_id.  The place of a document in the whole
is its place in the shard plus the ids of all shards before.

Cases: a null or empty text is its end id alone; rows that share a doc_id follow each other, ordered by text, and stay
separate; null doc_ids come first; no rows give an empty file; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import few, named, ranges_for, with_base
from ._tokens import cut, default_tokenizer, encoded, encoder

#: Ids in a block.
BLOCK = 1 << 16

_PIECE = "ordinal: bigint, doc_id: bigint, first: bigint, length: bigint, begins: boolean, ends: boolean"
SCHEMA = f"shard long, block long, first long, n_ids long, id_bytes int, bits boolean, planes array<binary>, pieces array<struct<{_PIECE}>>"
_ARROW_PIECE = pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("length", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_())])
_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("bits", pa.bool_()), ("planes", pa.list_(pa.binary())), ("pieces", pa.list_(_ARROW_PIECE))])


def to_planes(ids: np.ndarray, *, bits: bool = False) -> list[bytes]:
    """The byte planes (or bit planes) of an array of unsigned ids, lowest first."""
    width = ids.dtype.itemsize
    flat = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width)
    if bits:
        flat = np.packbits(np.unpackbits(flat, axis=1, bitorder="little"), axis=0, bitorder="little")
    return [flat[:, k].tobytes() for k in range(flat.shape[1])]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype) -> np.ndarray:
    """The inverse of to_planes: one plane for each byte of ``dtype``, or else one for each bit; any other number is an error."""
    if len(planes) not in (np.dtype(dtype).itemsize, 8 * np.dtype(dtype).itemsize):
        raise ValueError(f"{len(planes)} planes are no ids of {np.dtype(dtype).itemsize} bytes")
    dtype = np.dtype(dtype)
    flat = np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1) if n else np.empty((0, dtype.itemsize), np.uint8)
    if len(planes) == 8 * dtype.itemsize and n:
        flat = np.packbits(np.unpackbits(flat, axis=0, count=n, bitorder="little"), axis=1, bitorder="little")
    return np.ascontiguousarray(flat).view(dtype).reshape(-1)


class _Shard:
    """Collects the ids of a task and gives them out in blocks."""

    def __init__(self, number: int, dtype: np.dtype, bits: bool, level: int):
        import zstandard

        self.number, self.dtype, self.bits = number, dtype, bits
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.position = self.ordinal = 0
        self.ids, self.pieces = np.empty(0, dtype), None  # of the block that isn't full, and maybe of those before it

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes the ids of further documents; gives the blocks that are full."""
        n = np.diff(offsets)
        row, block, start, size = cut(self.position + offsets[:-1], n, BLOCK)
        ends = start + size == n[row]
        columns = [pa.array(self.ordinal + row), doc_ids.take(pa.array(row)), pa.array((self.position + offsets[row] + start) % BLOCK), pa.array(size), pa.array(start == 0), pa.array(ends), pa.array(block)]
        more = pa.table(columns, names=[*[f.name for f in _ARROW_PIECE], "block"])
        self.pieces = more if self.pieces is None else pa.concat_tables([self.pieces, more])
        self.ids = np.concatenate([self.ids, ids])
        self.position, self.ordinal = self.position + len(ids), self.ordinal + len(n)
        full = self.position // BLOCK
        if len(self.ids) >= BLOCK:
            yield self._blocks(full)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if len(self.ids):
            yield self._blocks(-(-self.position // BLOCK))

    def _blocks(self, stop: int) -> pa.RecordBatch:
        """The blocks below ``stop``, one row each."""
        of = self.pieces.column("block").to_numpy()
        first, done = int(of[0]), int(np.searchsorted(of, stop))
        ids, self.ids = self.ids[: (stop - first) * BLOCK], self.ids[(stop - first) * BLOCK :]
        pieces, self.pieces = self.pieces.slice(0, done).drop_columns(["block"]).combine_chunks(), self.pieces.slice(done)
        parts = [ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK)]
        planes = [[self.compress(x) for x in to_planes(part, bits=self.bits)] for part in parts]
        number = np.arange(first, stop)
        flat = pa.StructArray.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in pieces.columns], fields=list(_ARROW_PIECE))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[:done], np.arange(first, stop + 1)), pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), self.number)), pa.array(number), pa.array(number * BLOCK), pa.array([len(x) for x in parts], pa.int64()), pa.array(np.full(len(parts), self.dtype.itemsize, np.int32)), pa.array(np.full(len(parts), self.bits)), pa.array(planes, pa.list_(pa.binary())), lists], schema=_ARROW)


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, bits: bool = False, level: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the documents in ascending order of ``id_col`` and writes them to ``path``; one shuffle, of the texts."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(TaskContext.get().partitionId(), encoder(tokenizer).dtype, bits, level)
        for batch in batches:
            for at, ids, offsets in encoded(batch.column(1), tokenizer, end_id):
                yield from shard.add(batch.column(0).slice(at, len(offsets) - 1), ids, offsets)
        yield from shard.rest()

    rows = named(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")  # rows that share a doc_id need not share a shard
    dealt = rows.repartitionByRange(ranges_for(rows, F.octet_length("text")), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    dealt.mapInArrow(run, SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def decoded(files: DataFrame) -> DataFrame:
    """(shard, ordinal, doc_id, first, length, ids_crc32): each piece of a document, from the ids of its decoded block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(batch.num_rows):
                n, first, planes = batch.column(3)[k].as_py(), batch.column(2)[k].as_py(), batch.column(5)[k].as_py()
                wide = memoryview(from_planes([expand(x) for x in planes], n, np.dtype(f"<u{batch.column(4)[k].as_py()}")).astype("<u4").tobytes())
                pieces = batch.column(6)[k].values
                begin, length = pieces.field("first").to_numpy(), pieces.field("length").to_numpy()
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crc), batch.column(0)[k].as_py())), pieces.field("ordinal"), pieces.field("doc_id"), pa.array(first + begin), pieces.field("length"), pa.array(crc, pa.int64())],
                    ["shard", "ordinal", "doc_id", "first", "length", "crc"],
                )

    return files.select("shard", "block", "first", "n_ids", "id_bytes", "planes", "pieces").mapInArrow(run, "shard long, ordinal long, doc_id long, first long, length long, crc long")


_CRC_POLY, _ONE = 0xEDB88320, 1 << 31  # crc32's polynomial and 1, lowest power in the highest bit


def _times(a: int, b: int) -> int:
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (_CRC_POLY if b & 1 else 0)
    return product


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes that come in parts, from each part's (crc32, number of bytes)."""
    crc = 0
    for part, n in parts:
        power, square, bits = _ONE, 1 << 30, 8 * n  # x ** bits, by squaring
        while bits:
            if bits & 1:
                power = _times(power, square)
            square, bits = _times(square, square), bits >> 1
        crc = _times(power, crc) ^ part
    return crc


def documents_of(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard): every document as the files have it; pieces are joined by their checksums."""

    @F.pandas_udf("long")
    def joined(crc: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([int(c[0]) if len(c) == 1 else crc32_joined([(int(x), 4 * int(m)) for x, m in zip(c, n, strict=True)]) for c, n in zip(crc, length, strict=True)], dtype="int64")

    placed = with_base(files.select("shard", "n_ids").groupBy("shard").agg(F.sum("n_ids").alias("n_ids")), "shard", F.col("n_ids"), "base").select("shard", "base")
    docs = decoded(files).groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("first", "length", "crc"))).alias("parts")
    )
    docs = docs.join(few(placed), "shard")
    return docs.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", joined("parts.crc", "parts.length").alias("ids_crc32"), "shard")
