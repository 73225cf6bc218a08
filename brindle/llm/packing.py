"""Packing documents into training sequences of a fixed number of tokens: concatenate and cut.

Pass one encodes the documents where they are scanned and stores their ids with the position inside the task's own
stream.  The totals of the tasks give each stream its place in the whole (a prefix sum over one number for each task).
Pass two cuts at the multiples of the sequence length.  Nothing is sorted or shuffled but the totals, and only the last
sequence is ever padded.

Cases: a null or empty text is its end id alone; null and repeated doc_ids are packed row by row; no rows give no pieces;
a text longer than a sequence has a piece in each sequence that it runs through; columns other than the two that are
named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import named, with_base, written
from ._tokens import as_binary, cut, default_tokenizer, encoded, encoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "begins boolean, ends boolean"
)


def token_rows(docs: DataFrame, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids): each document's ids and end id, in the order in which its task read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, position = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, offsets in encoded(batch.column(1), tokenizer, end_id):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), batch.column(0).slice(first, n).cast(pa.int64()), pa.array(position + offsets[:-1]), pa.array(np.diff(offsets)), as_binary(ids, offsets)],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                position += int(offsets[-1])

    rows = named(docs, id_col, text_col).mapInArrow(run, "part long, doc_id long, local_start long, n_tokens long, ids binary")
    return written(rows, "packing")


def pack(docs: DataFrame, *, length: int = 1024, end_id: int = 0, tokenizer: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of ``length`` ids; with ``keep_ids`` each piece carries its ids.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's ids before it; ``begins`` and
    ``ends`` tell whether the piece holds the document's first and last id.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = with_base(token_rows(docs, tokenizer=tokenizer, end_id=end_id, id_col=id_col, text_col=text_col), "part", F.col("n_tokens"), "base")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(1).to_numpy() + batch.column(4).to_numpy()
            n = batch.column(2).to_numpy()
            row, sequence, start, size = cut(places, n, length)
            begin = places[row] + start
            crc, ids, now, wide = np.empty(len(row), np.int64), [], -1, memoryview(b"")
            for k, (r, a, m) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                if r != now:
                    now, wide = r, memoryview(np.frombuffer(batch.column(3)[r].as_buffer(), dtype).astype("<u4").tobytes())
                crc[k] = zlib.crc32(wide[4 * a : 4 * (a + m)])
                if keep_ids:
                    ids.append(bytes(wide[4 * a : 4 * (a + m)]))
            out = [batch.column(0).take(pa.array(row)), *map(pa.array, (start, size, crc, n[row], sequence, begin - sequence * length, start == 0, start + size == n[row]))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * keep_ids, names)

    schema = PIECES + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.select("doc_id", "local_start", "n_tokens", "ids", "base").mapInArrow(pieces, schema)


def sequences(pieces: DataFrame, *, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of ``pack(keep_ids=True)`` put together.

    A group is at most ``length`` ids long.  A short last sequence is padded to ``length``, unless its length is a power
    of two, for which kernels need no padding.
    """

    @F.pandas_udf("binary")
    def joined(parts: pd.Series, n: pd.Series) -> pd.Series:
        whole = [b"".join(x) for x in parts]
        return pd.Series([x if m == length or m & (m - 1) == 0 else x + np.full(length - m, pad_id, "<u4").tobytes() for x, m in zip(whole, n, strict=True)])

    joined_parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return joined_parts.select("sequence_id", "n_tokens", joined(F.col("_parts.ids"), "n_tokens").alias("ids"))
