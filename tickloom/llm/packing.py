"""Packing along a space-filling curve.

Each document's token counts are hashed to a sparse vector, scaled to length one
and projected to ``DIMS`` dimensions; the point's Hilbert key puts similar
documents next to each other on a line. Along that line documents are laid end to
end and cut every ``length`` tokens, so only the last sequence needs padding.

A document's place on the line is the sum of the lengths before it. That sum is
taken over narrow rows (key, id, length) in ranges; the ids themselves are joined
to their places by row and cut where they are, so no task holds more than its
share however long a run of equal keys is.

Defined results: a null text is empty and becomes the end id alone; equal keys
are ordered by doc_id (nulls first) and then by row; rows that repeat a doc_id are
packed once each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, only, running_start
from tickloom.llm.tokens import crc32_ids, encoder

LENGTH, DIMS, BITS, HASHED = 4096, 4, 12, 4096


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points (n, dims) with coordinates below 2**bits.

    Level by level from the top: a point's orthant, seen in the frame of the
    sub-curve it lies in, gives the next ``dims`` bits; the frame is then turned
    (low bits inverted, or swapped with the first axis), after which the Gray code
    over all levels is undone.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(dims):
            inverted = (x[i] >> level) & 1 == 1
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(inverted, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> level) & 1 == 1, flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def projection() -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1.0, 1.0]), (HASHED, DIMS))


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(row, doc_id, curve, n_tokens, ids): ids as little-endian bytes of the tokenizer's width."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("curve", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, plane = encoder(path, literal=False), projection()
        last, row = np.array([end], encode.dtype).tobytes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids = [encode(t or "") + last for t in part.column(1).to_pylist()]
                spots = np.empty((len(ids), DIMS))
                for i, raw in enumerate(ids):
                    counts = np.bincount(np.frombuffer(raw, encode.dtype) % HASHED, minlength=HASHED)
                    spots[i] = counts @ plane / np.sqrt(counts @ counts)
                grid = np.clip((spots + 4) * (1 << BITS) / 8, 0, (1 << BITS) - 1)
                sizes = [len(raw) // encode.width for raw in ids]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(ids)), pa.int64()), part.column(0), pa.array(hilbert(grid, BITS)), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)
                row += len(ids)

    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve[, ids]) of ``docs``.

    ``path`` is a tokenizer file; ``ids`` is the piece's ids, little-endian.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    stored = scratch.store(tokenised(docs, path, end), "tokens")
    places = running_start(scratch, stored.select("curve", "doc_id", "row", "n_tokens"), ["curve", "doc_id", "row"], "n_tokens", "places").select("row", F.col("start").alias("place"))
    fields = [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def cut(batches):
        import pyarrow as pa

        encode = encoder(path, literal=False)
        for batch in batches:
            out = [[] for _ in schema.names]
            for doc, curve, n, raw, place in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, at = np.frombuffer(raw, encode.dtype), 0
                while at < n:
                    take = min(n - at, length - (place + at) % length)
                    piece = ids[at : at + take]
                    for column, value in zip(out, (doc, at, take, crc32_ids(piece), n, (place + at) // length, (place + at) % length, curve, piece.tobytes()), strict=False):
                        column.append(value)
                    at += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(schema.names, out, strict=True)], names=schema.names)

    joined = stored.join(places, "row").select("doc_id", "curve", "n_tokens", "ids", "place")
    return joined.mapInArrow(cut, schema)
