"""Token ids in binary files, compressed by a range asymmetric numeral system (rANS).

One table of symbol frequencies, counted over the whole corpus and scaled to
2**PRECISION, is shared by all files. A file holds consecutive documents in
ascending doc_id order, cut into blocks of at most BLOCK ids. A block is coded on
its own by interleaved lanes: id i belongs to lane i modulo the number of lanes,
every lane has a 64-bit state and all lanes share one stream of 32-bit words. A
block stores the lanes' first states, checkpoints (states and stream position
every MARK steps, so decoding can start inside a block) and checksums of its
payload and of its ids.

File layout, little-endian: MAGIC, crc32 of the table, blocks, directory
(zlib: doc ids, which of them are known, ids per document), footer (offset and
size of every block and of the directory, number of blocks, MAGIC).

Files are written under a name of their own and moved into place, so a repeated
task leaves one whole file. They are read and written through ``pyarrow.fs`` by
URI: a shared file system, HDFS or an object store.

Defined results: a null text is empty and becomes the end id alone; a null doc_id
comes first; rows that repeat a doc_id are written once each, next to each other;
an empty table gives no file and an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, only, parts
from tickloom.llm.tokens import crc32_ids, encoder

MAGIC, PRECISION, BLOCK, LANES, MARK = b"RANSIDS1", 18, 1 << 18, 1024, 128
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
_HEAD = struct.Struct("<IIIIII")  # ids, lanes, checkpoints, words, crc32 of payload, crc32 of ids
_WORD = np.uint64(32)


class Frequencies:
    """Scaled frequencies of the ids that occur, their running sums, and the id at each slot."""

    def __init__(self, counts: dict[int, int]):
        ids = np.array(sorted(counts), np.int64)
        have = np.array([counts[i] for i in ids.tolist()], np.float64)
        total = 1 << PRECISION
        if len(ids) > total:
            raise ValueError("more symbols than slots")
        scaled = np.maximum(1, np.floor(have * (total / have.sum()))).astype(np.int64) if len(ids) else have.astype(np.int64)
        gap, order, at = total - int(scaled.sum()), np.argsort(-have, kind="stable"), 0
        while gap and len(ids):  # hand the rest to, or take it from, the most frequent ids
            i = order[at % len(order)]
            step = gap if gap > 0 else -min(-gap, int(scaled[i]) // 2)
            scaled[i] += step
            gap -= step
            at += 1
        size = int(ids[-1]) + 1 if len(ids) else 0
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids] = scaled
        self.start[ids] = np.concatenate(([0], np.cumsum(scaled)[:-1])) if len(ids) else 0
        self.slots = np.repeat(ids, scaled).astype(np.uint32)
        self.crc = zlib.crc32(self.freq.tobytes())

    def to_bytes(self) -> bytes:
        packed = zlib.compress(self.freq.astype("<u4").tobytes())
        return MAGIC + struct.pack("<II", self.crc, len(packed)) + packed

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Frequencies":
        crc, n = struct.unpack_from("<II", raw, 8)
        freq = np.frombuffer(zlib.decompress(raw[16 : 16 + n]), "<u4")
        ids = np.flatnonzero(freq)
        out = cls.__new__(cls)
        out.freq = freq.astype(np.uint64)
        out.start = np.zeros(len(freq), np.uint64)
        out.start[ids] = np.concatenate(([0], np.cumsum(freq[ids].astype(np.int64))[:-1])) if len(ids) else 0
        out.slots = np.repeat(ids, freq[ids]).astype(np.uint32)
        out.crc = zlib.crc32(out.freq.tobytes())
        if raw[:8] != MAGIC or out.crc != crc:
            raise ValueError("damaged frequency table")
        return out


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    n, bits = len(ids), np.uint64(PRECISION)
    lanes = min(LANES, max(1, n // 256))
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    most = freq << np.uint64(63 - PRECISION)  # a state at or above this gives up its low word first
    state, words, marks, behind = np.full(lanes, LOW), [], [], 0
    for step in range(steps - 1, -1, -1):
        s = slice(step * lanes, min(n, (step + 1) * lanes))
        x = state[: s.stop - s.start]
        full = x >= most[s]
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            behind += len(words[-1])
            x[full] >>= _WORD
        whole = x // freq[s]
        x[:] = (whole << bits) + (x - whole * freq[s]) + start[s]
        if step and step % MARK == 0:
            marks.append((behind, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = [state.astype("<u8").tobytes()]
    for left, at in reversed(marks):
        body.append(struct.pack("<I", len(stream) - left) + at.astype("<u8").tobytes())
    body.append(stream.tobytes())
    payload = b"".join(body)
    return _HEAD.pack(n, lanes, len(marks), len(stream), zlib.crc32(payload), crc32_ids(ids)) + payload


def decode_block(raw: bytes, table: Frequencies, mark: int = 0) -> np.ndarray:
    """Ids of a block, from checkpoint ``mark`` on (0: all of it). Checksums are verified."""
    n, lanes, marks, size, crc, ids_crc = _HEAD.unpack_from(raw)
    payload = raw[_HEAD.size :]
    if zlib.crc32(payload) != crc:
        raise ValueError("damaged block")
    entry = 4 + 8 * lanes
    stream = np.frombuffer(payload, "<u4", size, 8 * lanes + marks * entry)
    if mark:
        at = 8 * lanes + (mark - 1) * entry
        place = struct.unpack_from("<I", payload, at)[0]
        state = np.frombuffer(payload, "<u8", lanes, at + 4).astype(np.uint64)
    else:
        place, state = 0, np.frombuffer(payload, "<u8", lanes).astype(np.uint64)
    bits, low = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)
    first = mark * MARK * lanes
    out = np.empty(n - first, np.uint32)
    for step in range(mark * MARK, -(-n // lanes)):
        k = min(n, (step + 1) * lanes) - step * lanes
        x = state[:k]
        slot = x & low
        ids = table.slots[slot]
        out[step * lanes - first : step * lanes - first + k] = ids
        x[:] = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        want = x < LOW
        taken = int(np.count_nonzero(want))
        if taken:
            x[want] = (x[want] << _WORD) | stream[place : place + taken]
            place += taken
    if not mark and crc32_ids(out) != ids_crc:
        raise ValueError("decoded ids differ from those written")
    return out


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_whole(uri: str, pieces) -> int:
    """Write the pieces under another name, then move the file into place."""
    from pyarrow.fs import FileType

    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft, size = f"{path}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(draft) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    if system.get_file_info(path).type != FileType.NotFound:
        system.delete_file(path)  # an earlier attempt's file, of the same content
    system.move(draft, path)
    return size


def file_pieces(rows, dtype, table: Frequencies):
    """The bytes of a file of (doc_id, ids) rows, one block in memory at a time."""
    offset, ends, held, size, docs, known, lengths = 12, [], [], 0, [], [], []
    yield MAGIC + struct.pack("<I", table.crc)

    def blocks(last: bool):
        nonlocal held, size, offset
        while size >= BLOCK or (last and size):
            ids = np.concatenate(held)
            raw = encode_block(ids[:BLOCK], table)
            held, size = [ids[BLOCK:]], max(0, size - BLOCK)
            ends.append((offset, len(raw)))
            offset += len(raw)
            yield raw

    for doc, raw in rows:
        ids = np.frombuffer(raw, dtype)
        docs.append(doc or 0), known.append(doc is not None), lengths.append(len(ids))
        held.append(ids)
        size += len(ids)
        yield from blocks(False)
    yield from blocks(True)
    directory = zlib.compress(np.array(docs, "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + np.array(known, np.uint8).tobytes())
    ends.append((offset, len(directory)))
    yield directory
    yield b"".join(struct.pack("<QQ", *e) for e in ends) + struct.pack("<I", len(ends) - 1) + MAGIC


class Reader:
    """Random access to a file's blocks and directory."""

    def __init__(self, uri: str, table: Frequencies):
        system, path = _open(uri)
        self.file, self.table = system.open_input_file(path), table
        size = self.file.size()
        n, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        head = self.file.read_at(12, 0)
        if magic != MAGIC or head[:8] != MAGIC or struct.unpack("<I", head[8:])[0] != table.crc:
            raise ValueError(f"{uri} is damaged or has another table")
        raw = self.file.read_at(16 * (n + 1), size - 12 - 16 * (n + 1))
        self.places = [struct.unpack_from("<QQ", raw, 16 * i) for i in range(n + 1)]

    def block(self, i: int, mark: int = 0) -> np.ndarray:
        offset, size = self.places[i]
        return decode_block(self.file.read_at(size, offset), self.table, mark)

    def directory(self):
        offset, size = self.places[-1]
        raw = zlib.decompress(self.file.read_at(size, offset))
        n = len(raw) // 17
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)

    def documents(self):
        """(doc_id, ids in file before it, number of ids, crc32 of the ids), one block in memory at a time."""
        docs, lengths, known = self.directory()
        at, block, rest = 0, 0, np.zeros(0, np.uint32)
        for doc, n, there in zip(docs.tolist(), lengths.tolist(), known.tolist(), strict=True):
            crc, left = 0, n
            while left:
                if not len(rest):
                    rest, block = self.block(block), block + 1
                crc = crc32_ids(rest[:left], crc)
                taken = min(left, len(rest))
                rest, left = rest[taken:], left - taken
            yield doc if there else None, at, n, crc
            at += n


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids): little-endian bytes of the tokenizer's width."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        encode = encoder(path, literal=False)
        last = np.array([end], encode.dtype).tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(t or "") + last for t in part.column(1).to_pylist()], pa.binary())], names=schema.names)

    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def frequencies(stored: DataFrame, path: str) -> Frequencies:
    """Counts of all ids; the driver gets one row per id of the vocabulary at most."""
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        import pyarrow as pa

        total, dtype = np.zeros(1, np.int64), encoder(path, literal=False).dtype
        for batch in batches:
            for value in batch.column(0):
                got = np.bincount(np.frombuffer(value.as_buffer(), dtype))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=schema.names)

    rows = stored.select("ids").mapInArrow(count, schema).groupBy("id").agg(F.sum("n").alias("n")).collect()
    return Frequencies({r["id"]: r["n"] for r in rows})


def write_ids(docs: DataFrame, folder: str, path: str, end: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files in ``folder``; returns (part, file, ids), one row per file.

    The table lies in ``folder``/table.rans. ``path`` is a tokenizer file, ``end`` the id after each document.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ids")
    stored = scratch.store(tokenised(docs, path, end), "tokens")
    table = frequencies(stored, path)
    write_whole(f"{folder}/table.rans", [table.to_bytes()])
    shared = spark.sparkContext.broadcast(table.to_bytes())
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("ids", T.LongType())])

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, total, dtype = TaskContext.get().partitionId(), 0, encoder(path, literal=False).dtype

        def rows():
            nonlocal total
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = ids.as_py()
                    total += len(raw) // dtype.itemsize
                    yield doc, raw

        source = rows()
        first = next(source, None)
        if first is None:
            return
        name = f"{folder}/part-{part:06d}.rans"
        write_whole(name, file_pieces((r for group in ([first], source) for r in group), dtype, Frequencies.from_bytes(shared.value)))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([total], pa.int64())], names=schema.names)

    files = stored.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id").mapInArrow(write, schema)
    out = scratch.store(files, "files")
    scratch.drop("tokens")
    return out


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from ``files`` in parallel."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    # one row per file: the window over them is bounded by the number of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))

    def read(batches):
        import pyarrow as pa

        table = None
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if table is None:
                    system, path = _open(f"{folder}/table.rans")
                    with system.open_input_file(path) as f:
                        table = Frequencies.from_bytes(f.read())
                out = [[], [], [], []]
                for doc, at, n, crc in Reader(name, table).documents():
                    for column, value in zip(out, (doc, base + at, n, crc), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=schema.names)

    n = parts(files.sparkSession)
    return placed.repartition(n, "part").select("file", "base").mapInArrow(read, schema)


def as_files(spark: SparkSession) -> tuple[Scratch, str]:
    scratch = Scratch(spark, "token-files")
    return scratch, scratch.path("files")
