"""Line dedup by probing a sharded minimal perfect hash.

Lines are told apart by 128-bit hashes of their keys. Scan tasks count each distinct
key of a document once and pass on one packed entry per key and task, dealt to shards
by hash, so a line that a third of all documents hold is one entry per task. A shard
keeps the keys found in ``min_docs`` documents or more and builds a minimal perfect
hash over their hashes: bit arrays by level, whose ranks number the keys without
gaps. Number n of a shard addresses three plain arrays: a 64-bit fingerprint, the
document count and the largest doc_id. A line that the index lacks fails the
fingerprint (a false match has odds of 2**-64 a probe).

Documents probe the arrays; lines are never joined with lines:

* The ``heavy`` keys of the most documents, whatever the corpus, form one index that goes
  to every task, and documents probe it in place. Often that is all keys.
* Otherwise probes of all other lines travel packed to their shard, which streams them
  past its arrays and answers with the lines to drop. No such key has more probes than
  total / ``heavy``, so no shard is hot.

Defined results: null and empty texts are one empty line; a row is a document, also
where it repeats a doc_id, and rows with the largest doc_id of a line all keep it; a
null doc_id is below all others; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import io
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest as digest

from tickloom.llm.common import NO_ID, Scratch, identified, parts

#: keys whose arrays are sent to every task: 20 bytes each and their bits
HEAVY = 1 << 19
#: lines a task holds before it passes them on
HELD = 1 << 18
BLANK = b" \t\n\x0b\x0c\r"
SHARDED = "shard int, digests binary, counts binary, owners binary"


def line_keys(body: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line of a text; None for one of fewer code points, which have up to four bytes."""
    keys, many = [x.strip(BLANK) for x in body.lower().split(b"\n")], 4 * min_chars  # bytes: A-Z alone are lowered
    return [key if (n := len(key)) >= many or n >= min_chars and (key.isascii() or len(key.decode()) >= min_chars) else None for key in keys]


class PerfectHash:
    """Numbers 0..n-1 of n distinct (high, low) pairs, by levels of bit arrays.

    A level sends each pair to one bit; pairs alone on their bit stay, the others go
    on to the next level. The rank of its bit is a pair's number.
    """

    GAMMA = 1.6  # bits per pair of a level

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        self.first = np.concatenate(([0], np.cumsum(sizes >> 6)))
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (high ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9) + low
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> "PerfectHash":
        words, sizes = [], []
        while len(high):
            if len(sizes) == 64:
                raise ValueError("equal pairs have no perfect hash")
            size = (int(len(high) * cls.GAMMA) // 64 + 1) * 64
            at = cls.place(high, low, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            high, low = high[~alone[at]], low[~alone[at]]
        return cls(np.concatenate([np.zeros(0, "<u8"), *words]), np.array(sizes, np.int64))

    def __call__(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Numbers of the pairs; any number or -1 for a pair that is not in the set."""
        out, todo = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.place(high[todo], low[todo], level, size)
            word, bit = self.first[level] + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class LineIndex:
    """Fingerprints, document counts and largest ids of a set of lines, addressed by a perfect hash."""

    def __init__(self, hashes: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.hashes, self.prints, self.counts, self.owners = hashes, prints, counts, owners

    @classmethod
    def build(cls, digests: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> "LineIndex":
        """From (high, low) rows, each there once."""
        high, low = digests[:, 0].copy(), digests[:, 1].copy()
        hashes = PerfectHash.build(high, low)
        order = np.empty(len(high), np.int64)
        order[hashes(high, low)] = np.arange(len(high))
        return cls(hashes, low[order], counts[order], owners[order])

    def probe(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0: not there) and largest id of each (high, low) row."""
        at = self.hashes(digests[:, 0].copy(), digests[:, 1].copy())
        found = at >= 0
        found[found] = self.prints[at[found]] == digests[found, 1]
        counts, owners = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[found], owners[found] = self.counts[at[found]], self.owners[at[found]]
        return counts, owners

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=self.hashes.words, sizes=self.hashes.sizes, prints=self.prints, counts=self.counts, owners=self.owners)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "LineIndex":
        x = np.load(io.BytesIO(raw))
        return cls(PerfectHash(x["words"], x["sizes"]), x["prints"], x["counts"], x["owners"])


def pairs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def merged(digests: np.ndarray, counts: np.ndarray, owners: np.ndarray):
    """One row per distinct digest: counts added, the largest owner."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    digests = digests[order]
    first = np.flatnonzero(np.concatenate(([True], (digests[1:] != digests[:-1]).any(axis=1)))) if len(order) else order
    return digests[first], np.add.reduceat(counts[order], first) if len(first) else counts, np.maximum.reduceat(owners[order], first) if len(first) else owners


def by_shard(digests: np.ndarray, shards: int, *arrays: np.ndarray):
    """(shard, its digests, its part of each array), shard by shard."""
    shard = (digests[:, 0] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    held, first = np.unique(shard[order], return_index=True)
    for s, a, b in zip(held.tolist(), first.tolist(), [*first.tolist()[1:], len(order)][: len(held)], strict=True):
        yield s, digests[order[a:b]], *[x[order[a:b]] for x in arrays]


def _packed(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], pa.binary()) for c in cols[1:]]], names=names)


def _count_lines(min_chars: int, shards: int):
    """Scan side: (shard, digests, counts, owners) of the lines of a task, ``HELD`` lines at a time."""

    def run(batches):
        digests, owners, sizes = [], [], []

        def flush():
            found = pairs(b"".join(digests))
            rows = merged(found, np.ones(len(found), np.int64), np.repeat(np.array(owners, np.int64), sizes))
            for held in (digests, owners, sizes):
                held.clear()
            return _packed(list(by_shard(rows[0], shards, *rows[1:])), ["shard", "digests", "counts", "owners"])

        for batch in batches:
            for d, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {*line_keys(body.as_py(), min_chars)} - {None}
                digests.extend(map(digest, own))
                owners.append(d)
                sizes.append(len(own))
                if len(digests) >= HELD:
                    yield flush()
        if digests:
            yield flush()

    return run


def _merge_shards(min_docs: int):
    """Shard side, rows sorted by shard: the keys of ``min_docs`` documents or more."""

    def run(batches):
        shard, rows, size = None, [], 0

        def one(rows):
            return merged(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]))

        def close():
            digests, counts, owners = one(rows)
            keep = counts >= min_docs
            if keep.any():
                yield _packed([(shard, digests[keep], counts[keep], owners[keep])], ["shard", "digests", "counts", "owners"])

        for batch in batches:
            for s, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != shard and rows:
                    yield from close()
                    rows, size = [], 0
                shard = s
                rows.append((pairs(row[0]), np.frombuffer(row[1], "<i8"), np.frombuffer(row[2], "<i8")))
                size += len(rows[-1][1])
                if size > 4 * HELD:  # what repeats falls together early
                    rows = [one(rows)]
                    size = min(len(rows[0][1]), 2 * HELD)
        if rows:
            yield from close()

    return run


def _document_counts(batches):
    """(n, keys): how many keys of a shard are in n documents."""
    import pyarrow as pa

    for batch in batches:
        for raw in batch.column(0):
            n, keys = np.unique(np.frombuffer(raw.as_py(), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(keys)], names=["n", "keys"])


def heavy_from(sizes: list[tuple[int, int]], heavy: int) -> int:
    """The least number of documents that ``heavy`` keys at most reach, of (n, keys in n documents)."""
    held = 0
    for n, keys in sorted(sizes, reverse=True):
        held += keys
        if held > heavy:
            return n + 1
    return 0


def _between(least: int, most: int):
    """A shard's keys with ``least`` <= count < ``most``."""

    def run(batches):
        for batch in batches:
            for s, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                digests, counts, owners = pairs(row[0]), np.frombuffer(row[1], "<i8"), np.frombuffer(row[2], "<i8")
                keep = (counts >= least) & (counts < most)
                if keep.any():
                    yield _packed([(s, digests[keep], counts[keep], owners[keep])], ["shard", "digests", "counts", "owners"])

    return run


def _indexes(batches):
    """Indexes of the keys of a shard."""
    for batch in batches:
        for s, digests, counts, owners in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield _packed([(s, index_of([(digests, counts, owners)]))], ["shard", "index"])


def index_of(rows: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """One index of the keys of all rows (digests, counts, owners)."""
    digests, counts, owners = [b"".join(x) for x in zip(*rows, strict=True)] or [b""] * 3
    return LineIndex.build(pairs(digests), np.frombuffer(counts, "<i8"), np.frombuffer(owners, "<i8")).to_bytes()


def _ask(min_chars: int, shards: int, heavy):
    """Probes of the lines that are not heavy: (shard, digests, documents), packed."""

    def run(batches):
        index, digests, docs = LineIndex.from_bytes(heavy.value), [], []

        def flush():
            asked = pairs(b"".join(digests))
            light = index.probe(asked)[0] == 0
            rows = [(s, None, mine, who) for s, mine, who in by_shard(asked[light], shards, np.array(docs, np.int64)[light])]
            digests.clear()
            docs.clear()
            if rows:
                yield _packed(rows, ["shard", "index", "digests", "docs"])

        for batch in batches:
            for d, h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for key in {*line_keys(body.as_py(), min_chars)} - {None}:
                    digests.append(digest(key))
                    docs.append((d, h))
                if len(docs) >= HELD:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def _answer(min_docs: int):
    """Shard side, its index first and then its probes: (d, h, digest) of the lines to drop."""
    import pyarrow as pa

    def run(batches):
        shard, index = None, None
        for batch in batches:
            for s, raw, digests, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != shard:
                    shard, index = s, None
                if raw is not None:
                    index = LineIndex.from_bytes(raw)
                elif index is not None:
                    asked, who = pairs(digests), np.frombuffer(docs, "<i8").reshape(-1, 2)
                    counts, owners = index.probe(asked)
                    drop = (counts >= min_docs) & (owners != who[:, 0])
                    if drop.any():
                        said = pa.Array.from_buffers(pa.binary(16), int(drop.sum()), [None, pa.py_buffer(asked[drop].tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(who[drop, 0]), pa.array(who[drop, 1]), said.cast(pa.binary())], names=["d", "h", "digest"])

    return run


def _dropped(min_chars: int, min_docs: int, heavy, with_text: bool):
    """Per document: its lines counted, those to drop taken out, the rest joined again."""

    def run(batches):
        import pyarrow as pa

        index = LineIndex.from_bytes(heavy.value)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            ids, bodies, said = batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3)
            each = [line_keys(body, min_chars) for body in bodies]
            sizes, keys = np.array([len(x) for x in each]), [key for own in each for key in own]
            row, first = np.repeat(np.arange(len(each)), sizes), np.cumsum(sizes) - sizes
            asked = np.flatnonzero([key is not None for key in keys])
            digests = [digest(key) for key in keys if key is not None]
            counts, owners = index.probe(pairs(b"".join(digests)))
            gone = np.zeros(len(keys), bool)
            gone[asked] = (counts >= min_docs) & (owners != ids[row[asked]])
            if said.null_count < len(said):  # the answers of the shards
                told = [set(x or ()) for x in said.to_pylist()]
                gone[asked] |= np.array([x in told[i] for x, i in zip(digests, row[asked].tolist(), strict=True)], bool)
            out = np.add.reduceat(gone, first, dtype=np.int64)
            kept = [b"\n".join(compress(body.split(b"\n"), ~gone[a : a + size])) if n else body for body, a, size, n in zip(bodies, first.tolist(), sizes.tolist(), out.tolist(), strict=True)]
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(out), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x.decode() for x in kept]))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, heavy: int = HEAVY, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, text]) per row of ``docs`` (doc_id, text).

    Lines whose key (stripped of ASCII white space, A-Z lowered) has ``min_chars`` code
    points and is found in ``min_docs`` documents stay in the largest doc_id only.
    """
    spark = docs.sparkSession
    scratch, shards = Scratch(spark, "lines"), 4 * parts(spark)
    rows = identified(docs)
    counted = rows.select("d", "body").mapInArrow(_count_lines(min_chars, shards), SHARDED)
    dealt = counted.repartition("shard").sortWithinPartitions("shard")
    keys = scratch.store(dealt.mapInArrow(_merge_shards(min_docs), SHARDED), "keys")

    # counts that add up to the probes of all keys: few different ones
    sizes = [tuple(r) for r in keys.select("counts").mapInArrow(_document_counts, "n long, keys long").groupBy("n").agg(F.sum("keys")).collect()]
    cut = max(min_docs, heavy_from(sizes, heavy))
    sent = spark.sparkContext.broadcast(index_of([tuple(map(bytes, r)) for r in keys.mapInArrow(_between(cut, 1 << 62), SHARDED).select("digests", "counts", "owners").collect()]))
    if any(n < cut for n, _ in sizes):
        light = scratch.store(keys.mapInArrow(_between(min_docs, cut), SHARDED).mapInArrow(_indexes, "shard int, index binary"), "light")
        asked = rows.select("d", "h", "body").mapInArrow(_ask(min_chars, shards, sent), "shard int, index binary, digests binary, docs binary")
        both = light.select("shard", "index", F.lit(None).cast("binary").alias("digests"), F.lit(None).cast("binary").alias("docs")).unionAll(asked)
        met = both.repartition("shard").sortWithinPartitions("shard", F.col("index").isNull())
        answers = met.mapInArrow(_answer(min_docs), "d long, h long, digest binary").groupBy("d", "h").agg(F.collect_set("digest").alias("said"))
        rows = rows.join(scratch.store(answers, "answers"), ["d", "h"], "left")
    else:
        rows = rows.withColumn("said", F.lit(None).cast("array<binary>"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    return rows.select("doc_id", "d", "body", "said").mapInArrow(_dropped(min_chars, min_docs, sent, with_text), schema)


#: DuckDB's form with the default parameters
LINES_SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
    SELECT key, max(doc_id) AS owner FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5
), m AS (
    SELECT k.*, g.owner IS NOT NULL AND g.owner <> k.doc_id AS gone FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
