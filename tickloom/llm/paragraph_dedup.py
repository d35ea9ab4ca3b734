"""Repeated paragraphs by MinHash banding, and repeated passages inside longer paragraphs.

A paragraph is a line of at least ``min_words`` words, by default as many as a
shingle has. Lines up to a blank line that look wrapped (none over ``WRAP``
characters, each but the last with the next word filling three quarters of the
longest at least) are also one paragraph together. Equal paragraphs (by their
word sequence) are one unit; units are banded by MinHash over word shingles with
the fewest bands that miss a pair at the threshold with probability ``miss`` at
most; units that share a band are compared by the exact Jaccard similarity of
their full shingle sets, and components of similar units are removed together, all
but the first occurrence of each component.

A passage set into different paragraphs leaves them dissimilar. So every text is
also cut into overlapping pieces of ``piece`` words whose starts are chosen by
content: the start with the least shingle hash among any ``piece`` neighbours. Any
run of 2 * piece - 1 words that two texts share holds a common piece (51 words by
default). Equal pieces are matched by a 128-bit hash; overlapping matched pieces
of a text are reported as one passage.

Defined results: null, empty and short texts have no paragraphs; words are cut at
white space and compared with A-Z lowered; repeats within a document count; rows
that repeat a document are copies of it; a null doc_id sorts before all others;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import NO_ID, Scratch, identified, only, parts
from tickloom.llm.near import batches_of, link_all
from tickloom.llm.suffix_dedup import sliding
from tickloom.llm.text import MinHash, binary, mix, powers, shingle_hashes, word_hashes

SHINGLE, PERCENT, MIN_WORDS, PIECE, ROWS, MISS, WRAP = 5, 80, 5, 26, 3, 1e-3, 200


def tune(threshold: float, miss: float = MISS, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` minima that miss a pair at the threshold with this probability at most."""
    return max(1, ceil(log(miss) / log(1 - threshold**rows))) if threshold < 1 else 1


def paragraphs(data: bytes, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and word past the end of the paragraphs, the first word of the wrapped one around each, and whether it is that."""
    if not len(words):
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    raw = np.frombuffer(data, np.uint8)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    end = np.concatenate((first[1:], [len(words)]))
    top, low, high = wrapped(raw, line[first], first, end, starts, ends)
    out = np.concatenate((first, low)), np.concatenate((end, high)), np.concatenate((top, low)), np.arange(len(first) + len(low)) >= len(first)
    long = out[1] - out[0] >= min_words
    return tuple(x[long] for x in out)


def wrapped(raw: np.ndarray, line: np.ndarray, first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of what each line belongs to, and first word and word past the end of the wrapped paragraphs."""
    new = np.concatenate(([True], np.diff(line) > 1))
    if new.all():
        return first, *[np.zeros(0, np.int64)] * 2
    inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that do not begin a character
    width = lambda a, b: b - a - (np.searchsorted(inner, b) - np.searchsorted(inner, a))
    long, head = width(starts[first], ends[end - 1]), width(starts[first], ends[first])
    heads, block = np.flatnonzero(new), np.cumsum(new) - 1
    longest = np.maximum.reduceat(long, heads)
    full = np.concatenate((4 * (long[:-1] + 1 + head[1:]) > 3 * longest[block[:-1]], [True])) | np.concatenate((new[1:], [True]))
    lines = np.diff(np.concatenate((heads, [len(first)])))
    good = np.logical_and.reduceat(full, heads) & (longest <= WRAP) & (lines > 1)
    low, high = first[heads], end[heads + lines - 1]
    return np.where(good[block], low[block], first), low[good], high[good]


def pieces(words: np.ndarray, piece: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of the chosen pieces and two 64-bit hashes of each; ``value`` ranks the starts."""
    n = len(words) - piece + 1
    if n < 1:
        return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2
    value = value[:n]
    width = min(piece, n)
    least = sliding(value, width, True)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(value == sliding(np.concatenate((edge, least, edge)), width, False))
    up, down = powers(len(words) + 1)
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + np.uint64(salt)) * up[: len(words)], out=sums[1:])
        out.append(mix((sums[chosen + piece] - sums[chosen]) * down[chosen]))
    return chosen, *out


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of every signature; the band's number is hashed in."""
    minima = sigs.astype(np.uint64).reshape(len(sigs), -1, rows)
    key = np.broadcast_to(np.arange(minima.shape[1], dtype=np.uint64), minima.shape[:2])
    for i in range(rows):
        key = mix((key << np.uint64(7)) + key + minima[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def _cut(keyed: DataFrame, shingle: int, min_words: int, bands: int, rows: int, piece: int) -> DataFrame:
    """Paragraphs (digest, top, lines, keys) and pieces (k1, k2) of every text, with d, h, start, end.

    Words are hashed once for both. ``lines`` marks wrapped paragraphs, ``top`` is the start of the one
    around a line. The band keys come only with a digest's first paragraph in a task.
    """
    numbers = [T.StructField(n, T.LongType()) for n in ("d", "h")] + [T.StructField(n, T.IntegerType()) for n in ("start", "end")]
    schema = T.StructType([*numbers, T.StructField("digest", T.BinaryType()), T.StructField("top", T.IntegerType()), T.StructField("lines", T.BooleanType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        minhash, sent = MinHash(bands * rows), set()

        def batch_of(**columns):
            n = len(columns["d"])
            return pa.RecordBatch.from_arrays([pa.array(columns[name], t) if name in columns else pa.nulls(n, t) for name, t in zip(schema.names, kinds, strict=True)], names=schema.names)

        for batch in batches:
            bodies, lines, inner = binary(batch.column(2)), {n: [] for n in ("d", "h", "start", "end", "digest", "top", "lines", "keys")}, []
            for i, (d, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = bodies[i].as_py()
                words, starts, ends = word_hashes(data)
                hashes = shingle_hashes(words, shingle)
                chosen, one, two = pieces(words, piece, hashes if shingle <= piece else shingle_hashes(words, piece))
                if len(chosen):
                    inner.append((np.full(len(chosen), d), np.full(len(chosen), h), starts[chosen].astype(np.int32), ends[chosen + piece - 1].astype(np.int32), one.view(np.int64), two.view(np.int64)))
                first, end, top, joined = paragraphs(data, words, starts, ends, min_words)
                if not len(first):
                    continue
                digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                new, keys = [], [None] * len(digests)
                for j, digest in enumerate(digests):
                    if digest not in sent:
                        sent.add(digest)
                        new.append(j)
                by_run = [j for j in new if end[j] - first[j] >= shingle]
                if by_run:
                    for j, key in zip(by_run, band_keys(minhash.runs(hashes, first[by_run], end[by_run] - shingle + 1), rows), strict=True):
                        keys[j] = key
                for j in set(new) - set(by_run):
                    keys[j] = band_keys(minhash(shingle_hashes(words[first[j] : end[j]], shingle))[None, :], rows)[0]
                for column, values in zip(lines.values(), ([d] * len(first), [h] * len(first), starts[first].tolist(), ends[end - 1].tolist(), digests, starts[top].tolist(), joined.tolist(), keys), strict=True):
                    column.extend(values)
            if len(sent) > 200_000:
                sent.clear()
            if lines["d"]:
                yield batch_of(**lines)
            if inner:
                yield batch_of(**dict(zip(("d", "h", "start", "end", "k1", "k2"), map(np.concatenate, zip(*inner, strict=True)), strict=True)))

    return keyed.select("d", "h", "body").mapInArrow(run, schema)


def _sets(keyed: DataFrame, wanted: DataFrame, shingle: int, size: int) -> DataFrame:
    """(id, sig, hashes): signatures and shingle sets of the wanted units (id, d, h, start, end), read from their texts."""
    schema = T.StructType([T.StructField(n, T.BinaryType()) for n in ("id", "sig", "hashes")])

    def run(batches):
        import pyarrow as pa

        minhash = MinHash(size)
        for batch in batches:
            bodies = binary(batch.column(0))
            for i in range(batch.num_rows):
                body, out = bodies[i].as_py(), ([], [], [])
                for r in batch.column(1)[i].as_py():
                    hashes = np.unique(shingle_hashes(word_hashes(body[r["start"] : r["end"]])[0], shingle))
                    for column, value in zip(out, (r["id"], minhash(hashes).tobytes(), hashes.tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=schema.names)

    by_doc = wanted.groupBy("d", "h").agg(F.collect_list(F.struct("id", "start", "end")).alias("units"))
    return keyed.join(by_doc, ["d", "h"]).select("body", "units").mapInArrow(run, schema).dropDuplicates(["id"])


def spans(d: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(d, h, start, end, owner, removed) of the passages that pieces sorted by (d, h) form."""
    doc = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))))
    by = np.lexsort((start, k2, k1, doc))
    again = np.zeros(len(d), bool)
    again[by[1:]] = (doc[by[1:]] == doc[by[:-1]]) & (k1[by[1:]] == k1[by[:-1]]) & (k2[by[1:]] == k2[by[:-1]])
    removed = (owner != d) | again
    by = np.lexsort((start, removed, doc))
    # every (document, verdict) has its own stretch of numbers, so that one running maximum serves all
    shift = (doc[by] * 2 + removed[by]) << 32
    reach = np.maximum.accumulate(end[by] + shift)
    at = np.flatnonzero(np.concatenate(([True], start[by][1:] + shift[1:] > reach[:-1])))
    head = by[at]
    return d[head], h[head], start[head].astype(np.int32), np.maximum.reduceat(end[by], at).astype(np.int32), np.minimum.reduceat(owner[by], at), removed[head]


def _passages(matched: DataFrame) -> DataFrame:
    """Overlapping pieces of a document with the same verdict, as one passage each.

    A piece stays in its owner, the document with the smallest id, where it comes first.
    Documents arrive whole and one after the other; pieces of rows that repeat one are taken once.
    """
    schema = T.StructType([T.StructField("d", T.LongType()), T.StructField("h", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cluster_id", T.LongType()), T.StructField("removed", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        def found(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(spans(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], names=schema.names)

        held = np.zeros((7, 0), np.int64)
        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])), axis=1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]
            last = int(np.flatnonzero((rows[:2] == rows[:2, -1:]).all(axis=0))[0])
            if last:
                yield found(rows[:, :last])
            held = rows[:, last:]
        if held.shape[1]:
            yield found(held)

    dealt = matched.select("d", "h", "start", "end", "owner", "k1", "k2").repartition(parts(matched.sparkSession), "d", "h")
    return dealt.sortWithinPartitions("d", "h", "start").mapInArrow(run, schema)


def _members(scratch: Scratch, keyed: DataFrame) -> DataFrame:
    """(key, id, n): the buckets of two or more units, from (id, key) rows that may repeat.

    Two units in a bucket show by two hashes of ids, so that the sums over all keys hold numbers only.
    """
    name = F.xxhash64("id")
    shared = keyed.groupBy("key").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("key")
    # stored, so that a large bucket is one skewed side of a plain join
    inside = scratch.store(keyed.join(scratch.store(shared, "shared"), "key").distinct(), "inside")
    sizes = scratch.store(inside.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    return scratch.store(inside.join(sizes, "key"), "members")


def repeated_paragraphs(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, min_words: int = MIN_WORDS, piece: int = PIECE, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, start, end, kind, cluster_id, removed): one row per occurrence of a repeated paragraph or passage.

    ``start`` and ``end`` are bytes of the text; ``cluster_id`` is the doc_id of the
    first occurrence; ``removed`` is false for that occurrence alone (rows that repeat a document share it). Documents
    without repeats have no row.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    keyed, bands = identified(only(docs, "doc_id", "text")), tune(percent / 100, miss, rows)
    cut = scratch.store(_cut(keyed, shingle, min_words, bands, rows, piece), "cut")
    lines, inner = cut.where("digest is not null"), cut.where("k1 is not null")
    inside = _members(scratch, lines.where("keys is not null").select(F.col("digest").alias("id"), F.explode("keys").alias("key")))
    # numbers only, for all units; places follow for those that repeat or share a bucket
    around = F.xxhash64("d", "h", "top")
    counts = lines.groupBy("digest").agg(*[F.count_if(F.col("lines") == x).alias(n) for n, x in (("single", False), ("joined", True))], F.min(around).alias("low"), F.max(around).alias("high"))
    banded = inside.select(F.col("id").alias("digest")).distinct().withColumn("banded", F.lit(True))
    units = counts.join(banded, "digest", "left").where("single > 1 or joined > 1 or low <> high or banded")
    units = scratch.store(units, "units")
    places = scratch.store(lines.select("digest", "d", "h", "start", "end").join(units.select("digest"), "digest"), "places")
    first = places.groupBy("digest").agg(F.min(F.struct("d", "h", "start", "end")).alias("at"))
    units = scratch.store(units.join(first, "digest").withColumnRenamed("digest", "id"), "first_places")
    wanted = units.where("banded").select("id", "at.*")
    full = scratch.store(_sets(keyed, wanted, shingle, bands * rows), "full")
    nodes = link_all(scratch, inside, full, batches_of(bands * rows, bands * rows, percent / 100, 1e-6), percent)
    placed = units.join(nodes, units.id == nodes.node, "left").select("id", "single", "joined", "low", "high", "at", F.coalesce("component", "id").alias("c"), F.col("component").isNotNull().alias("linked"))
    placed = scratch.store(placed.where("single > 1 or joined > 1 or low <> high or linked"), "placed")
    # a wrapped paragraph that is like its own first line repeats nothing
    heads = placed.groupBy("c").agg(F.min("at").alias("head"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("single").alias("single"), F.sum("joined").alias("joined"))
    heads = heads.where("single > 1 or joined > 1 or low <> high").select("c", "head")
    clustered = scratch.store(placed.join(heads, "c").select(F.col("id").alias("digest"), "head"), "clusters")
    same = lambda head: (F.col("d") == F.col(f"{head}.d")) & (F.col("h") == F.col(f"{head}.h")) & (F.col("start") == F.col(f"{head}.start"))
    whole = places.join(clustered, "digest")
    whole = whole.select("d", "h", "start", "end", F.col("head.d").alias("cluster_id"), (~same("head")).alias("removed"), F.lit("paragraph").alias("kind"))
    # stored, so that a very common piece is one skewed side of a plain join
    twice = scratch.store(inner.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("d").alias("owner")).where("n > 1").select("k1", "k2", "owner"), "twice")
    matched = inner.select("k1", "k2", "d", "h", "start", "end").join(twice, ["k1", "k2"])
    passages = _passages(matched).withColumn("kind", F.lit("passage"))
    found = whole.unionByName(passages)
    out = scratch.store(found.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "start", "end", "kind", F.when(F.col("cluster_id") != NO_ID, F.col("cluster_id")).alias("cluster_id"), "removed"), "answer")
    scratch.drop(*[name for name in scratch.held if name != "answer"])
    return out
