"""Alignment of two tokenizers over the same texts.

Both tokenizers' tokens cut the bytes of space + text. Where a token of each ends at
the same byte, both lists are cut; the pieces between are groups, and all tokens of a
group are linked with each other. The common ends are found by galloping: the shorter
list drives, block by block, an exponential step forward in the longer one brackets
the block, and binary search within the bracket places its ends. The ranks of common
ends in both lists slice the groups; differences of ranks are the tokens a group has.

A document stores its distinct linked id pairs with their links, packed. Corpus-wide
counts (documents that hold a pair) are added per task first and dealt by pair to
shards. What a document gets back is a sum over its pairs, so no pair is joined:

* Pairs of at least total / ``heavy`` documents number ``heavy`` at most, whatever the
  corpus; their counts go to every task, with the highest count of each A id (bounded
  by the vocabulary), and documents add them in place.
* Other pairs travel packed to their shard, which adds up per document what it knows;
  a document's sums are added at the end. None of these pairs is in more documents
  than total / ``heavy``, so no shard is hot.

Token ids are the libraries' own; those of the byte-level file are remembered by piece
of text, as in ``tokens``.

Defined results: texts that are null, empty, or not given back byte by byte by either
tokenizer (such as those with U+2581) have no tokens, zeros and an empty digest; a row is a
document, also where it repeats a doc_id; a null doc_id stays null; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, only, parts
from tickloom.llm.tokens import _byte_letters, encoder

#: pairs whose counts are sent to every task: 16 bytes each
HEAVY = 1 << 19
#: pairs a task holds before it adds them up or passes them on
HELD = 1 << 20
#: ends of the shorter list that are placed at once
GALLOP = 1024
#: links of a group that are listed one by one; larger groups go by their distinct ids
LISTED = 1 << 16
PACKED = "shard int, pairs binary, counts binary"


def gallop(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in two ascending lists of the values that both hold."""
    if len(a) > len(b):
        ib, ia = gallop(b, a)
        return ia, ib
    left, right, at = [], [], 0
    for start in range(0, len(a), GALLOP):
        block = a[start : start + GALLOP]
        step = len(block)
        low, high = at, min(at + step, len(b))
        while high < len(b) and b[high - 1] < block[-1]:  # exponential: the bracket's end passes the block's
            low, step = high if b[high - 1] < block[0] else low, step * 2
            high = min(at + step, len(b))
        place = low + np.searchsorted(b[low:high], block)  # binary, within the bracket
        hit = place < high
        hit[hit] = b[place[hit]] == block[hit]
        left.append(start + np.flatnonzero(hit))
        right.append(place[hit])
        at = int(place[-1])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


class Pieces:
    """Ids of a text by the sentencepiece file, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def __call__(self, text: str) -> list[int]:
        return self.lib.encode(text)


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a = encoder(path_a)
        letters = {ord(c): b for b, c in _byte_letters().items()}
        size = self.a.lib.get_vocab_size()
        self.bytes_a = [self.a.lib.id_to_token(i).translate(letters).encode("latin-1") for i in range(size)]
        self.b = Pieces(path_b)
        if max(size, len(self.b.bytes)) > 1 << 16:
            raise ValueError("ids of both files must be below 65536: a pair is one 32-bit number")
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.b.bytes))
        #: at 3 * id + sign: the id's decimal digits and the sign behind it
        self.said = [f"{i}{sign}".encode() for i in range(max(size, len(self.b.bytes))) for sign in ",|;"]

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text or "▁" in text:
            return None
        whole = " " + text
        a = np.frombuffer(self.a(whole), self.a.dtype).astype(np.int64)
        b = self.b(text)
        raw = whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        return a, np.array(b, np.int64)

    def __call__(self, text: str | None):
        """(tokens of A, of B, groups, links, text of the groups, distinct pairs, links of each pair)."""
        both = self.ids(text)
        if both is None:
            return 0, 0, 0, 0, None, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        a, b = both
        ia, ib = gallop(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        first_a, first_b = np.concatenate(([0], ia[:-1] + 1)), np.concatenate(([0], ib[:-1] + 1))
        many_a, many_b = ia + 1 - first_a, ib + 1 - first_b
        pairs, times = self.linked(a, b, first_a, first_b, many_a, many_b)
        return len(a), len(b), len(ia), int((many_a * many_b).sum()), self.text(a, b, ia, ib, many_a, many_b), pairs, times

    def linked(self, a, b, first_a, first_b, many_a, many_b):
        """Distinct pairs and their links, ``HELD`` links at a time."""
        links = many_a * many_b
        large = links > LISTED
        listed = np.flatnonzero(~large)
        cuts = np.searchsorted(np.cumsum(links[listed]), np.arange(HELD, int(links[listed].sum()), HELD))
        found, counts = [], []
        for part in np.split(listed, cuts):
            n, m = many_a[part], many_b[part]
            rows = np.repeat(first_a[part], n) + _ranks(n)  # every A token of a group, each m times
            m_of, b_of = np.repeat(m, n), np.repeat(first_b[part], n)
            pairs, times = np.unique(np.repeat(a[rows], m_of) << 16 | b[np.repeat(b_of, m_of) + _ranks(m_of)], return_counts=True)
            found.append(pairs)
            counts.append(times)
        for g in np.flatnonzero(large).tolist():
            x, x_times = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            y, y_times = np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            found.append((x[:, None] << 16 | y[None, :]).ravel())
            counts.append(np.outer(x_times, y_times).ravel())
        pairs, times = (found[0], counts[0]) if len(found) == 1 else _added(found, counts)
        return pairs.astype(np.uint32), times.astype(np.int64)

    def text(self, a, b, ia, ib, many_a, many_b) -> bytes:
        said = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.repeat(np.concatenate(([0], ib[:-1] + 1)), many_a)
        at_b = np.arange(len(b)) + np.repeat(ia + 1, many_b)
        said[at_a], said[at_b] = 3 * a, 3 * b
        said[at_a[ia]] += 1
        said[at_b[ib]] += 2
        return b"".join(map(self.said.__getitem__, said.tolist()))[:-1]


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two files; it lives as long as the worker does."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _align(path_a: str, path_b: str, groups: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        align, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n_a, n_b, n_groups, n_links, said, pairs, times = align(text.as_py())
                rows.append((row, doc_id, n_a, n_b, n_groups, n_links, "" if said is None else hashlib.sha256(said).hexdigest(), pairs.tobytes(), times.astype("<u4").tobytes(), *([(said or b"").decode()] if groups else [])))
                row += 1
            cols = list(zip(*rows, strict=True))
            types = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), *[pa.string()] * groups]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *["groups"] * groups]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def by_shard(pairs: np.ndarray, shards: int, *arrays: np.ndarray):
    """(shard, its pairs, its part of each array), shard by shard."""
    shard = shard_of(pairs, shards)
    order = np.argsort(shard, kind="stable")
    held, first = np.unique(shard[order], return_index=True)
    for s, a, b in zip(held.tolist(), first.tolist(), [*first.tolist()[1:], len(order)][: len(held)], strict=True):
        yield s, pairs[order[a:b]], *[x[order[a:b]] for x in arrays]


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(np.concatenate(pairs), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, back, np.concatenate(counts))
    return found, out


def _packed(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], pa.binary()) for c in cols[1:]]], names=names)


def _count(shards: int):
    """Task side: documents per pair, added up before they are dealt."""

    def run(batches):
        pairs, counts, size = [], [], 0
        for batch in batches:
            for raw in batch.column(0):
                pairs.append(np.frombuffer(raw.as_py(), "<u4"))
                counts.append(np.ones(len(pairs[-1]), np.int64))
                size += len(pairs[-1])
                if size > HELD:
                    pairs, counts = ([x] for x in _added(pairs, counts))
                    size = len(pairs[0])
                    if size > HELD // 2:
                        yield _packed(list(by_shard(pairs[0], shards, counts[0])), ["shard", "pairs", "counts"])
                        pairs, counts, size = [], [], 0
        if size:
            found, docs = _added(pairs, counts)
            yield _packed(list(by_shard(found, shards, docs)), ["shard", "pairs", "counts"])

    return run


def _sum(batches):
    """Shard side, rows sorted by shard: one row per shard, its pairs ascending."""
    shard, pairs, counts, size = None, [], [], 0
    for batch in batches:
        for s, p, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if s != shard and pairs:
                yield _packed([(shard, *_added(pairs, counts))], ["shard", "pairs", "counts"])
                pairs, counts, size = [], [], 0
            shard = s
            pairs.append(np.frombuffer(p, "<u4"))
            counts.append(np.frombuffer(c, "<i8"))
            size += len(pairs[-1])
            if size > 2 * HELD:
                pairs, counts = ([x] for x in _added(pairs, counts))
                size = min(len(pairs[0]), HELD)
    if pairs:
        yield _packed([(shard, *_added(pairs, counts))], ["shard", "pairs", "counts"])


def _highest(batches):
    """(a, most, total): per shard the highest count of each A id; the shard's total stands by a = -1."""
    import pyarrow as pa

    for batch in batches:
        for p, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pairs, counts = np.frombuffer(p, "<u4"), np.frombuffer(c, "<i8")
            ids, first = np.unique(pairs >> 16, return_index=True)
            most = np.maximum.reduceat(counts, first)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *ids.tolist()], pa.int64()), pa.array([int(counts.sum()), *most.tolist()], pa.int64()), pa.array([int(counts.min()), *[1 << 62] * len(ids)], pa.int64())], names=["a", "most", "least"])


def _only(cut: int, heavy: bool):
    """Per shard: its pairs of ``cut`` documents or more, or the others."""

    def run(batches):
        for batch in batches:
            for s, p, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                pairs, counts = np.frombuffer(p, "<u4"), np.frombuffer(c, "<i8")
                keep = (counts >= cut) == heavy
                if keep.any():
                    yield _packed([(s, pairs[keep], counts[keep])], ["shard", "pairs", "counts"])

    return run


class Known:
    """Counts of some pairs, and the highest count of each A id."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, most: np.ndarray):
        self.pairs, self.counts, self.most = pairs, counts, most

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which are known, their counts, whether that is the highest of the A id); 0 and False for the others."""
        at = np.searchsorted(self.pairs, pairs)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == pairs[known]
        counts = np.zeros(len(pairs), np.int64)
        counts[known] = self.counts[at[known]]
        return known, counts, known & (counts == self.most[pairs >> 16])


def _in_place(sent, shards: int):
    """What heavy pairs add to a document, and its other pairs packed by shard: (row, sums, shard, pairs, ...)."""

    def run(batches):
        import pyarrow as pa

        index = Known(*sent.value)
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            rows = batch.column(0).to_pylist()
            pairs = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)]
            times = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column(2)]
            best, total, other = [0] * len(rows), [0] * len(rows), []
            for i, (p, t) in enumerate(zip(pairs, times, strict=True)):
                known, counts, highest = index.find(p)
                best[i], total[i] = int(t[highest].sum()), int((t * counts).sum())
                if not known.all():
                    other.append((p[~known], t[~known].astype("<u4"), np.full(int((~known).sum()), rows[i], np.int64)))
            yield _mixed(rows, best, total, [])
            if other:
                p, t, r = (np.concatenate(x) for x in zip(*other, strict=True))
                yield _mixed([], [], [], list(by_shard(p, shards, t, r)))

    def _mixed(rows, best, total, packed):
        import pyarrow as pa

        n, m = len(rows), len(packed)
        cols = [pa.array(x + [None] * m, pa.int64()) for x in (rows, best, total)]
        cols += [pa.array([None] * n + [x[0] for x in packed], pa.int32()), *[pa.array([None] * n + [x[k].tobytes() for x in packed], pa.binary()) for k in (1, 2, 3)]]
        return pa.RecordBatch.from_arrays(cols, names=["row", "n_best", "count_sum", "shard", "pairs", "times", "rows"])

    return run


def _shard_sums(sent):
    """Shard side, the shard's counts first and then what asks for them: (row, n_best, count_sum), a row per document and packet."""

    def run(batches):
        import pyarrow as pa

        most = sent.value[2]
        shard, index = None, None
        for batch in batches:
            for s, counts, pairs, times, rows in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                p = np.frombuffer(pairs, "<u4")
                if counts is not None:
                    shard, index = s, Known(p, np.frombuffer(counts, "<i8"), most)
                    continue
                if shard != s:
                    raise ValueError("a pair without a count")
                known, n, highest = index.find(p)
                if not known.all():
                    raise ValueError("a pair without a count")
                t, of = np.frombuffer(times, "<u4").astype(np.int64), np.frombuffer(rows, "<i8")
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array(np.add.reduceat(t * highest, first)), pa.array(np.add.reduceat(t * n, first))], names=["row", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "align"), parts(spark)
    shards = 4 * n
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = scratch.store(texts.mapInArrow(_align(path_a, path_b, groups), ROWS + ", groups string" * groups), "rows")
    counted = rows.select("pairs").mapInArrow(_count(shards), PACKED).repartition(n, "shard").sortWithinPartitions("shard")
    counts = scratch.store(counted.mapInArrow(_sum, PACKED), "counts")
    # one row per A id of the vocabulary, and one total
    tops = {r["a"]: r for r in counts.mapInArrow(_highest, "a long, most long, least long").groupBy("a").agg(F.max("most").alias("most"), F.sum("most").alias("total"), F.min("least").alias("least")).collect()}
    whole = tops.pop(-1, None)
    most = np.zeros(1 << 16, np.int64)
    for a, r in tops.items():
        most[a] = r["most"]
    cut = max(1, -(-whole["total"] // heavy)) if whole else 1
    # at most ``heavy`` pairs are in ``cut`` documents or more, since their counts add up to the total
    sent_rows = counts.mapInArrow(_only(cut, True), PACKED).collect()
    pairs = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(r["pairs"], "<u4") for r in sent_rows]])
    order = np.argsort(pairs)
    sent = spark.sparkContext.broadcast((pairs[order], np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["counts"], "<i8") for r in sent_rows]])[order], most))
    sums = rows.select("row", "pairs", "times").mapInArrow(_in_place(sent, shards), "row long, n_best long, count_sum long, shard int, pairs binary, times binary, rows binary")
    if whole and whole["least"] < cut:
        sums = scratch.store(sums, "sums")
        none = F.lit(None).cast("binary")
        light = counts.mapInArrow(_only(cut, False), PACKED).select("shard", "counts", "pairs", none.alias("times"), none.alias("rows"))
        asked = sums.where("shard is not null").select("shard", none.alias("counts"), "pairs", "times", "rows")
        met = light.unionAll(asked).repartition(n, "shard").sortWithinPartitions("shard", F.col("counts").isNull())
        there = met.mapInArrow(_shard_sums(sent), "row long, n_best long, count_sum long")
        sums = sums.where("row is not null").select("row", "n_best", "count_sum").unionAll(there)
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums.select("row", "n_best", "count_sum"), "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups)
