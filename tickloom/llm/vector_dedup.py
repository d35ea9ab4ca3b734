"""Near-duplicate vectors with an inverted multi-index.

Each half of a unit vector is quantised by its own codebook; the two codes name a
cell of a product grid. Every vector is stored in its own cell and visits the
cells nearest to it in the order of the multi-sequence traversal (by the sum of
the two half distances). How many it visits is set before: vectors of the sample
are given neighbours at exactly the threshold, and the depth is the least at which
the wanted share of these pairs is met from either side. Met pairs are compared in
double precision; nothing below the threshold is linked.

Identical vectors are one class first. A cell's members and visitors are packed
into blocks of about ``BLOCK`` vectors by a hash of their ids, and blocks meet
pairwise, so a hot cell is many tasks. A block pair passes on one row per linked
vector (its number of links and the smallest id it hangs together with there),
not the pairs.

Only the codebooks are fitted on a sample (``SAMPLE`` classes at most, by hash of
id); every vector is indexed.

Defined results: a vector that is null, empty, zero, or holds a null or a value
that is not finite links with nothing, as does one whose length is not the most
frequent (the greater of equals); rows that repeat a vec_id are linked copies of
that vector and counted as such; a null vec_id never owns a component unless
alone; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, components, only, parts

CODES, SAMPLE, BLOCK, RECALL = 64, 20_000, 1024, 0.99


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, digest, raw, dims): raw doubles; digest, raw and dims are null for vectors that link with nothing."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("raw", T.BinaryType()), T.StructField("dims", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            digests, raws, dims = [], [], []
            for value in batch.column(1):
                items = value.values if value.is_valid else None
                raw = None
                if items is not None and len(items) and not items.null_count:
                    x = items.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # no negative zero
                    raw = x.tobytes() if np.isfinite(x).all() and x.any() else None
                raws.append(raw)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if raw else None)
                dims.append(len(raw) // 8 if raw else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], names=schema.names)

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, schema)


def unit(raw: bytes, n: int) -> np.ndarray:
    """n vectors of doubles, scaled to length one."""
    x = np.frombuffer(raw, "<f8").reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class MultiIndex:
    """Two codebooks and the depth of the traversal."""

    def __init__(self, sample: np.ndarray, threshold: float, recall: float = RECALL, codes: int = CODES):
        draw = np.random.default_rng(7)
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [self._fit(sample[:, : self.cut], codes, draw), self._fit(sample[:, self.cut :], codes, draw)]
        x = sample[:2000]
        side = draw.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * side
        ranks = np.sort(np.minimum(self._rank(x, y), self._rank(y, x)))
        cells = len(self.books[0]) * len(self.books[1])
        self.depth = int(min(cells, ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])) if len(ranks) else 1

    @staticmethod
    def _fit(x: np.ndarray, codes: int, draw) -> np.ndarray:
        if not x.shape[1]:
            return np.zeros((1, 0))
        book = np.unique(x[draw.permutation(len(x))[: min(codes, len(x))]], axis=0)
        for _ in range(12):
            code = MultiIndex._far(x, book).argmin(axis=1)
            count = np.bincount(code, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, code, x)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
        return book

    @staticmethod
    def _far(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)

    def _halves(self, x: np.ndarray):
        return self._far(x[:, : self.cut], self.books[0]), self._far(x[:, self.cut :], self.books[1])

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of y's cell in x's traversal, from 1."""
        out = np.empty(len(x), np.int64)
        for s in (slice(i, i + 200) for i in range(0, len(x), 200)):
            a, b = self._halves(x[s])
            i, j = (d.argmin(axis=1) for d in self._halves(y[s]))
            at = np.arange(len(a))
            out[s] = ((a[:, :, None] + b[:, None, :]) < (a[at, i] + b[at, j])[:, None, None]).reshape(len(a), -1).sum(axis=1) + 1
        return out

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The first ``depth`` cells of the traversal, nearest first; the first is the vector's own.

        A cell at ranks (i, j) of the halves comes after (i+1)(j+1)-1 others at least,
        so only ranks whose product is within the depth need be weighed.
        """
        a, b = self._halves(x)
        first, second = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        pairs = np.array([(i, j) for i in range(min(self.depth, a.shape[1])) for j in range(min(self.depth // (i + 1), b.shape[1]))])
        cells_a, cells_b = first[:, pairs[:, 0]], second[:, pairs[:, 1]]
        weight = np.take_along_axis(a, cells_a, 1) + np.take_along_axis(b, cells_b, 1)
        order = np.argsort(weight, axis=1, kind="stable")[:, : self.depth]
        return np.take_along_axis(cells_a * b.shape[1] + cells_b, order, 1).astype(np.int32)


def _entries(classes: DataFrame, index) -> DataFrame:
    """Rows (cell, visitor, id, copies, raw, note): a member notes the cells it visits, a visitor its own cell."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("visitor", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("raw", T.BinaryType()), T.StructField("note", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                ids, copies, raws = (c.to_pylist() for c in batch.slice(first, 512).columns)
                visits = index.value.visits(unit(b"".join(raws), len(raws)))
                rows = []
                for v, i, c, raw in zip(visits, ids, copies, raws, strict=True):
                    own = v[:1].tobytes()
                    rows.append((int(v[0]), False, i, c, raw, v.tobytes()))
                    rows.extend((cell, True, i, c, raw, own) for cell in v.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=schema.names)

    return classes.select("id", "copies", "raw").mapInArrow(run, schema)


def _blocks(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, visitor, salt, salts, ids, copies, raws, notes): about BLOCK entries packed into a row."""
    names = ("ids", "copies", "raws", "notes")
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("visitor", T.BooleanType()), T.StructField("salt", T.IntegerType()), T.StructField("salts", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in names])

    def run(batches):
        import pyarrow as pa

        key, held = None, ([], [], [], [])

        def row():
            return pa.RecordBatch.from_arrays([pa.array([k], t) for k, t in zip(key, (pa.int32(), pa.bool_(), pa.int32(), pa.int32()), strict=True)] + [pa.array([x], pa.binary()) for x in (np.array(held[0], "<i8").tobytes(), np.array(held[1], "<i8").tobytes(), b"".join(held[2]), b"".join(held[3]))], names=schema.names)

        for batch in batches:
            for cell, visitor, salt, salts, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, visitor, salt, salts) != key:
                    if key is not None:
                        yield row()
                    key, held = (cell, visitor, salt, salts), ([], [], [], [])
                for column, value in zip(held, values, strict=True):
                    column.append(value)
        if key is not None:
            yield row()

    # at most one row of sizes per cell and kind: the grid bounds what is broadcast
    sized = entries.join(F.broadcast(sizes), ["cell", "visitor"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    dealt = sized.select("cell", "visitor", "salt", "salts", "id", "copies", "raw", "note").repartition(parts(entries.sparkSession), "cell", "visitor", "salt")
    return dealt.sortWithinPartitions("cell", "visitor", "salt").mapInArrow(run, schema)


def _meet(blocks: DataFrame, threshold: float) -> DataFrame:
    """(id, links, least) per block pair and linked vector: how many vectors it met there, and the smallest id of its part."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("links", T.LongType()), T.StructField("least", T.LongType())])
    members = blocks.where("not visitor").select(F.col("cell").alias("c"), F.col("salt").alias("s"), "salts", F.col("ids").alias("mi"), F.col("copies").alias("mc"), F.col("raws").alias("mr"), F.col("notes").alias("mn"))
    counts = members.select("c", "salts").distinct()  # at most one row per cell of the grid
    visitors = blocks.where("visitor").drop("salts").join(F.broadcast(counts), F.col("cell") == F.col("c")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    joined = visitors.select("c", "s", "ids", "copies", "raws", "notes").join(members.drop("salts"), ["c", "s"]).select("ids", "copies", "raws", "notes", "mi", "mc", "mr", "mn")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                qi, qc, qr, qn, mi, mc, mr, mn = (batch.column(k)[row].as_buffer() for k in range(8))
                a, b = np.frombuffer(qi, "<i8"), np.frombuffer(mi, "<i8")
                ca, cb = np.frombuffer(qc, "<i8"), np.frombuffer(mc, "<i8")
                x, y = unit(qr, len(a)), unit(mr, len(b))
                own, visits = np.frombuffer(qn, "<i4"), np.frombuffer(mn, "<i4").reshape(len(b), -1)
                linked = (x @ y.T >= threshold) & (a[:, None] != b[None, :])
                if not linked.any():
                    continue
                # a member that visits the visitor's cell meets it there as well and counts it then
                both = np.zeros(linked.shape, bool)
                for cell in np.unique(own[linked.any(axis=1)]):
                    both[np.ix_(own == cell, (visits == cell).any(axis=1))] = True
                left = (linked * cb[None, :]).sum(axis=1)
                right = ((linked & ~both) * ca[:, None]).sum(axis=0)
                names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                least = np.arange(len(names))
                la, lb = at[: len(a)], at[len(a) :]
                while True:
                    seen = least.copy()
                    np.minimum.at(least, la, np.where(linked, least[lb][None, :], len(names)).min(axis=1))
                    np.minimum.at(least, lb, np.where(linked, least[la][:, None], len(names)).min(axis=0))
                    if (least == seen).all():
                        break
                total = np.zeros(len(names), np.int64)
                np.add.at(total, la, left)
                np.add.at(total, lb, right)
                keep = np.zeros(len(names), bool)
                keep[la[linked.any(axis=1)]] = True
                keep[lb[linked.any(axis=0)]] = True
                yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(total[keep]), pa.array(names[least[keep]])], names=schema.names)

    return joined.mapInArrow(run, schema)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    rows = scratch.store(valid_vectors(only(vectors, id_col, vec_col), id_col, vec_col), "rows")
    usual = rows.where("dims is not null").groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()  # lengths are few
    dims = usual["dims"] if usual else 0
    usable = rows.where((F.col("dims") == dims) & F.col("vec_id").isNotNull())
    classes = scratch.store(usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    # ids of two rows may be equal: the class is found by digest and id
    reps = classes.join(usable.select("digest", F.col("vec_id").alias("id"), "raw"), ["digest", "id"]).dropDuplicates(["digest"])
    reps = scratch.store(reps.select("id", "copies", "raw"), "reps")
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("raw").collect()  # SAMPLE rows at most
    if sample:
        index = spark.sparkContext.broadcast(MultiIndex(unit(b"".join(bytes(r["raw"]) for r in sample), len(sample)), threshold, recall))
        entries = _entries(reps, index)
        sizes = scratch.store(entries.groupBy("cell", "visitor").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts")), "sizes", 1)
        met = scratch.store(_meet(scratch.store(_blocks(entries, sizes), "blocks"), threshold), "met")
    else:
        met = spark.createDataFrame([], "id long, links long, least long")
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = components(scratch, met.select(F.col("id").alias("a"), F.col("least").alias("b")), "cc")
    placed = classes.join(counts, "id", "left").join(nodes, F.col("id") == F.col("node"), "left")
    placed = scratch.store(placed.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "placed")
    out = rows.withColumn("digest", F.when((F.col("dims") == dims) & F.col("vec_id").isNotNull(), F.col("digest"))).select("vec_id", "digest").join(placed, "digest", "left")
    out = scratch.store(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "answer")
    scratch.drop(*[name for name in scratch.held if name != "answer"])
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: DuckDB's form for ``embeddings``: every pair compared, for tables on which the search has full recall
PAIRS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(embedding, lambda c: abs(c))) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, t.vec_id = m.component_id AS kept
FROM embeddings t LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) n ON n.a = t.vec_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = t.vec_id
"""
