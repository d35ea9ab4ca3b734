"""Links between similar sets that share a MinHash band, without listing pairs within a bucket.

Every bucket has a centre: the member that shares the most buckets, which is the
middle of a group of copies. First each unit is compared with the centres of its
buckets only, and the links found give components. A centre's group (all units of
its buckets) whose units are in one component is done. In any other group, the
units outside its largest component still have to meet the units of other
components. They do so in blocks within tasks: signatures are compared batch by
batch, what the posterior bound leaves is checked on the full sets, and pairs that
earlier links already join are passed over. A block hands on the links that join
its components, not its pairs. Every pair of a bucket that could join two
components has then been compared.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, components, parts

#: units per side of a block
BLOCK = 1024


def posterior(n: int, m: int, threshold: float) -> float:
    """P(similarity >= threshold | m of n agree): the Beta(m+1, n-m+1) tail as a binomial sum."""
    return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))


def fewest(n: int, threshold: float, miss: float) -> int:
    """The fewest agreements among n with which a pair is still worth comparing."""
    return next(m for m in range(n + 1) if posterior(n, m, threshold) >= miss)


def batches_of(size: int, step: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(comparisons so far, fewest agreements) after every batch of a signature."""
    return [(n, fewest(n, threshold, miss)) for n in [*range(step, size, step), size]]


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """One 64-bit key per band of a signature of 32-bit minima; the band's number is hashed in."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, signature.substr(i * (4 * rows) + 1, F.lit(4 * rows))))


def members(scratch: Scratch, units: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, id, n): the buckets of two or more units, ``n`` the size of the bucket."""
    keyed = units.select("id", F.explode(band_keys(F.col("sig"), bands, rows)).alias("key"))
    # stored, so that a large bucket is one skewed side of a plain join
    sizes = scratch.store(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return scratch.store(keyed.join(sizes, "key"), "members")


def prune(pairs: DataFrame, sigs: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b) whose signatures leave the threshold possible after every batch of comparisons."""

    def run(batches):
        import pyarrow as pa

        size = steps[-1][0]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, size) for i in (2, 3))
            alive, agree, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in steps:
                agree[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[agree[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(alive))

    return _with_both(pairs, sigs, "sig").mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    left = pairs.join(table.select(F.col("id").alias("a"), F.col(value).alias("x")), "a").select("a", "b", "x")
    return left.join(table.select(F.col("id").alias("b"), F.col(value).alias("y")), "b").select("a", "b", "x", "y")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verify_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets (id, hashes) are similar; exact."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [similar(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_both(pairs, sets, "hashes").mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def meet(outer: list[tuple], inner: list[tuple], steps: list[tuple[int, int]], percent: int) -> list[tuple]:
    """Links that join components between two lists of (id, component, outside, signature, set).

    ``outer`` units are outside the largest component; two such units meet once, at the lesser's side.
    """
    if not outer or not inner:
        return []
    size = steps[-1][0]
    x, y = (np.frombuffer(b"".join(u[3] for u in side), "<u4").reshape(-1, size) for side in (outer, inner))
    place = {c: i for i, c in enumerate(dict.fromkeys([*(u[1] for u in outer), *(u[1] for u in inner)]))}
    cx, cy = (np.array([place[u[1]] for u in side]) for side in (outer, inner))
    agree = np.zeros((len(x), len(y)), np.int32)
    for k in range(steps[0][0]):
        agree += x[:, k, None] == y[None, :, k]
    i, j = np.nonzero((agree >= steps[0][1]) & (cx[:, None] != cy[None, :]))
    count = agree[i, j]
    for (done, _), (n, least) in zip(steps, steps[1:], strict=False):
        for s in range(0, len(i), 1 << 18):
            part = slice(s, s + (1 << 18))
            count[part] += (x[i[part], done:n] == y[j[part], done:n]).sum(axis=1, dtype=np.int32)
        keep = count >= least
        i, j, count = i[keep], j[keep], count[keep]
    parent, links = list(range(len(place))), []

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    sets = {}
    for at in np.argsort(-count, kind="stable").tolist():  # the likeliest first: a link spares the rest of its components
        a, b = int(i[at]), int(j[at])
        p, q = root(int(cx[a])), root(int(cy[b]))
        if p == q or (inner[b][2] and inner[b][0] < outer[a][0]):
            continue
        for key, unit in (((0, a), outer[a]), ((1, b), inner[b])):
            if key not in sets:
                sets[key] = np.frombuffer(unit[4], np.uint64)
        if similar(sets[0, a], sets[1, b], percent):
            parent[p] = q
            links.append((outer[a][0], inner[b][0]))
    return links


def _across(scratch: Scratch, groups: DataFrame, units: DataFrame, steps: list[tuple[int, int]], percent: int) -> DataFrame:
    """Links between components within groups (b, id, c), compared block by block."""
    by_part = groups.groupBy("b", "c").agg(F.count("*").alias("m"))
    open_ = by_part.groupBy("b").agg(F.sum("m").alias("n"), F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("top")).where("parts > 1")
    open_ = open_.select("b", F.col("top.c").alias("big"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rs"), F.ceil((F.col("n") - F.col("top.m")) / BLOCK).cast("int").alias("ls"))
    placed = scratch.store(groups.join(open_, "b").withColumn("outside", F.col("c") != F.col("big")), "open")
    full = placed.join(units, "id")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = full.where("outside").withColumn("l", salt("ls")).withColumn("r", every("rs")).withColumn("side", F.lit(0))
    inner = full.withColumn("r", salt("rs")).withColumn("l", every("ls")).withColumn("side", F.lit(1))
    columns = ["b", "l", "r", "side", "id", "c", "outside", "sig", "hashes"]
    dealt = outer.select(*columns).unionAll(inner.select(*columns)).repartition(parts(groups.sparkSession), "b", "l", "r").sortWithinPartitions("b", "l", "r", "side")
    kind = groups.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches):
        import pyarrow as pa

        key, sides = None, ([], [])

        def links():
            found = meet(*sides, steps, percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in ((0, shape), (1, shape))], names=["a", "b"])

        for batch in batches:
            shape = batch.schema.field("id").type
            for first in range(0, batch.num_rows, 256):
                for b, l, r, side, *unit in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    if (b, l, r) != key:
                        if key is not None:
                            yield links()
                        key, sides = (b, l, r), ([], [])
                    sides[side].append(tuple(unit))
        if key is not None:
            yield links()

    return dealt.mapInArrow(run, schema)


def link_all(scratch: Scratch, inside: DataFrame, units: DataFrame, steps: list[tuple[int, int]], percent: int) -> DataFrame:
    """(node, component) over all links among bucket members; ``units`` is (id, sig, hashes)."""
    weight = inside.groupBy("id").agg(F.sum("n").alias("w"))
    centre = inside.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", "id")).alias("top")).select("key", F.col("top.id").alias("b"))
    groups = scratch.store(inside.join(centre, "key").select("b", "id").distinct(), "groups")
    pairs = groups.where("id <> b").select(F.col("id").alias("a"), "b")
    left = scratch.store(prune(pairs, units, steps), "survivors")
    links = scratch.store(verify_sets(left, units, percent), "links")
    nodes = scratch.store(components(scratch, links, "cc_"), "first")
    placed = groups.join(nodes, groups.id == nodes.node, "left").select("b", "id", F.coalesce("component", "id").alias("c"))
    more = scratch.store(_across(scratch, placed, units, steps, percent), "more")
    # a component stands for its members: only links between components are left to follow
    named = lambda side: F.coalesce(F.col(f"{side}.component"), F.col(f"m.{side}"))
    joined = more.alias("m").join(nodes.alias("a"), F.col("m.a") == F.col("a.node"), "left").join(nodes.alias("b"), F.col("m.b") == F.col("b.node"), "left")
    over = components(scratch, joined.select(named("a").alias("a"), named("b").alias("b")), "over_")
    over = scratch.store(over.select(F.col("node").alias("was"), F.col("component").alias("now")), "over")
    moved = nodes.join(over, nodes.component == over.was, "left").select("node", F.coalesce("now", "component").alias("component"))
    alone = over.join(nodes.select("node"), over.was == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return moved.unionAll(alone)
