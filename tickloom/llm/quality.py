"""Quality scores from random-indexing word vectors and a small network.

Every word (as written) and every word shape (its runs of upper, lower, digit and
other characters) is hashed to a bucket with a fixed sparse random index vector.
One pass over the whole corpus adds up, per bucket, the index vectors of the words
within two places: its context vector. A document is the mean of its words'
context, index and shape vectors, weighted by rarity, plus a few norms. A network
with one hidden layer is fitted in numpy on at most ``SAMPLE`` labelled documents,
and its logits are divided by a temperature fitted on a part it has not seen.

The tables that reach the driver are bounded: BUCKETS context vectors and SAMPLE
document vectors. Everything else runs in the scan tasks.

Defined results: a null text is empty; an empty text gets the score of a zero
vector; a null label is no label; a doc_id labelled twice counts as 1 if any label
is; labels of one kind only give that kind's share as every score, no labels give
1; a null doc_id is not held out; an empty table gives an empty table; other
columns are ignored by ``scores`` and kept by ``accepted``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import only, parts
from tickloom.llm.text import _SEPARATES, mix, powers, slices
from tickloom.sources.workers import ship

BUCKETS, DIM, SHAPES = 1 << 14, 64, 1 << 10
#: labelled documents the network is fitted on, at most
SAMPLE = 20_000
HIDDEN, EPOCHS = 32, 60

_KIND = np.full(256, 3, np.uint8)  # other
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(128, 256)]] = 0  # bytes of letters beyond ASCII
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, shape buckets and each word's text number, over a slice of texts."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SEPARATES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(50)
    kind = _KIND[raw]
    change = np.empty(len(raw), bool)
    change[0], change[1:] = True, kind[1:] != kind[:-1]
    change[starts] = True
    change &= inside
    place = np.concatenate(([0], np.cumsum(change)))
    runs = kind[change].astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(runs) + 1, np.uint64)
    np.cumsum(runs * up[: len(runs)], out=total[1:])
    shapes = mix((total[place[ends]] - total[place[starts]]) * down[place[starts]]) >> np.uint64(54)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words.astype(np.int64), shapes.astype(np.int64), np.searchsorted(bounds, starts, "right")


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (n, 2) and signs (n, 2) of the sparse random index vectors."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, DIM, (n, 2)), draw.choice(np.array([-1.0, 1.0]), (n, 2))


def context_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n, vec): how often a bucket occurs and the sum of its neighbours' index vectors."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("vec", T.BinaryType())])

    def emit(names, count, total):
        import pyarrow as pa

        for i in range(0, len(names), 4096):
            s = slice(i, i + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(names[s], pa.int32()), pa.array(count[s], pa.int64()), pa.array([v.tobytes() for v in total[s]], pa.binary())], names=schema.names)

    def collect(batches):
        places, signs = index_vectors(BUCKETS, 5)
        total, count = np.zeros(BUCKETS * DIM, np.float64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                words, _, doc = buckets(texts)
                count += np.bincount(words, minlength=BUCKETS)
                for gap in (1, 2):
                    same = doc[gap:] == doc[:-gap]
                    left, right = words[:-gap][same], words[gap:][same]
                    for near, word in ((left, right), (right, left)):
                        for slot in (0, 1):
                            total += np.bincount(word * DIM + places[near, slot], signs[near, slot], BUCKETS * DIM)
        seen = np.flatnonzero(count)
        yield from emit(seen, count[seen], total.reshape(BUCKETS, DIM)[seen].astype(np.float32))

    def add(batches):
        total, count = {}, {}
        for batch in batches:
            for bucket, n, vec in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                vec = np.frombuffer(vec, np.float32)
                total[bucket] = total[bucket] + vec if bucket in total else vec.astype(np.float64)
                count[bucket] = count.get(bucket, 0) + n
        names = sorted(total)
        yield from emit(names, [count[b] for b in names], np.array([total[b] for b in names], np.float32).reshape(-1, DIM))

    return only(docs, "text").mapInArrow(collect, schema).repartition(parts(docs.sparkSession), "bucket").mapInArrow(add, schema)


class Vectors:
    """Word, index and shape vectors by bucket, and the pooled vector of a document."""

    width = 3 * DIM + 4

    def __init__(self, names: np.ndarray, counts: np.ndarray, context: np.ndarray):
        self.context = np.zeros((BUCKETS, DIM), np.float32)
        if len(names):
            unit = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
            unit = unit - np.average(unit, axis=0, weights=counts)  # what all words share says nothing
            self.context[names] = unit
        self.weight = np.ones(BUCKETS, np.float32)
        self.weight[names] = 1 / (1 + np.log1p(counts * (1e4 / max(counts.sum(), 1)))) if len(names) else 1
        self.index, self.shape = self._dense(BUCKETS, 5), self._dense(SHAPES, 6)

    @staticmethod
    def _dense(n: int, seed: int) -> np.ndarray:
        places, signs = index_vectors(n, seed)
        out = np.zeros((n, DIM), np.float32)
        for slot in (0, 1):
            np.add.at(out, (np.arange(n), places[:, slot]), signs[:, slot])
        return out

    def pool(self, texts: list[bytes]) -> np.ndarray:
        words, shapes, doc = buckets(texts)
        out = np.zeros((len(texts), self.width), np.float32)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            w, s = words[bounds[i] : bounds[i + 1]], shapes[bounds[i] : bounds[i + 1]]
            if not len(w):
                continue
            # one row per distinct bucket keeps very long texts small
            n = np.bincount(w, minlength=BUCKETS)
            at = np.flatnonzero(n)
            weight = (n[at] * self.weight[at]).astype(np.float32)
            weight /= weight.sum()
            m = np.bincount(s, minlength=SHAPES).astype(np.float32)
            there = np.flatnonzero(m)
            out[i, :DIM] = weight @ self.context[at]
            out[i, DIM : 2 * DIM] = weight @ self.index[at]
            out[i, 2 * DIM : 3 * DIM] = (m[there] / len(s)) @ self.shape[there]
            out[i, 3 * DIM :] = np.log1p(len(w)), np.sqrt(weight @ weight), len(at) / len(w), np.sqrt(((n[at] / len(w)) ** 2).sum())
        return out


class Network:
    """Standardised inputs, one hidden layer, a logit and its temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 1.0
        self.fitted = 0 < self.share < 1
        if not self.fitted:
            return
        draw = np.random.default_rng(3)
        order = draw.permutation(len(x))
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x, y = ((x - self.middle) / self.spread)[order], y[order].astype(float)
        cut = max(1, len(x) // 6)
        seen, kept = (x[cut:], y[cut:]), (x[:cut], y[:cut])
        if len(set(seen[1])) < 2:
            seen = (x, y)
        p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(self.share / (1 - self.share)))]
        first, second, step, best = [0 * v for v in p], [0 * v for v in p], 0, (np.inf, p)
        for _ in range(EPOCHS):
            mixed = draw.permutation(len(seen[0]))
            for at in range(0, len(mixed), 256):
                rows = mixed[at : at + 256]
                a, t = seen[0][rows], seen[1][rows]
                h = np.tanh(a @ p[0] + p[1])
                gap = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(rows)
                back = np.outer(gap, p[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ gap + 1e-4 * p[2], gap.sum()]
                step += 1
                for i, g in enumerate(grads):
                    first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                    p[i] = p[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(self._logit(kept[0], p), kept[1])
            if loss < best[0]:
                best = (loss, [np.array(v) for v in p])
        self.p = best[1]
        logit = self._logit(kept[0], self.p)
        self.temperature = min(np.geomspace(0.25, 8, 101), key=lambda t: self._loss(logit / t, kept[1]))

    @staticmethod
    def _logit(x: np.ndarray, p: list) -> np.ndarray:
        return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]

    @staticmethod
    def _loss(logit: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.middle) / self.spread, self.p) / self.temperature, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Vectors, Network]:
    """Context vectors over all of ``docs``; the network on at most ``sample`` labelled ones, by hash of doc_id."""
    ship(docs.sparkSession)
    rows = context_counts(docs).collect()  # at most BUCKETS rows
    rows.sort(key=lambda r: r["bucket"])
    vectors = Vectors(np.array([r["bucket"] for r in rows], int), np.array([r["n"] for r in rows], float), np.array([np.frombuffer(r["vec"], np.float32) for r in rows], float).reshape(-1, DIM))
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most ``sample`` rows: their ids and labels are broadcast, so the texts are not shuffled
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def pooled(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text"):
                x = shared.value.pool(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), pa.array([v.tobytes() for v in x], pa.binary())], names=schema.names)

    labelled = only(docs, "doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id").select("doc_id", "text", "quality")
    got = labelled.mapInArrow(pooled, schema).collect()  # at most ``sample`` documents
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], float).reshape(-1, Vectors.width)
    return vectors, Network(x, np.array([r["quality"] == 1 for r in got], float))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def judge(batches):
        import pyarrow as pa

        vectors, network = shared.value
        for batch in batches:
            for first, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(network.scores(vectors.pool(texts)), pa.float64())], names=schema.names)

    out = only(docs, "doc_id", "text").mapInArrow(judge, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def judge(batches):
        import pyarrow as pa

        vectors, network = shared.value
        for batch in batches:
            for first, texts in slices(batch, "text"):
                yield batch.slice(first, len(texts)).filter(pa.array(network.scores(vectors.pool(texts)) >= threshold))

    return docs.mapInArrow(judge, docs.schema)
