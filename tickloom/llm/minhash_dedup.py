"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact check.

Candidates share a band of their signatures. A pair's signatures are compared
batch by batch; with m agreements among n comparisons and a uniform prior, the
similarity has a Beta(m+1, n-m+1) posterior, and a pair is given up as soon as
the posterior probability of reaching the threshold is below ``miss``. Survivors
are checked on their full shingle sets, so no link is wrong.

Defined results: null and empty texts and texts of white space only have no
shingles, link with nothing and stay; a text of fewer than k words is one
shingle; equal sets are one class; rows that repeat a doc_id with one text get
that document's answer each, and with different texts each text's own; of different
texts of a component's least doc_id the one of the least set digest is kept; a null
doc_id stands for no class, gets the component of its equals and is kept; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, only
from tickloom.llm.near import batches_of, link_all, members
from tickloom.llm.text import MinHash, set_id, shingle_hashes, slices, word_hashes

BANDS, ROWS, BATCH, MISS = 32, 4, 16, 1e-6


def signatures(docs: DataFrame, k: int, size: int) -> DataFrame:
    """(doc_id, body, n_shingles, set_id, sig) per row: body is the text's md5; set_id and sig are null without shingles."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        minhash = MinHash(size)
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(2)
            for first, texts in slices(batch, "text"):
                n, sets, sigs = [], [], []
                for text in texts:
                    hashes = np.unique(shingle_hashes(word_hashes(text)[0], k))
                    n.append(len(hashes))
                    sets.append(set_id(hashes) if len(hashes) else None)
                    sigs.append(minhash(hashes).tobytes() if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), bodies.slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=schema.names)

    return only(docs, "doc_id", "text").withColumn("body", _body("text")).mapInArrow(run, schema)


def _body(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set_id, hashes) of the wanted documents (doc_id): sorted 64-bit shingle hashes, once per set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, "text"):
                sets = [np.unique(shingle_hashes(word_hashes(t)[0], k)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "hashes"])

    schema = T.StructType([T.StructField("set_id", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
    return only(docs, "doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, schema).dropDuplicates(["set_id"])


def _answers(docs: DataFrame, k: int, percent: int, bands: int, rows: int, batch_size: int, miss: float) -> DataFrame:
    """(doc_id, body, n_shingles, component_id, kept) per row of ``docs``."""
    spark = docs.sparkSession
    scratch, size = Scratch(spark, "minhash"), bands * rows
    rows_ = scratch.store(signatures(docs, k, size), "rows")
    classes = rows_.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min_by("sig", "doc_id").alias("sig"))
    # a doc_id may stand for several texts, so classes have numbers of their own; stored, so that they stay
    classes = scratch.store(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    inside = members(scratch, classes, bands, rows)
    candidates = inside.select("id").distinct()
    sigs = classes.select("id", "doc_id", "set_id", "sig").join(candidates, "id", "left_semi")
    units = scratch.store(sigs.select("id", "set_id", "sig").join(shingle_sets(docs, sigs, k), "set_id").select("id", "sig", "hashes"), "units")
    nodes = link_all(scratch, inside, units, batches_of(size, batch_size, percent / 100, miss), percent)
    # only classes that hold several documents or a link need to be looked up
    placed = classes.join(nodes, classes.id == nodes.node, "left").select("set_id", "doc_id", F.coalesce("component", "id").alias("c"), "copies", F.col("component").isNotNull().alias("linked"))
    placed = scratch.store(placed.where("copies > 1 or linked").select("set_id", "doc_id", "c"), "placed")
    heads = placed.groupBy("c").agg(F.min(F.struct("doc_id", "set_id")).alias("head"))
    named = placed.join(heads, "c").select("set_id", F.col("head.doc_id").alias("component"), (F.col("set_id") == F.col("head.set_id")).alias("first"))
    out = rows_.select("doc_id", "body", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce((F.col("doc_id") == component) & F.coalesce("first", F.lit(True)), F.lit(True))
    out = scratch.store(out.select("doc_id", "body", "n_shingles", component.alias("component_id"), kept.alias("kept")), "answer")
    scratch.drop(*[name for name in scratch.held if name != "answer"])
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, batch_size: int = BATCH, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text), over sets of ``k`` words.

    ``percent`` is the least 100 * intersection / union of linked documents; with
    32 bands of 4 rows a pair at 0.8 shares no band with probability 5e-8.
    """
    return _answers(docs, k, percent, bands, rows, batch_size, miss).drop("body")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, batch_size: int = BATCH, miss: float = MISS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; all columns stay. Sets are of five words here."""
    gone = _answers(docs, k, percent, bands, rows, batch_size, miss).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("body").alias("__body")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("__gone")) & (_body(docs["text"]) == F.col("__body")), "left_anti")


#: DuckDB's form for ``documents``: all pairs that share a shingle, exact similarity, reachability
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
