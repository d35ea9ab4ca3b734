"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of the text's bytes over its present share.
Each document draws its number of copies by inverting the Poisson distribution of
that mean at a uniform number hashed from seed and doc_id, is exploded by it, and
the copies are dealt and ordered by another hash: a global shuffle.

A mean above ``STEP`` is split into equal parts with a draw each, so the
distribution never underflows. Rates are one row per source, written to the
shared folder and broadcast only where Spark finds the file below its threshold.

Defined results: a null source is a source of its own; a null text has no bytes;
a null doc_id draws as the text ``null``; rows that repeat a doc_id draw alike; a
source that has no bytes or no weight is dropped; an empty table gives an empty
table; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, only, parts

STEP, LONGEST = 32, 100


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= j) for j from 0 to LONGEST, X Poisson with this mean (at most STEP)."""
    factorials = F.transform(F.sequence(F.lit(0), F.lit(LONGEST)), lambda j: F.aggregate(F.sequence(F.lit(0), j), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double"))))
    chances = F.transform(factorials, lambda f, j: F.exp(j.cast("double") * F.log(rate) - rate - f))
    sums = F.transform(F.sequence(F.lit(1), F.lit(LONGEST + 1)), lambda n: F.aggregate(F.slice(chances, F.lit(1), n), F.lit(0.0), lambda s, p: s + p))
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None, power: float, repeat: float) -> DataFrame:
    """(__source, __rate, __pieces, __steps): the mean copies per document of each source.

    ``weights`` are target shares by source; without them, a source's present share
    to ``power``. ``repeat`` scales the whole: 1 gives about as many bytes as came in.
    """
    have = only(docs, "source", "text").groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")).alias("bytes"))
    if weights is None:
        have = have.withColumn("want", F.pow("bytes", F.lit(power)))
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None)
        have = have.withColumn("want", F.coalesce(table[F.col("source")].cast("double"), F.lit(0.0)) if weights else F.lit(0.0))
    total = have.agg(F.sum("bytes").alias("all_bytes"), F.sum("want").alias("all_want"))  # one row
    rate = F.when((F.col("bytes") > 0) & (F.col("all_want") > 0), F.lit(repeat) * F.col("want") / F.col("all_want") * F.col("all_bytes") / F.col("bytes")).otherwise(0.0)
    out = have.crossJoin(F.broadcast(total)).withColumn("rate", F.round(rate, 9))
    out = out.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
    return out.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("pieces").alias("__pieces"), poisson_steps(F.col("rate") / F.col("pieces")).alias("__steps"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, repeat: float = 1.0, seed: int = 17) -> DataFrame:
    """Every copy of every document, with ``copy`` (from 1), ``rate`` and ``order_key``, dealt by that key."""
    scratch = Scratch(docs.sparkSession, "mixing")
    table = scratch.store(rates(docs, weights, power, repeat), "rates", 1)
    rows = docs.join(table, docs["source"].eqNullSafe(F.col("__source")))
    drawn = F.transform(F.sequence(F.lit(0), F.col("__pieces") - 1), lambda i: F.size(F.filter("__steps", lambda c: c <= uniform(seed, docs["doc_id"], i))))
    copies = rows.withColumn("__copies", F.aggregate(drawn, F.lit(0), lambda a, b: a + b)).where("__copies > 0")
    exploded = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    keyed = exploded.withColumn("__order", uniform(seed, F.lit("order"), docs["doc_id"], F.col("__copy")))
    dealt = keyed.repartition(parts(docs.sparkSession), "__order").sortWithinPartitions("__order")
    return dealt.select(*[docs[c] for c in docs.columns], F.col("__copy").alias("copy"), F.col("__rate").alias("rate"), F.col("__order").alias("order_key"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs`` alone."""
    return mix(docs, **options).drop("copy", "rate", "order_key")


#: the same for ``documents`` in SQL, at the default parameters
MIX_SQL = f"""
WITH have AS (SELECT source, sum(coalesce(strlen(text), 0)::DOUBLE) AS bytes FROM documents GROUP BY source),
want AS (SELECT *, pow(bytes, 0.5) AS want FROM have),
total AS (SELECT sum(bytes) AS all_bytes, sum(want) AS all_want FROM want),
rated AS (SELECT source, round(CASE WHEN bytes > 0 AND all_want > 0 THEN 1.0::DOUBLE * want / all_want * all_bytes / bytes ELSE 0 END, 9) AS rate FROM want, total),
pieced AS (SELECT *, greatest(ceil(rate / {STEP}), 1)::INT AS pieces FROM rated),
chanced AS (SELECT *, CASE WHEN rate > 0 THEN list_transform(range(0, {LONGEST + 1}), lambda j: exp(j * ln(rate / pieces) - rate / pieces - list_sum(list_transform(range(0, j + 1), lambda i: ln(greatest(i, 1)::DOUBLE))))) ELSE [1.0::DOUBLE] END AS chances FROM pieced),
stepped AS (SELECT source, rate, pieces, list_transform(range(1, len(chances) + 1), lambda n: list_sum(list_slice(chances, 1, n))) AS steps FROM chanced),
drawn AS (
  SELECT d.*, r.rate, list_sum(list_transform(range(0, r.pieces), lambda p: len(list_filter(r.steps, lambda c: c <= ('0x' || substr(md5('17:' || d.doc_id::VARCHAR || ':' || p::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))) AS copies
  FROM documents d JOIN stepped r ON d.source IS NOT DISTINCT FROM r.source
),
exploded AS (SELECT *, unnest(range(1, copies::BIGINT + 1))::INT AS copy FROM drawn WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy, rate, ('0x' || substr(md5('17:order:' || doc_id::VARCHAR || ':' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS order_key
FROM exploded
"""
