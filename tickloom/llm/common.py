"""Scratch tables, prefix sums and connected components shared by the operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.store import shared_dir
from tickloom.sources.workers import ship

#: stands for a null id in joins
NO_ID = -(1 << 63)

_OPEN: list["Scratch"] = []


class Scratch:
    """Tables written to the session's shared folder and removed when no longer read.

    Writing a table cuts the lineage, and the files survive lost executors.
    ``drop`` removes tables as soon as their readers have run; what a returned
    DataFrame still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: set[str] = set()
        ship(spark)
        _OPEN.append(self)

    def path(self, name: str) -> str:
        self.held.add(name)
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
        if partitions:
            df = df.coalesce(partitions)
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            self.held.discard(name)
            target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.held.clear()


@atexit.register
def _close_all() -> None:
    for scratch in _OPEN:
        if scratch.held and scratch.spark.sparkContext._jsc is not None:
            try:
                scratch.close()
            except Exception as error:  # the session may already be gone; then the folder stays
                print(f"scratch folder {scratch.root} stays: {type(error).__name__}")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def identified(docs: DataFrame) -> DataFrame:
    """(d, h, body, doc_id): a row's identity by id and content, without nulls, and its bytes."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("doc_id", body).alias("h"), body.alias("body"), F.col("doc_id").cast("long").alias("doc_id"))


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_start(scratch: Scratch, df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """``df`` with ``start``: the sum of ``size`` over all rows before it in ``order``.

    Rows are range-partitioned, summed within their partition while they stream
    past, and written with the partition's number. Only one total per partition
    meets in one place. The table is stored before totals are taken, so that both
    readers see the same ranges.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())])

    def local(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sums = pc.cumulative_sum(batch.column(batch.schema.get_field_index(size)).cast(pa.int64()))
            before = pc.add(pc.subtract(sums, batch.column(batch.schema.get_field_index(size)).cast(pa.int64())), total)
            total += sums[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), before], names=[*batch.schema.names, "__part", "__local"])

    n = parts(df.sparkSession)
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(local, schema)
    stored = scratch.store(ordered, name)
    # one row per partition: the window over them is bounded by the number of partitions
    totals = stored.groupBy("__part").agg(F.sum(size).alias("__size"))
    from pyspark.sql import Window

    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__part", F.coalesce(F.sum("__size").over(w), F.lit(0)).cast("long").alias("__base"))
    out = stored.join(F.broadcast(base), "__part")  # as many rows as partitions
    return out.select(*df.columns, (F.col("__base") + F.col("__local")).alias("start"))


def components(scratch: Scratch, links: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b).

    Alternating star contraction: each round replaces a node's links by links to
    the smallest neighbour, until only stars are left; the rounds grow with the
    logarithm of the longest chain. Joins are on one node per side with the
    star's centre unique, so a hot centre is one skewed side that the adaptive
    join splits. Each round is written to the shared folder. Nodes without links
    do not appear. Empty links: an empty table. Self links and repeats are ignored.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        # u's smallest neighbour (or u itself) takes over u's larger (or smaller) neighbours
        pairs = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.store(edges, f"{tag}0")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    step = 0
    while mark[0]:
        step += 1
        edges = scratch.store(stars(stars(edges, True), False), f"{tag}{step}")
        scratch.drop(f"{tag}{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(heads)
