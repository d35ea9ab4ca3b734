"""Keyed tables stored by partition: loads that can be repeated, with counts from the write itself.

A load reads and writes the partitions that its rows fall into and no others, so its
cost follows the load, not the table. Inserting appends the rows of unknown keys and
rewrites nothing; replacing rewrites the partitions in which a row differs. Either may be
run again after a failure or a repetition: what is stored already is skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.store import _path

#: holds the partition's value; a table has one partition per value
PART = "load_part"


@dataclass
class StoredTable:
    """Rows of ``schema`` under ``path``, one per key; ``part`` is the partition's value, an expression of key columns."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    part: Column

    def _full(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(PART, T.StringType())])

    def _exists(self) -> bool:
        target, fs = _path(self.spark, self.path)
        return fs.exists(target)

    def _stored(self, parts: Sequence[str] | None = None) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self._full())
        out = self.spark.read.schema(self._full()).parquet(self.path)
        return out if parts is None else out.where(F.col(PART).isin(list(parts)))

    def rows(self) -> DataFrame:
        return self._stored().drop(PART)

    def _incoming(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        """One row per key (the smallest ``order``), how many rows had it, and its partition. Rows without a whole key are not loaded."""
        rest = [c for c in self.schema.names if c not in self.keys]
        whole = rows.select(*self.schema.names, *[c for c in order if c not in self.schema.names]).dropna(subset=list(self.keys))
        one = whole.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count("*").alias("copies"))
        fields = {f.name: f.dataType for f in self.schema.fields}
        return one.select(*[(F.col(c) if c in self.keys else F.col(f"r.`{c}`")).cast(fields[c]).alias(c) for c in self.schema.names], "copies").withColumn(PART, self.part.cast("string"))

    def _parts(self, rows: DataFrame) -> list[str]:
        """Partitions that rows fall into: as many as the table has at the most, never as many as rows."""
        return sorted(r[0] for r in rows.select(self.part.cast("string").alias(PART)).distinct().collect() if r[0] is not None)

    def insert(self, rows: DataFrame, order: Sequence[str]) -> dict[str, int]:
        """Append the rows whose key is not stored yet; of equal keys the smallest ``order``. First writer wins."""
        parts = self._parts(rows.dropna(subset=list(self.keys)))
        if not parts:
            return {"inserted": 0, "skipped": 0}
        # rows and stored keys of a partition meet once, before they are counted and written: few files, and counts of the writing tasks alone
        rest = [c for c in self.schema.names if c not in self.keys]
        values = [*rest, *[c for c in order if c not in self.schema.names]]
        fields = {f.name: f.dataType for f in self.schema.fields}
        new = rows.select(*[F.col(k).cast(fields[k]).alias(k) for k in self.keys], *values).dropna(subset=list(self.keys)).withColumn(PART, self.part.cast("string")).withColumn("new", F.lit(True))
        types = {f.name: f.dataType for f in new.select(*values).schema.fields}
        old = self._stored(parts).select(*self.keys, *[F.lit(None).cast(types[c]).alias(c) for c in values], PART, F.lit(False).alias("new"))
        met = new.unionByName(old).repartition(PART).groupBy(PART, *self.keys).agg(
            F.min_by(F.struct(*rest), F.when(F.col("new"), F.struct(*order))).alias("row"), F.count_if("new").alias("copies"), F.bool_or(~F.col("new")).alias("known")).where("copies > 0")
        seen, fresh = Observation(), ~F.col("known")
        counted = met.observe(seen, F.count_if(fresh).alias("inserted"), (F.sum("copies") - F.count_if(fresh)).alias("skipped"))
        out = counted.where(fresh).select(*[(F.col(c) if c in self.keys else F.col(f"row.`{c}`")).cast(fields[c]).alias(c) for c in self.schema.names], PART)
        out.write.mode("append").partitionBy(PART).parquet(self.path)
        return {k: int(v) for k, v in seen.get.items()}

    def replace(self, rows: DataFrame, order: Sequence[str]) -> dict[str, int]:
        """Rows take the place of stored rows of their key; partitions in which nothing differs are left alone."""
        new = self._incoming(rows, order)
        rest = [c for c in self.schema.names if c not in self.keys]
        old = self._stored(self._parts(rows.dropna(subset=list(self.keys))))
        before = old.select(*self.keys, F.struct(*[F.col(c) for c in rest]).alias("before"), F.lit(True).alias("known"))
        met = new.join(before, list(self.keys), "left").withColumn("differs", F.col("known").isNull() | ~F.col("before").eqNullSafe(F.struct(*[F.col(c) for c in rest])))
        differing = self._parts(met.where("differs"))
        if not differing:
            return {"inserted": 0, "replaced": 0, "skipped": int(new.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])}
        seen = Observation()
        counted = met.repartition(PART).observe(
            seen, F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if(F.col("differs") & F.col("known")).alias("replaced"),
            (F.sum("copies") - F.count_if("differs")).alias("skipped"))
        kept = old.where(F.col(PART).isin(differing)).join(new.select(*self.keys), list(self.keys), "left_anti").repartition(PART)
        out = counted.where(F.col(PART).isin(differing)).select(*self.schema.names, PART).unionByName(kept.select(*self.schema.names, PART))
        # dynamic overwrite puts the new files in place once all are written, so the table may be read meanwhile
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        return {k: int(v) for k, v in seen.get.items()}


def load(tables: Mapping[str, StoredTable], rows: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]], replaced: Sequence[str] = ()) -> DataFrame:
    """Load every table; (table, inserted, skipped), a row per table. A replaced row counts as inserted."""
    spark, said = next(iter(tables.values())).spark, []
    for name, table in tables.items():
        n = table.replace(rows[name], order[name]) if name in replaced else table.insert(rows[name], order[name])
        said.append((name, n["inserted"] + n.get("replaced", 0), n["skipped"]))
    return spark.createDataFrame(said, "table string, inserted long, skipped long")
