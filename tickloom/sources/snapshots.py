"""Dated snapshots: JSON in, parquet out, latest date by default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_json_snapshot(df: DataFrame, root: str, dataset: str, date: str) -> None:
    """One folder per date; rows of a date are written by the tasks that hold them."""
    df.repartition(date).write.mode("overwrite").partitionBy(date).json(f"{root}/{dataset}")


def read_dataset(spark: SparkSession, root: str, dataset: str, schema: StructType, required: bool = True) -> DataFrame | None:
    """Typed read with bad rows kept in ``_corrupt``; a missing optional dataset gives None."""
    full = StructType([*schema.fields]).add("_corrupt", "string")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{dataset}")
    if not required and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/{dataset}")


def on_date(df: DataFrame, date: str, value=None) -> DataFrame:
    """Rows of a snapshot date, the latest by default. The latest date is found from the partition listing."""
    if value is not None:
        return df.where(F.col(date) == F.lit(value))
    latest = df.select(date).distinct().agg(F.max(date).alias(date))
    return df.join(F.broadcast(latest), date, "left_semi")  # one row


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_run(spark: SparkSession, path: str, key: str, score: str, value=None) -> DataFrame:
    return on_date(spark.read.parquet(path), key, value).orderBy(F.desc(score))


def merge_files(df: DataFrame, pattern: str) -> DataFrame:
    """Rows tagged with the part of their file path that matches ``pattern``."""
    return df.withColumn("file_date", F.regexp_extract(F.input_file_name(), pattern, 1))


def universe(df: DataFrame, code: str, snapshot: str, last: int = 3) -> DataFrame:
    """Distinct padded codes of the latest snapshots without special shares."""
    recent = df.select(snapshot).distinct().orderBy(F.desc(snapshot)).limit(last)
    rows = df.join(recent, snapshot, "left_semi").where(~F.col(code).rlike("[BR]$"))
    c = F.when(F.length(code) < 4, F.lpad(F.col(code), 4, "0")).otherwise(F.col(code))
    return rows.select(c.alias("code")).distinct()


def backfill_actions(feed: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Cash and split rows of a year range; a split ratio becomes a stock dividend per ten."""
    rows = feed.where(F.year("date").between(start_year, end_year) & ((F.col("cash") > 0) | (F.col("split") > 0)))
    return rows.select(
        "instrument", "date", F.col("cash").alias("cash_div"), F.when(F.col("split") > 1, (F.col("split") - 1) * 10).otherwise(0.0).alias("stock_div"))


def load_counts(before: Sequence[tuple[str, DataFrame]], incoming: Sequence[tuple[str, DataFrame]], keys: dict[str, list[str]]) -> DataFrame:
    """Inserted and skipped rows per table of an idempotent load."""
    out = None
    for (name, old), (_, new) in zip(before, incoming):
        k = keys[name]
        known = old.select(*k).distinct().withColumn("_old", F.lit(True))
        c = new.groupBy(*k).agg(F.count("*").alias("_n")).join(known, k, "left").agg(
            F.count_if(F.col("_old").isNull()).alias("inserted"), (F.sum("_n") - F.count_if(F.col("_old").isNull())).alias("skipped")
        ).select(F.lit(name).alias("table"), "inserted", "skipped")
        out = c if out is None else out.unionByName(c)
    return out


def parameter_table(spark: SparkSession, values: dict[str, float], given: DataFrame | None = None) -> DataFrame:
    """Key/value parameters: given values over defaults. Bounded by the number of parameters in code."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("default")) for k, v in values.items()])
    base = spark.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    if given is None:
        return base.select("name", F.col("default").alias("value"))
    return base.join(given.select("name", F.col("value").alias("_v")), "name", "left").select("name", F.coalesce("_v", "default").alias("value"))


def read_parameter_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(file, value): every JSON file below ``root`` as a variant; null where it is not JSON."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("value"))


def flatten_parameters(files: DataFrame, depth: int = 8) -> DataFrame:
    """(file, path, value): the leaves of nested objects under their key path, e.g. ``weights.normal.flow``.

    Lists are leaves. Objects nested deeper than ``depth`` raise, empty ones and unreadable files give no row.
    """
    spark, found = files.sparkSession, None
    level = files.select("file", F.lit("").alias("path"), "value")
    for _ in range(depth):
        kind = F.schema_of_variant("value")
        leaf = level.where(~kind.startswith("OBJECT") & (F.col("path") != "")).select("file", F.substr("path", F.lit(2)).alias("path"), "value")
        found = leaf if found is None else found.unionAll(leaf)
        inner = level.where(kind.startswith("OBJECT")).withColumnRenamed("value", "object")
        keys = inner.lateralJoin(spark.tvf.variant_explode(F.col("object").outer()))
        level = keys.where("key is not null").select("file", F.concat("path", F.lit("."), "key").alias("path"), "value")
    rest = F.when(F.schema_of_variant("value").startswith("OBJECT"), F.raise_error(F.concat(F.lit("parameters nested too deep: "), "path"))).otherwise(F.substr("path", F.lit(2)))
    return found.unionAll(level.select("file", rest.alias("path"), "value"))


def key_paths(values: Mapping, above: str = "") -> dict[str, object]:
    """A nested mapping of defaults by key path."""
    out = {}
    for key, value in values.items():
        out |= key_paths(value, f"{above}{key}.") if isinstance(value, Mapping) else {f"{above}{key}": value}
    return out


def nested_parameters(spark: SparkSession, defaults: Mapping, given: DataFrame) -> DataFrame:
    """(path, number, text, status): stored leaves (file, path, value) over typed defaults.

    A leaf takes the type of its default: ``number`` for numbers, ``text`` for texts and
    truth values. ``status`` is given, default, wrong type (the default stays) or
    unknown (no default has that path). Of several files with a path the last by name counts.
    The defaults are as many as the code names.
    """
    rows = [(k, "text" if isinstance(v, (str, bool)) else "number", None if isinstance(v, (str, bool)) else float(v), str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else None) for k, v in key_paths(defaults).items()]
    fields = F.array(*[F.struct(F.lit(k).alias("path"), F.lit(kind).alias("type"), F.lit(n).cast("double").alias("n"), F.lit(x).cast("string").alias("x")) for k, kind, n, x in rows])
    base = spark.range(1).select(F.explode(fields).alias("p")).select("p.*")
    plain = F.schema_of_variant("value")
    leaves = given.select("path", "file", plain.alias("kind"), F.try_variant_get("value", "$", "double").alias("gn"), F.try_variant_get("value", "$", "string").alias("gx"))
    last = leaves.groupBy("path").agg(F.max_by(F.struct("kind", "gn", "gx"), "file").alias("g")).select("path", "g.*")
    numeric = F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    fits = F.when(F.col("type") == "number", numeric).otherwise(F.col("kind").isin("STRING", "BOOLEAN"))
    both = base.join(last, "path", "full")
    status = F.when(F.col("type").isNull(), "unknown").when(F.col("kind").isNull(), "default").when(fits, "given").otherwise("wrong type")
    taken = both.withColumn("status", status)
    number = F.when(F.col("status") == "given", F.when(F.col("type") == "number", F.col("gn"))).when(F.col("status") == "unknown", F.when(numeric, F.col("gn"))).otherwise(F.col("n"))
    text = F.when(F.col("status") == "given", F.when(F.col("type") == "text", F.col("gx"))).when(F.col("status") == "unknown", F.when(~numeric, F.col("gx"))).otherwise(F.col("x"))
    return taken.select("path", number.alias("number"), text.alias("text"), "status")
