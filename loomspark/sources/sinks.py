"""Writers: partitioned, compacted, deduplicated, upserting, versioned."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from loomspark.functions.text import dir_name
from loomspark.functions.vectors import norm, normalised
from loomspark.operators.compaction import swap
from loomspark.runtime import delete_path, discard, filesystem, materialize


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = filesystem(spark, path)
    return fs.exists(hadoop_path(path))


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 1_000_000, mode: str = "append", files_per_key: int = 8) -> None:
    """Parquet, zstd, one folder level per column of `by`; '' and null values go to 'misc'.

    Rows are spread over `files_per_key` tasks per partition value: few files, and a value that
    holds most rows isn't written by one task.
    """
    safe = _filed(df, by)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_key))
    spread = safe.withColumn("_salt", salt).repartition(*by, "_salt").drop("_salt")
    spread.write.mode(mode).partitionBy(*by).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_by_subreddit(df: DataFrame, path: str, **options) -> None:
    write_partitioned(df.withColumn("subreddit_dir", dir_name(F.col("subreddit"))), path, ["sanitized_prefix", "subreddit_dir"], **options)


def consolidate(spark: SparkSession, path: str, new: DataFrame, by: list[str], rows_per_file: int = 100_000) -> None:
    """New rows put into their partitions, whose files are rewritten with bounded rows; other partitions aren't read.

    Old and new rows are stored aside before Spark's dynamic overwrite replaces the partitions they belong to, so nothing is
    read from where it is written, and a failed run leaves the old files. '' and null values go to 'misc'.
    """
    rows = _filed(new, by)
    if exists(spark, path):
        touched = rows.select(*by).distinct()
        old = spark.read.schema(rows.schema).parquet(path)
        rows = old.join(F.broadcast(touched), by, "left_semi").select(*rows.columns).unionByName(rows)  # values of one append; prunes partitions
    rows = materialize(rows, "consolidated")
    spread = rows.repartition(*by)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    discard(rows)


def _filed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("misc")) for c in by})


def rewrite(spark: SparkSession, path: str, change, rows_per_file: int = 1_000_000, dry_run: bool = False) -> DataFrame:
    """A table with `change` applied, written beside it and swapped in; a dry run only returns the plan."""
    changed = change(spark.read.parquet(path))
    if dry_run:
        return changed
    staging = f"{path}.staging-{uuid.uuid4().hex[:12]}"
    changed.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(staging)
    swap(spark, staging, path)
    return spark.read.parquet(path)


def insert_new(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't in the target yet, one per key (the least row)."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.distinct()
    return once.join(target.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Old rows replaced or added to by new ones; of several new rows of a key the last by `order` holds."""
    latest = keep_last(new, key, order)
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def keep_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the last by `order`; ties are broken by the whole row."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max(F.struct(order.alias("_order"), *[F.col(c).alias(c) for c in rest])).alias("r"))
    return picked.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Like keep_last for rows whose columns can't be ordered."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def search_docs(plans: DataFrame) -> DataFrame:
    """Documents for the index: _id from plan_id, stamped with the time of writing, last plan per id."""
    stamped = plans.withColumn("_id", F.col("plan_id")).withColumn("generated_at", F.current_timestamp())
    return newest(stamped, ["_id"], [F.desc("cluster_id")])


def snapshot(spark: SparkSession, path: str) -> str:
    """A copy of a table under a versioned name."""
    copy = f"{path}_backup_{int(time.time())}"
    spark.read.parquet(path).write.parquet(copy)
    return copy


def recreate(spark: SparkSession, path: str, mapping: str) -> str:
    """Start a table anew with a schema: its rows go to a versioned copy, come back with the columns of `mapping`, and others are left out.

    Columns that the old rows lack are null. Returns the path of the copy.
    """
    copy = snapshot(spark, path)
    old = spark.read.parquet(copy)
    wanted = StructType.fromDDL(mapping)
    kept = [(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    old.select(*kept).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return copy


def extended(docs: DataFrame, mapping: str) -> tuple[DataFrame, str]:
    """Documents in the columns of a mapping, and the mapping extended: columns it doesn't know are added as text."""
    wanted = StructType.fromDDL(mapping)
    for name in docs.columns:
        if name not in wanted.names:
            wanted = wanted.add(name, "string")
    out = docs.select(*[(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    return out, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted)


def upsert_vectors(spark: SparkSession, path: str, points: DataFrame, key: str = "id", buckets: int = 64) -> None:
    """A vector table (id, unit vector, payload): new points replace old ones of the same id, others stay.

    Vectors are stored at unit length, so a cosine is a dot product; null and zero vectors are left out. Ids are spread over
    `buckets` folders by hash and only the folders of new points are rewritten. Of several new points of an id the last by vector holds.
    """
    n = norm(F.col("vector"))
    ready = points.filter(n > 0).withColumn("vector", normalised(F.col("vector"))).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))
    ready = keep_last(ready, key, F.col("vector"))
    if exists(spark, path):
        old = spark.read.schema(ready.schema).parquet(path)
        here = F.broadcast(ready.select("bucket").distinct())  # no more rows than buckets
        ready = upsert(old.join(here, "bucket", "left_semi").select(*ready.columns), ready, key, F.col("vector"))
    ready = materialize(ready, "points")
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(ready)


def drop_table(spark: SparkSession, path: str, confirm: bool = False) -> bool:
    if not confirm:
        raise ValueError("pass confirm=True to delete a table")
    there = exists(spark, path)
    delete_path(spark, path)
    return there


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def write_ndjson(df: DataFrame, path: str, error: str = "error") -> None:
    """JSON lines of the rows without an error."""
    ok = df.filter(F.col(error).isNull()).drop(error) if error in df.columns else df
    ok.write.mode("overwrite").json(path)
