"""Consolidation of very many small files into few sorted ones."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.runtime import delete_path, discard, filesystem, materialize

RECORD = "id string, rev int, parent_id string, subreddit string, body string, ups long"


def clean_path(c):
    """One spelling of a path: single slashes, no '.' steps, no white space or slash at the end."""
    path = F.regexp_replace(F.trim(c), r"^file:(?://)?(?=/)", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), r"/{2,}", "/")
    return F.regexp_replace(path, r"(?<=.)/$", "")


def parse_records(files: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Complete records of JSON-lines payloads: the RECORD columns and those named in `keep`.

    Lines end with \\n, \\r\\n or \\r; see `parse_lines`. Null and empty payloads give no rows.
    """
    keep = keep or []
    return parse_lines(files.select(*keep, F.explode(F.split(F.col(payload), r"\r\n|\n|\r")).alias("line")), keep)


def parse_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Complete records of JSON lines (column line): the RECORD columns and those named in `keep`.

    A byte-order mark is ignored. A line counts if it holds exactly one complete JSON object with a non-empty
    id; blank, broken and cut-off lines don't. A missing rev is 0. Parsing stays in the JVM.
    """
    keep = keep or []
    lines = lines.select(*keep, F.regexp_replace("line", "^[\\s\ufeff]+|\\s+$", "").alias("line"))
    objects = lines.filter(F.col("line").startswith("{") & F.col("line").endswith("}"))
    # inside an array a second object or other text after the first makes the whole line invalid
    parsed = objects.select(
        *keep,
        F.from_json(
            F.concat(F.lit('[{"r":'), "line", F.lit('}]')),
            f"array<struct<r struct<{_fields()}>, _corrupt string>>",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ).alias("rows"),
    ).filter("size(rows) = 1").select(*keep, F.col("rows")[0]["r"].alias("r"), F.col("rows")[0]["_corrupt"].alias("bad"))
    return (
        parsed.filter("bad is null and r.id is not null and r.id <> ''")
        .select(*keep, "r.*")
        .withColumn("rev", F.coalesce("rev", F.lit(0)))
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl", open_cost: int = 16 << 10) -> DataFrame:
    """Lines (file, line) of a tree of small files.

    Spark packs files into tasks as if each had `open_cost` bytes besides its own; the usual 4 MB would make a task of
    every thirty tiny files.
    """
    spark.conf.set("spark.sql.files.openCostInBytes", str(open_cost))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def compact_files(spark: SparkSession, folder: str, target: str, key: list[str], cluster_by: list[str], target_bytes: int = 256 << 20) -> "Compaction":
    """All records of a tree of small JSON-lines files consolidated by `compact`; the small files stay."""
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        return compact(parse_lines(read_files(spark, folder)), target, key, cluster_by, target_bytes)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def _fields() -> str:
    return ", ".join(":".join(f.strip().split(" ")) for f in RECORD.split(",")).replace(":", " ")


def write_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (path, payload): every row's payload as the file at its path; a repeated task writes the same."""
    made: set[str] = set()
    for batch in batches:
        for path, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, inner = fs.FileSystem.from_uri(path)
            folder = inner.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder)
                made.add(folder)
            with store.open_output_stream(inner, compression=None) as out:
                out.write(payload.encode())
        yield batch.select([0])


@dataclass
class Compaction:
    """What a run did; `target` holds the files, of about `stored_bytes` in all."""

    target: str
    rows: int
    files: int
    stored_bytes: int


def compact(
    records: DataFrame,
    target: str,
    key: list[str],
    cluster_by: list[str],
    target_bytes: int = 256 << 20,
    max_rows: int = 5_000_000,
) -> Compaction:
    """Write each record (by `key`) once into sorted files of about `target_bytes` on disk, then swap.

    Records are range-partitioned by `cluster_by` and `key` with sampled boundaries, so one heavy
    clustering value spreads over several files. Their number comes from the bytes that the records take when stored
    with the same compression, so files are of the target size or, as sorted rows compress better, a bit below. The staging
    folder is swapped in only if it holds as many rows as there are distinct keys; otherwise nothing changes and an
    error is raised. Of differing copies of a key the least row in column order is kept. No records give an
    empty table. Null keys count as a key of their own.
    """
    spark = records.sparkSession
    target = target.rstrip("/")
    recover(spark, target)
    staging = f"{target}.staging-{uuid.uuid4().hex[:12]}"
    rest = [c for c in records.columns if c not in key]
    once = records.groupBy(*key).agg(F.min(F.struct(*rest)).alias("rest")).select(*key, "rest.*")
    once = materialize(once, "records")  # parsed once; measured, sampled and laid out from here
    stored_bytes, total_rows = size_of(spark, once._scratch_path), once.agg(F.count(F.lit(1))).first()[0]
    files = max(1, math.ceil(stored_bytes / target_bytes))
    order = list(dict.fromkeys([*cluster_by, *key]))
    laid_out = once.repartitionByRange(files, *order).sortWithinPartitions(*order)
    (
        laid_out.select(*records.columns).write.mode("overwrite").option("compression", "zstd")
        .option("maxRecordsPerFile", max_rows).parquet(staging)
    )
    discard(once)
    written = spark.read.schema(records.schema).parquet(staging).count()  # footers only
    if written != total_rows:
        delete_path(spark, staging)
        raise RuntimeError(f"{staging} held {written} rows, {total_rows} were expected; nothing was swapped")
    swap(spark, staging, target)
    return Compaction(target, written, files, size_of(spark, target))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a folder."""
    hdfs, hadoop_path = filesystem(spark, path)
    return hdfs.getContentSummary(hadoop_path(path)).getLength()


def swap(spark: SparkSession, staging: str, target: str) -> None:
    """Put `staging` in the place of `target` by two renames; on failure the old folder comes back.

    A driver that dies between the renames leaves the old folder under another name, which `recover` puts back.
    """
    hdfs, hadoop_path = filesystem(spark, target)
    new, live = hadoop_path(staging), hadoop_path(target)
    old = hadoop_path(f"{target}.old-{uuid.uuid4().hex[:12]}")
    had = hdfs.exists(live)
    if had and not hdfs.rename(live, old):
        raise RuntimeError(f"could not move {target} aside")
    if not hdfs.rename(new, live):
        if had:
            hdfs.rename(old, live)
        raise RuntimeError(f"could not move {staging} to {target}")
    if had:
        hdfs.delete(old, True)


def recover(spark: SparkSession, target: str) -> bool:
    """Put back the folder that an interrupted `swap` moved aside; True if there was one to put back."""
    hdfs, hadoop_path = filesystem(spark, target)
    if hdfs.exists(hadoop_path(target)):
        return False
    left = hdfs.globStatus(hadoop_path(f"{target}.old-*"))
    return bool(left) and hdfs.rename(left[0].getPath(), hadoop_path(target))
