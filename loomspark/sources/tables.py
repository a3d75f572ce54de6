"""Scans of Parquet and CSV folders."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import glob_match
from loomspark.runtime import filesystem


def scan(spark: SparkSession, paths: str | list[str], by_name: bool = False, deep: bool = False, skip_damaged: bool = False) -> DataFrame:
    """Parquet files, a list, glob or tree of them; `by_name` unites differing columns."""
    reader = spark.read.option("mergeSchema", str(by_name).lower()).option("ignoreCorruptFiles", str(skip_damaged).lower())
    if deep:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def with_file(df: DataFrame, column: str = "filename") -> DataFrame:
    return df.withColumn(column, F.col("_metadata.file_path"))


def catalog(df: DataFrame, column: str = "subreddit", pattern: str = "") -> DataFrame:
    """Distinct partition values in order, optionally those matching a shell pattern."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return (found.filter(glob_match(F.col(column), pattern)) if pattern else found).orderBy(column)


def merge_csv(spark: SparkSession, folder: str, target: str, pattern: str = "part-*.csv") -> None:
    """CSV part files with a header as one folder with one file; for exports that fit one task."""
    spark.read.option("header", "true").csv(f"{folder}/{pattern}").coalesce(1).write.mode("overwrite").option("header", "true").csv(target)


def inspect(df: DataFrame, rows: int = 2) -> dict:
    return {"schema": df.schema.simpleString(), "columns": len(df.columns), "rows": df.count(), "head": df.take(rows)}


def folder_catalog(spark: SparkSession, folder: str, pattern: str = "") -> list[str]:
    """Names of a two-level or flat layout in order, from folder names alone: no file is opened.

    A folder of one or two characters without Parquet files in it is a partition, whose folders count. `name=value`
    folders count by their value.
    """
    fs, hadoop_path = filesystem(spark, folder)

    def inside(path) -> list:
        return [s for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]

    found = set()
    for status in inside(hadoop_path(folder)):
        if not status.isDirectory():
            continue
        name = status.getPath().getName().rpartition("=")[2]
        if len(name) <= 2:
            below = inside(status.getPath())
            if not any(s.getPath().getName().endswith(".parquet") for s in below):
                found |= {s.getPath().getName().rpartition("=")[2] for s in below if s.isDirectory()}
                continue
        found.add(name)
    return sorted(n for n in found if not pattern or fnmatch(n.lower(), pattern.lower()))


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of all files of a tree, as the driver lists them for any scan."""
    fs, hadoop_path = filesystem(spark, folder)
    listing, rows = fs.listFiles(hadoop_path(folder), True), []
    while listing.hasNext():
        status = listing.next()
        rows.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return spark.createDataFrame(rows, "path string, size long, modified long")


def _footer_fault(path: str, size: int) -> str | None:
    from pyarrow import fs, parquet

    if size == 0:
        return "empty"
    store, inner = fs.FileSystem.from_uri(path)
    try:
        with store.open_input_file(inner) as file:
            parquet.read_metadata(file)
        return None
    except Exception as e:
        return str(e)[:200] or type(e).__name__


def _checked(files: DataFrame) -> DataFrame:
    """Files with `reason`: why their footer can't be read, or null. Tasks read the footers only, whatever the size."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(reason=[_footer_fault(p, n) for p, n in zip(pdf["path"], pdf["size"])])

    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInPandas(run, "path string, size long, modified long, reason string")


def damaged_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, reason) of Parquet files that are empty or whose footer can't be read; nothing is changed."""
    parquet = _listing(spark, folder).filter(F.col("path").endswith(".parquet"))
    return _checked(parquet).filter("reason is not null").select("path", "size", "reason")


def repair(spark: SparkSession, folder: str, fix: bool = False) -> list[tuple[str, str]]:
    """(path, what is done) for damaged files and leftovers named `file.parquet.tmp.*`; only `fix` changes anything.

    A damaged or missing file is 'restored' from its newest leftover if that one can be read, else a damaged file is 'deleted'. Leftovers
    that aren't used are 'deleted' too.
    """
    files = _listing(spark, folder).filter(F.col("path").rlike(r"\.parquet(?:\.tmp\.[^/]*)?$"))
    checked = _checked(files).select("path", "modified", "reason", F.regexp_extract("path", r"^(.*?\.parquet)(?:\.tmp\.|$)", 1).alias("target"))
    left, own = checked.filter("path <> target"), checked.filter("path = target")
    newest = left.groupBy("target").agg(F.max(F.struct("modified", "path", "reason")).alias("n")).select("target", "n.path", "n.reason")
    state = own.select("target", F.lit(True).alias("there"), F.col("reason").alias("own")).join(newest, "target", "full")
    # only files with something to do come to the driver, which does it
    todo = state.filter("own is not null or path is not null").toLocalIterator()
    fs, hadoop_path = filesystem(spark, folder)
    done: list[tuple[str, str]] = []
    restored = set()
    for r in todo:
        if (r.there is None or r.own is not None) and r.path is not None and r.reason is None:
            restored.add(r.path)
            done.append((r.target, "restored"))
            if fix:
                fs.delete(hadoop_path(r.target), False)
                fs.rename(hadoop_path(r.path), hadoop_path(r.target))
        elif r.own is not None:
            done.append((r.target, "deleted"))
            if fix:
                fs.delete(hadoop_path(r.target), False)
    for r in files.filter(F.col("path").contains(".parquet.tmp.")).select("path").toLocalIterator():
        if r.path not in restored:
            done.append((r.path, "deleted"))
            if fix:
                fs.delete(hadoop_path(r.path), False)
    return sorted(done)
