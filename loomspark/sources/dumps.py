"""Raw forum dumps: JSON lines, plain or zstd-compressed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import schemas
from loomspark.runtime import filesystem


def discover(spark: SparkSession, folder: str, kind_rule: str = "prefix", done: DataFrame | None = None) -> DataFrame:
    """(path, name, size, kind) of .zst and .jsonl files below a folder, without reading contents.

    kind_rule 'prefix': RS* are submissions, RC* comments, others are left out. 'path': a .jsonl file is a
    submission if its path has 'submission' in it, else a comment; .zst files go by prefix and may be 'unknown'.
    Paths in `done` (column path) are left out.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
        .filter(F.lower("name").rlike(r"\.(zst|jsonl)$"))
    )
    by_prefix = F.when(F.col("name").startswith("RS"), "submission").when(F.col("name").startswith("RC"), "comment")
    if kind_rule == "prefix":
        found = files.withColumn("kind", by_prefix).filter("kind is not null")
    elif kind_rule == "path":
        by_path = F.when(F.lower("path").contains("submission"), "submission").otherwise("comment")
        found = files.withColumn("kind", F.when(F.col("name").endswith(".jsonl"), by_path).otherwise(F.coalesce(by_prefix, F.lit("unknown"))))
    else:
        raise ValueError(kind_rule)
    return found.join(done.select("path"), "path", "left_anti") if done is not None else found


def pick_files(files: DataFrame, only: list[str] | None = None, without: list[str] | None = None, year: str = "", not_month: str = "") -> DataFrame:
    """Files by allow list, deny list, year and excluded month in their names."""
    out = files
    if only:
        out = out.filter(F.col("name").isin(only))
    if without:
        out = out.filter(~F.col("name").isin(without))
    if year:
        out = out.filter(F.col("name").contains(year))
    if not_month:
        out = out.filter(~F.col("name").contains(not_month))
    return out


def read_lines(spark: SparkSession, paths: str | list[str], parts: int = 0, keep_damaged: bool = True) -> DataFrame:
    """One row per line, invalid UTF-8 replaced; `.zst` files with windows of up to 2^31 bytes, others as Spark's text source reads them.

    A compressed file is one task, which streams it in bounded pieces; `parts` spreads its lines afterwards.
    `keep_damaged` keeps the lines before the break in a truncated file instead of failing.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    packed, plain = [p for p in names if p.endswith(".zst")], [p for p in names if not p.endswith(".zst")]
    out = None
    if plain or not packed:
        text = spark.read.option("ignoreCorruptFiles", str(keep_damaged).lower()).text(plain)
        out = text.select(F.make_valid_utf8("value").alias("line"))
    if packed:
        # a glob or folder is listed first; the contents aren't read for it
        files = spark.read.format("binaryFile").load(packed).select("path")
        lines = files.repartition(len(packed), "path").mapInArrow(_unpacked(keep_damaged), "line string")
        out = lines if out is None else out.unionByName(lines)
    return out.repartition(parts) if parts else out


def _unpacked(keep_damaged: bool, piece: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as packed:
                    reader = zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(packed, read_across_frames=True)
                    rest = b""
                    while True:
                        try:
                            data = reader.read(piece)
                        except zstandard.ZstdError:
                            if not keep_damaged:
                                raise
                            rest, data = b"", b""  # the line at the break is not whole
                        if not data:
                            break
                        *lines, rest = (rest + data).split(b"\n")
                        yield _batch(lines)
                    if rest:
                        yield _batch([rest])

    return run


def _batch(lines: list[bytes]) -> pa.RecordBatch:
    texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["line"])


def write_lines(lines: DataFrame, folder: str, name: str, pack: bool = False) -> None:
    """Text lines (column value) as files `name-part.jsonl`, or `name-part.zst` with `pack`, of a new folder.

    Names are changed after Spark's commit, as readers of dumps go by names; packing is done per file in the tasks.
    """
    spark = lines.sparkSession
    lines.select("value").write.mode("errorifexists").text(folder)
    hdfs, hadoop_path = filesystem(spark, folder)
    named = []
    for status in hdfs.listStatus(hadoop_path(folder)):
        old = status.getPath().getName()
        if old.startswith("part-"):
            new = hadoop_path(f"{folder}/{name}-{old.split('-')[1]}.jsonl")
            hdfs.rename(status.getPath(), new)
            named.append((hdfs.makeQualified(new).toString(),))
    if pack and named:
        files = spark.createDataFrame(named, "path string").repartition(len(named), "path")
        files.mapInArrow(_pack, "path string").count()
        for (path,) in named:
            hdfs.delete(hadoop_path(path), False)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inner = fs.FileSystem.from_uri(path)
            target = inner.removesuffix(".jsonl") + ".zst"
            with store.open_input_stream(inner, compression=None) as source, store.open_output_stream(target + ".writing", compression=None) as out:
                zstandard.ZstdCompressor().copy_stream(source, out)
            store.move(target + ".writing", target)  # a repeated task replaces the file as a whole
        yield batch


def parse_items(lines: DataFrame, schema: str = schemas.RAW_ITEM) -> DataFrame:
    """Typed items; lines that are no JSON object, and blank lines, are dropped; unknown fields ignored."""
    parsed = lines.filter(F.trim("line").startswith("{")).select(
        F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    return parsed.select("r.*").filter("_bad is null").drop("_bad")


def read_json(spark: SparkSession, path: str, schema: str = schemas.RAW_ITEM, max_items: int | None = None) -> DataFrame:
    """.jsonl, .ndjson and .zst by line; .json as one document; at most `max_items` rows if given."""
    if path.endswith(".json"):
        out = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    else:
        out = parse_items(read_lines(spark, path), schema)
    return out.limit(max_items) if max_items is not None else out
