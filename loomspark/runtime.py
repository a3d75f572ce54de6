"""Session, table access and shared scratch space."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # partition values such as mmyy=0124 must stay strings
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; `master` only for local runs."""
    builder = SparkSession.builder.appName("loomspark")
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch_base(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"loomspark-{os.getpid()}")
    return "file://" + own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{_scratch_base(spark)}/loomspark-{label}-{uuid.uuid4().hex}"
    atexit.register(_quiet_delete, spark, path)
    return path


def filesystem(spark: SparkSession, path: str):
    """(Hadoop FileSystem, Path class) for a path on any supported store."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    return hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = filesystem(spark, path)
    fs.delete(hadoop_path(path), True)


def _quiet_delete(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the JVM may already be gone at exit
        pass


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content; False, and nothing done, if there is one already.

    The content is complete when the file appears. Two writers can't both succeed: a hard link on a local or mounted
    folder, elsewhere a rename that refuses an existing target, which the store has to do in one step, as HDFS does.
    """
    fs, hadoop_path = filesystem(spark, path)
    folder, _, name = path.rpartition("/")
    draft = hadoop_path(f"{folder}/.draft-{name}-{uuid.uuid4().hex}")
    fs.mkdirs(hadoop_path(folder))
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), hadoop_path(path).toUri().getPath())
                return True
            except FileExistsError:
                return False
        jvm = spark._jvm
        none = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, hadoop_path(path), none)
            return True
        except Exception:
            if fs.exists(hadoop_path(path)):
                return False
            raise
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, hadoop_path = filesystem(spark, path)
    stream = fs.open(hadoop_path(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator["Scope"]:
    """Tables materialised within are deleted at the end, but for those that were kept."""
    scope = Scope()
    _scopes.append(scope.paths)
    try:
        yield scope
    finally:
        _scopes.remove(scope.paths)
        for path in scope.paths:
            if path in scope.kept:
                if _scopes:
                    _scopes[-1].append(path)  # the scope around this one may drop it
            else:
                _quiet_delete(spark, path)


class Scope:
    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` is a materialised table that outlives the scope."""
        self.kept.add(df._scratch_path)
        return df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors."""
    path = scratch_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    stored = spark_write(df, path)
    stored._scratch_path = path
    return stored


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _quiet_delete(df.sparkSession, path)


def spark_write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
