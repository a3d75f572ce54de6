"""Work queues as streams: enqueue, consume with a model, write back; resumable and idempotent."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import schemas
from loomspark.operators import inference, writeback
from loomspark.operators.delivery import SeenRegistry
from loomspark.operators.messages import nlp_candidates
from loomspark.sources.sinks import exists


def enqueue(messages: DataFrame, path: str, file_path: str = "", rows_per_file: int = 10_000) -> None:
    """Unclassified candidates as NlpJob files; the order of jobs doesn't matter to any consumer."""
    jobs = nlp_candidates(messages).select(F.lit(file_path).alias("file_path"), F.col("id").alias("row_id"), F.col("body").alias("text"))
    jobs.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def enqueue_slowly(messages: DataFrame, path: str, backlog: Callable[[], int], rows_per_push: int = 1_000_000, most: int = 50_000, wait: float = 1.0, file_path: str = "") -> int:
    """Like `enqueue`, in pushes of about `rows_per_push` rows, each after `backlog()` has come down to `most`. Returns the pushes.

    A file queue needs no brake for its consumer's sake (see `consume`); this one keeps the queue's size in bounds.
    """
    pushes = max(1, -(-nlp_candidates(messages).count() // rows_per_push))
    for k in range(pushes):
        while backlog() > most:
            time.sleep(wait)
        enqueue(messages.filter(F.pmod(F.xxhash64("id"), F.lit(pushes)) == k), path, file_path)
    return pushes


def backlog(spark: SparkSession, queue: str, results: str) -> int:
    """Jobs of the queue folder without a result yet; counted from the files' footers."""
    total = spark.read.parquet(queue).count() if exists(spark, queue) else 0
    return total - (spark.read.parquet(results).count() if exists(spark, results) else 0)


def drain(query) -> None:
    """Let a running query finish what has arrived, then stop it; a restart goes on from its checkpoint."""
    query.processAllAvailable()
    query.stop()


def consume(spark: SparkSession, queue: str, results: str, checkpoint: str, scorer=inference.keyword_scorer, files_per_batch: int = 100, schema: str = schemas.NLP_JOB, archive: str = ""):
    """Classify queued jobs into a results folder until the queue is empty; restarts go on where they ended.

    With `archive`, a folder outside the queue, files that are done are moved there.

    `files_per_batch` is the back-pressure. Each micro-batch is written by Spark's exactly-once file sink.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    jobs = reader.parquet(queue)
    scored = inference.classify(jobs, "row_id", "text", scorer)
    return scored.writeStream.format("parquet").option("path", results).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_back_stream(spark: SparkSession, results: str, state: str, checkpoint: str, apply: Callable[[DataFrame, int], None], files_per_batch: int = 100):
    """Hand every result row on once, however often it was delivered or its batch is repeated.

    `apply(rows, batch)` gets the rows whose row_id hasn't been seen in any batch; it may be called again with
    the same rows after a failure, so it has to be a replacing write, e.g. to a path of the batch.
    """
    registry = SeenRegistry(spark, state)

    def each(batch: DataFrame, number: int) -> None:
        fresh = registry.admit(batch, F.col("row_id"), [F.col("nlp_score"), F.col("nlp_label")], f"batch-{number}")
        apply(fresh.drop("ident", "arrivals"), number)

    stream = spark.readStream.schema("row_id string, nlp_label string, nlp_score float").option("maxFilesPerTrigger", files_per_batch).parquet(results)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, messages: DataFrame, applied: str) -> DataFrame:
    """Messages with all results that have been handed on so far."""
    return writeback.write_back(messages, spark.read.parquet(f"{applied}/*")) if exists(spark, applied) else messages


def deduplicated(events: DataFrame, id_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """A stream without repetitions that arrive within `delay` of each other in event time."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def depth(query) -> int:
    """Rows read in the last micro-batch of a running query."""
    progress = query.lastProgress
    return int(progress["numInputRows"]) if progress else 0


def peek(spark: SparkSession, queue: str, n: int = 10) -> DataFrame:
    return spark.read.parquet(queue).orderBy("row_id").limit(n)
