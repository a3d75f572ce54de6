"""Per-key results that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = (
    "slice int, {keys}, n long, total double, first_at long, last_at long, max_gap long, sessions long"
)


def slices(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """Rows range-partitioned by (keys, order): sampled quantiles split a heavy key over slices.

    Rows of a slice are sorted, slices follow each other in key order, and all hold about as
    many rows, whatever a key's share is.
    """
    return df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)


def key_timelines(
    df: DataFrame,
    keys: list[str],
    at: str,
    value: str,
    parts: int | None = None,
    session_gap_s: int = 3600,
    tie: list[str] | None = None,
) -> DataFrame:
    """Per key: rows, sum of `value`, first and last time, longest pause, number of sessions.

    `keys` are string columns, `at` is a timestamp, `value` numeric. Null keys form a group; null
    values count 0; rows with null time count in n and total, not in pauses or sessions (a key of
    only such rows has null times and 0 sessions). A pause over `session_gap_s` starts a session.
    Other columns are ignored. Every slice folds its runs to one state per key, so a heavy key
    is worked on by many tasks; the states of slices are then stitched in slice order, where the
    pause between the end of one slice and the start of the next is added.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = tie or []
    slim = df.select(
        *keys, F.unix_micros(F.col(at)).alias("at_us"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("val"), *[F.col(t) for t in tie],
    )
    ranged = slices(slim, keys, ["at_us", *tie], parts).select(
        F.spark_partition_id().alias("slice"), *keys, "at_us", "val"
    )
    gap_us = session_gap_s * 1_000_000
    schema = STATE.format(keys=", ".join(f"`{k}` string" for k in keys))
    states = ranged.mapInArrow(_fold_runs(keys, gap_us), schema)
    piece = F.struct("slice", "first_at", "last_at", "max_gap", "sessions")
    grouped = states.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        # at most one state per slice, so the list is bounded by the number of slices
        F.sort_array(F.collect_list(F.when(F.col("first_at").isNotNull(), piece))).alias("pieces"),
    )
    zero = F.expr(
        "named_struct('last', cast(null as bigint), 'gap', cast(null as bigint), 'sessions', 0L)"
    )

    def stitch(acc, x):
        pause = x["first_at"] - acc["last"]
        return F.struct(
            x["last_at"].alias("last"),
            F.greatest(acc["gap"], x["max_gap"], pause).alias("gap"),
            (acc["sessions"] + x["sessions"] - F.when(pause <= gap_us, 1).otherwise(0)).alias("sessions"),
        )

    folded = F.aggregate("pieces", zero, stitch)
    return grouped.withColumn("fold", folded).select(
        *keys, "n", "total",
        F.timestamp_micros(F.try_element_at("pieces", F.lit(1))["first_at"]).alias("first_at"),
        F.timestamp_micros("fold.last").alias("last_at"),
        (F.col("fold.gap") / 1e6).alias("max_gap_s"),
        F.col("fold.sessions").alias("sessions"),
    )


def heavy_keys(counts: DataFrame, group: str, share: float) -> DataFrame:
    """Rows of `counts` whose n is at least `share` of all n of the same group."""
    totals = counts.groupBy(group).agg(F.sum("n").alias("all_n"))
    return counts.join(totals, group).filter(F.col("n") >= F.col("all_n") * share)


def lookup(rows: DataFrame, table: DataFrame, key: str, load: str = "load", heavy_rows: int = 100_000) -> DataFrame:
    """Inner join of rows with a table of unique keys whose column `load` tells how many rows each key has.

    Keys with over `heavy_rows` rows, and over a thousandth of all rows, are broadcast: there are fewer than a
    thousand of them, whatever the size. The rest is joined by shuffle, where no key is heavy. The join's
    result has the columns of both but `load`. Null keys match nothing.
    """
    total = table.agg(F.sum(load)).first()[0] or 0
    is_heavy = F.col(load) > F.lit(max(heavy_rows, total / 1000))
    heavy, light = table.filter(is_heavy).drop(load), table.filter(~is_heavy).drop(load)
    if heavy.isEmpty():
        return rows.join(table.drop(load), key)
    spread = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return spread.unionByName(rest)


def _fold_runs(keys: list[str], gap_us: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = None  # the last run of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            states = _runs(batch, keys, gap_us)
            if open_run is not None:
                if _same_key(open_run, states[0], keys):
                    states[0] = _join(open_run, states[0], gap_us)
                else:
                    states.insert(0, open_run)
            open_run = states.pop()
            if states:
                yield _to_batch(states, keys)
        if open_run is not None:
            yield _to_batch([open_run], keys)

    return fold


def _runs(batch: pa.RecordBatch, keys: list[str], gap_us: int) -> list[dict]:
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        col = batch.column(k)
        col = pc.dictionary_encode(col, null_encoding="encode")
        codes = col.indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    at_col = batch.column("at_us")
    has = at_col.is_valid().to_numpy(zero_copy_only=False)
    at = pc.fill_null(at_col, 0).to_numpy(zero_copy_only=False)
    val = batch.column("val").to_numpy(zero_copy_only=False)
    pause = np.zeros(n, dtype=np.int64)
    pause[1:] = at[1:] - at[:-1]
    ok = np.zeros(n, dtype=bool)
    ok[1:] = has[1:] & has[:-1] & ~new[1:]
    sums = np.add.reduceat(val, starts)
    cuts = np.add.reduceat((ok & (pause > gap_us)).astype(np.int64), starts)
    longest = np.maximum.reduceat(np.where(ok, pause, -1), starts)
    valid = np.add.reduceat(has.astype(np.int64), starts)
    names = {k: batch.column(k).take(pa.array(starts)).to_pylist() for k in keys}
    slice_no = batch.column("slice")[0].as_py()
    out = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        state = {k: names[k][i] for k in keys}
        # null times sort first, so the valid ones are the run's tail
        first = b - valid[i]
        some = valid[i] > 0
        state |= {
            "slice": slice_no, "n": int(b - a), "total": float(sums[i]),
            "first_at": int(at[first]) if some else None, "last_at": int(at[b - 1]) if some else None,
            "max_gap": int(longest[i]) if longest[i] >= 0 else None,
            "sessions": int(cuts[i]) + 1 if some else 0,
        }
        out.append(state)
    return out


def _same_key(a: dict, b: dict, keys: list[str]) -> bool:
    return all(a[k] == b[k] for k in keys)


def _join(a: dict, b: dict, gap_us: int) -> dict:
    both = a["last_at"] is not None and b["first_at"] is not None
    pause = b["first_at"] - a["last_at"] if both else None
    gaps = [g for g in (a["max_gap"], b["max_gap"], pause) if g is not None]
    return b | {
        "n": a["n"] + b["n"], "total": a["total"] + b["total"],
        "first_at": a["first_at"] if a["first_at"] is not None else b["first_at"],
        "last_at": b["last_at"] if b["last_at"] is not None else a["last_at"],
        "max_gap": max(gaps, default=None),
        "sessions": a["sessions"] + b["sessions"] - (1 if both and pause <= gap_us else 0),
    }


def _to_batch(states: list[dict], keys: list[str]) -> pa.RecordBatch:
    schema = pa.schema(
        [("slice", pa.int32()), *[(k, pa.string()) for k in keys], ("n", pa.int64()), ("total", pa.float64()),
         ("first_at", pa.int64()), ("last_at", pa.int64()), ("max_gap", pa.int64()), ("sessions", pa.int64())]
    )
    return pa.RecordBatch.from_pylist(states, schema=schema)
