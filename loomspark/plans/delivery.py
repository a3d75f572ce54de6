"""p4 to p7: queues, skewed keys, small files and hierarchies, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import bare_id
from loomspark.operators import compaction, hierarchy, skew
from loomspark.operators.delivery import SeenRegistry
from loomspark.runtime import discard, filesystem, materialize, scratch_path, table


WAVES = 3  # groups of consecutive batches that p4's queries take in one after the other


def _intake(spark: SparkSession, arrivals: DataFrame, order: list, label: str) -> tuple[SeenRegistry, list[str]]:
    """Batches of (queue_name, row_id, batch_id, ...) admitted in the order of batch_id, in WAVES groups of about as many rows.

    All queues share the dictionary; each has bits of its own. Rows without batch come first.
    """
    registry = SeenRegistry(spark, scratch_path(spark, f"seen-{label}"))
    shares = F.array(*[F.lit(k / WAVES) for k in range(1, WAVES)])
    cuts = arrivals.groupBy("queue_name").agg(F.percentile_approx("batch_id", shares).alias("cuts"))  # one row per queue
    wave = F.size(F.filter("cuts", lambda c: F.col("batch_id") > c))
    numbered = materialize(arrivals.join(F.broadcast(cuts), "queue_name").withColumn("wave", F.greatest(wave, F.lit(0))).drop("cuts"), f"{label}-waves")
    tokens = [f"wave-{k}" for k in range(WAVES)]
    for k, token in enumerate(tokens):
        registry.admit(numbered.filter(F.col("wave") == k).drop("wave"), bare_id(F.col("row_id")), [F.col("batch_id"), *order], token, F.col("queue_name"))
    discard(numbered)
    return registry, tokens


def _decisions(registry: SeenRegistry, tokens: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [registry.decided(t) for t in tokens])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "nlp_jobs").select(F.lit("job").alias("queue_name"), "row_id", F.col("sent_at").alias("at"), "batch_id")
    results = table(spark, sf_dir, "nlp_results").select(F.lit("result").alias("queue_name"), "row_id", F.col("delivered_at").alias("at"), "batch_id")
    registry, tokens = _intake(spark, jobs.unionByName(results), [F.col("at")], "found")
    # delivered again: refused for its bit, or several times in the group of batches that set it
    again = _decisions(registry, tokens).filter("seen or arrivals > 1")
    return again.select(F.col("space").alias("queue_name"), F.col("ident").alias("row_id")).distinct()


def _admitted(registry: SeenRegistry, tokens: list[str]) -> DataFrame:
    """The one row handed out per identifier, `arrivals` being all its deliveries."""
    decisions = _decisions(registry, tokens)
    refused = decisions.filter("seen").groupBy("ident").agg(F.sum("arrivals").alias("more"))
    return decisions.filter("not seen").join(refused, "ident", "left").withColumn("arrivals", F.col("arrivals") + F.coalesce("more", F.lit(0)))


def p4_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "nlp_jobs").withColumn("queue_name", F.lit("job"))
    order = [F.col(c) for c in ("sent_at", "file_path", "text", "row_id")]
    return _admitted(*_intake(spark, jobs, order, "jobs")).select(F.col("ident").alias("row_id"), "file_path", "text", "batch_id", "sent_at", "arrivals")


def p4_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "nlp_results").withColumn("queue_name", F.lit("result"))
    order = [F.col(c) for c in ("delivered_at", "file_path", "row_id")]
    return _admitted(*_intake(spark, results, order, "results")).select(F.col("ident").alias("row_id"), "nlp_label", "batch_id", "delivered_at", "arrivals")


_BARE = r"regexp_replace(lower(regexp_replace(row_id, '[\s\p{Z}\p{Cf}]+', '', 'g')), '^t\d_', '')"

P4_SQL = {
    "p4_found": f"""
        WITH q AS (SELECT 'job' AS queue_name, {_BARE} AS row_id FROM nlp_jobs
                   UNION ALL SELECT 'result', {_BARE} FROM nlp_results)
        SELECT queue_name, row_id FROM q WHERE row_id <> ''
        GROUP BY queue_name, row_id HAVING count(*) > 1""",
    "p4_jobs": f"""
        WITH q AS (SELECT {_BARE} AS ident, *, count(*) OVER (PARTITION BY {_BARE}) AS arrivals,
                     row_number() OVER (PARTITION BY {_BARE} ORDER BY batch_id NULLS FIRST, sent_at, file_path, text, row_id) AS nth
                   FROM nlp_jobs WHERE {_BARE} <> '')
        SELECT ident AS row_id, file_path, text, batch_id, sent_at, arrivals FROM q WHERE nth = 1""",
    "p4_results": f"""
        WITH q AS (SELECT {_BARE} AS ident, *, count(*) OVER (PARTITION BY {_BARE}) AS arrivals,
                     row_number() OVER (PARTITION BY {_BARE} ORDER BY batch_id NULLS FIRST, delivered_at, file_path, row_id) AS nth
                   FROM nlp_results WHERE {_BARE} <> '')
        SELECT ident AS row_id, nlp_label, batch_id, delivered_at, arrivals FROM q WHERE nth = 1""",
}


def _timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "all_messages").select("id", "subreddit", "subreddit_prefix", "created_utc", "ups")
    long = messages.select(
        "id", "created_utc", "ups",
        F.explode(
            F.array(
                F.struct(F.lit("subreddit").alias("key_column"), F.col("subreddit").alias("key_value")),
                F.struct(F.lit("subreddit_prefix").alias("key_column"), F.col("subreddit_prefix").alias("key_value")),
            )
        ).alias("k"),
    ).select("id", "created_utc", "ups", "k.*")
    return skew.key_timelines(long, ["key_column", "key_value"], "created_utc", "ups", tie=["id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_key = materialize(_timelines(spark, sf_dir), "timelines")  # one row per key
    return skew.heavy_keys(per_key, "key_column", 0.04).filter("key_value is not null").select("key_column", "key_value")


def p5_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timelines(spark, sf_dir).withColumn("total", F.col("total").cast("long"))


P5_SQL = {
    "p5_found": """
        WITH k AS (SELECT 'subreddit' AS key_column, subreddit AS key_value FROM all_messages
                   UNION ALL SELECT 'subreddit_prefix', subreddit_prefix FROM all_messages)
        SELECT key_column, key_value FROM k WHERE key_value IS NOT NULL GROUP BY key_column, key_value
        HAVING count(*) >= 0.04 * (SELECT count(*) FROM all_messages)""",
    "p5_timelines": """
        WITH k AS (SELECT 'subreddit' AS key_column, subreddit AS key_value, created_utc, ups FROM all_messages
                   UNION ALL SELECT 'subreddit_prefix', subreddit_prefix, created_utc, ups FROM all_messages),
        g AS (SELECT *, epoch_us(created_utc) - epoch_us(lag(created_utc)
                OVER (PARTITION BY key_column, key_value ORDER BY created_utc NULLS FIRST)) AS pause FROM k)
        SELECT key_column, key_value, count(*) AS n, CAST(coalesce(sum(ups), 0) AS BIGINT) AS total,
          min(created_utc) AS first_at, max(created_utc) AS last_at, max(pause) / 1e6 AS max_gap_s,
          CAST(count(*) FILTER (pause > 3600000000) + CASE WHEN count(created_utc) > 0 THEN 1 ELSE 0 END AS BIGINT) AS sessions
        FROM g GROUP BY key_column, key_value""",
}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "compacted")
    compact_chain_files(spark, sf_dir, target)
    return spark.read.parquet(target).select(F.col("id").alias("record_id"), "rev")


def compact_chain_files(spark: SparkSession, sf_dir: str, target: str) -> compaction.Compaction:
    """Files named by the embedding jobs, consolidated by subreddit and id."""
    wanted = table(spark, sf_dir, "embedding_jobs").select(compaction.clean_path(F.col("input_path")).alias("path")).distinct()
    files = table(spark, sf_dir, "chain_files").select(compaction.clean_path(F.col("input_path")).alias("path"), "payload")
    records = compaction.parse_records(files.join(wanted, "path", "left_semi"))
    return compaction.compact(records, target, ["id", "rev"], ["subreddit"])


def p6_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from real small files: the payloads are written out, one file each, found and read again."""
    base = scratch_path(spark, "small-files")
    filesystem(spark, base)[0].mkdirs(filesystem(spark, base)[1](base))
    rows = table(spark, sf_dir, "chain_files").filter("payload is not null").select(F.concat(F.lit(f"{base}/"), F.col("file_no") % 50, F.lit("/"), "file_no", F.lit(".jsonl")).alias("path"), "payload")
    rows.mapInArrow(compaction.write_each, "path string").count()
    target = scratch_path(spark, "compacted-files")
    compaction.compact_files(spark, base, target, ["id", "rev"], ["subreddit"])
    return spark.read.parquet(target).select(F.col("id").alias("record_id"), "rev")


_RECORDS = r"""
        WITH l AS (SELECT unnest(regexp_split_to_array(replace(payload, chr(65279), ''), '\r\n|\n|\r')) AS line FROM chain_files),
        j AS (SELECT CASE WHEN json_valid(line) AND trim(line) LIKE '{%' THEN CAST(line AS JSON) END AS o FROM l)
        SELECT DISTINCT o->>'id' AS record_id, CAST(coalesce(o->>'rev', '0') AS INTEGER) AS rev
        FROM j WHERE o IS NOT NULL AND coalesce(o->>'id', '') <> ''"""
P6_SQL = {"p6_found": _RECORDS, "p6_from_files": _RECORDS}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.message_forest(table(spark, sf_dir, "all_messages")).select(
        F.col("id").alias("message_id"), F.col("state").alias("chain_state"), F.col("top").alias("top_id"), "hops"
    )


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.paths(hierarchy.message_forest(table(spark, sf_dir, "all_messages")))
    return found.select(F.col("id").alias("message_id"), F.array_join("path", "/").alias("path"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.paths(hierarchy.message_forest(table(spark, sf_dir, "all_messages")))
    return hierarchy.descendants(found).groupBy(F.col("ancestor").alias("message_id")).agg(
        F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"),
        F.max("descendant").alias("last_descendant"),
    )


def p7_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.cycles(hierarchy.message_forest(table(spark, sf_dir, "all_messages")))
    return found.groupBy(F.col("cycle").alias("cycle_id")).agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.when(F.col("back"), F.col("id"))).alias("back_edge_from"))


_UP = r"""
        WITH RECURSIVE m AS (SELECT id, min(nullif(regexp_replace(trim(parent_id), '^[tT]\d_', ''), '')) AS parent
                             FROM all_messages WHERE id <> '' GROUP BY id),
        w(id, cur, hops, trail) AS (
          SELECT id, id, 0, [id] FROM m
          UNION ALL
          SELECT w.id, m.parent, w.hops + 1, list_append(w.trail, m.parent)
          FROM w JOIN m ON m.id = w.cur JOIN m p ON p.id = m.parent WHERE NOT list_contains(w.trail, m.parent)),
        z AS (SELECT w.*, m.parent, row_number() OVER (PARTITION BY w.id ORDER BY hops DESC) AS last
              FROM w JOIN m ON m.id = w.cur),
        e AS (SELECT id, cur, hops, trail, parent,
                CASE WHEN parent IS NULL THEN 'complete' WHEN list_contains(trail, parent) THEN 'cycle' ELSE 'broken' END AS state
              FROM z WHERE last = 1)"""

P7_SQL = {
    "p7_found": _UP + """
        SELECT id AS message_id, state AS chain_state,
          CASE WHEN state = 'cycle' THEN list_min(trail[list_position(trail, parent):]) ELSE cur END AS top_id,
          CASE WHEN state = 'cycle' THEN -1 ELSE hops END AS hops FROM e""",
    "p7_cycles": _UP + """
        SELECT list_min(trail) AS cycle_id, count(*) AS n_nodes, max(CASE WHEN m.parent = list_min(trail) THEN e.id END) AS back_edge_from
        FROM e JOIN m USING (id) WHERE state = 'cycle' AND list_position(trail, e.parent) = 1 GROUP BY 1""",
    "p7_paths": _UP + """
        SELECT id AS message_id, CASE WHEN state <> 'cycle' THEN array_to_string(list_reverse(trail), '/') END AS path FROM e""",
    "p7_descendants": _UP + """,
        d AS (SELECT id, unnest(trail[2:]) AS ancestor, generate_subscripts(trail[2:], 1) AS distance FROM e WHERE state <> 'cycle')
        SELECT ancestor AS message_id, count(*) AS n_descendants, CAST(max(distance) AS INTEGER) AS height,
          max(id) AS last_descendant FROM d GROUP BY ancestor""",
}

QUERIES = {
    "p4_found": p4_found, "p4_jobs": p4_jobs, "p4_results": p4_results,
    "p5_found": p5_found, "p5_timelines": p5_timelines, "p6_found": p6_found, "p6_from_files": p6_from_files,
    "p7_found": p7_found, "p7_paths": p7_paths, "p7_descendants": p7_descendants, "p7_cycles": p7_cycles,
}
SQL = P4_SQL | P5_SQL | P6_SQL | P7_SQL
