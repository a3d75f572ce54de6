"""Queries for the stages of the pipeline, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as X
from loomspark.functions import vectors as V
from loomspark import schemas
from loomspark.operators import chains, density, inference, messages, relations, rollups, search, writeback
from loomspark.runtime import filesystem, materialize, scratch_path, table
from loomspark.sources import dumps, sinks, tables

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def _messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Stored messages, one row per id, with the columns asked for: copies differ in ingested_at only."""
    m = table(spark, sf_dir, "all_messages")
    return m.groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("id", "r.*")


_IDEAS = "|".join(messages.IDEA_WORDS)
_EXCLUDED = "|".join(messages.EXCLUDED).replace("'", "''")
_ONCE = "once AS (SELECT DISTINCT ON (id) * FROM all_messages WHERE id IS NOT NULL ORDER BY id, ingested_at)"


# ---- scalar functions --------------------------------------------------------------------------
@query(r"""SELECT DISTINCT subreddit,
  lower(regexp_replace(substr(subreddit, 1, 2), '[^\p{L}\p{N}_]', '', 'g')) AS prefix,
  CASE WHEN coalesce(subreddit, '') = '' THEN '_' ELSE lower(regexp_replace(subreddit, '[^A-Za-z0-9\-_]', '', 'g')) END AS path_name,
  regexp_replace(subreddit, '[^\p{L}\p{N}_]', '', 'g') AS dir_name FROM documents""")
def x1_x3_x4_names(spark, sf_dir):
    c = F.col("subreddit")
    return table(spark, sf_dir, "documents").select(c).distinct().select(
        c, X.name_prefix(c).alias("prefix"), X.path_name(c).alias("path_name"), X.dir_name(c).alias("dir_name")
    )


@query(r"""SELECT id, ingested_at, length(body) AS n_chars,
  round((length(body) - length(replace(body, '!', ''))) / greatest(length(body), 1), 6) AS exclaim,
  round(len(regexp_extract_all(body, '\p{Lu}')) / greatest(length(body), 1), 6) AS caps,
  regexp_matches(body, 'DETAIL') AS detail,
  len(list_filter(regexp_split_to_array(body, '[\s\x{85}\p{Z}\x0b]+'), lambda w: w <> '')) AS n_words FROM all_messages WHERE body IS NOT NULL""".replace("DETAIL", messages.DETAIL))
def x5_x8_text_measures(spark, sf_dir):
    b = F.col("body")
    return table(spark, sf_dir, "all_messages").filter(b.isNotNull()).select(
        "id", "ingested_at", F.length(b).cast("long").alias("n_chars"), F.round(X.share_of(b, "!"), 6).alias("exclaim"),
        F.round(X.share_of(b, r"\p{Lu}"), 6).alias("caps"), b.rlike(messages.DETAIL).alias("detail"), X.word_count(b).cast("long").alias("n_words"),
    )


@query(r"""SELECT event_id, strftime(ts, '%m%y') AS mmyy, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def x9_x10_times(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("event_id", X.month_tag(seconds).alias("mmyy"), X.epoch_text(seconds.cast("string")).alias("at"))


@query(r"""SELECT id, ingested_at, CASE WHEN contains(parent_id, '_') THEN split_part(parent_id, '_', 2) ELSE parent_id END AS second,
  list_extract(string_split(parent_id, '_'), -1) AS last FROM all_messages WHERE parent_id IS NOT NULL""")
def x11_parent_ids(spark, sf_dir):
    p = F.col("parent_id")
    return table(spark, sf_dir, "all_messages").filter(p.isNotNull()).select("id", "ingested_at", X.second_segment(p).alias("second"), X.last_segment(p).alias("last"))


@query("""SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS whole, CAST(round_even(-o_totalprice / 2, 0) AS BIGINT) AS half FROM orders""")
def x12_round(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.round_to_long(p).alias("whole"), X.round_to_long(-p / 2).alias("half"))


@query("""SELECT row_id, batch_id, delivered_at, CASE WHEN CAST(nlp_score AS VARCHAR) = 'nan' THEN 0 ELSE nlp_score END AS score FROM nlp_results""")
def x13_nan(spark, sf_dir):
    return table(spark, sf_dir, "nlp_results").select("row_id", "batch_id", "delivered_at", F.nanvl("nlp_score", F.lit(0).cast("float")).alias("score"))


@query(r"""SELECT doc_id, n_chars, lang, 'C:\users' || chr(10) || 'ew' AS path, 'x\cy' AS pair, 'z\' AS tail, 'été' AS accent, 'a\qb' AS lone FROM documents""")
def x14_x16_json(spark, sf_dir):
    r"""Answers with lone and paired backslashes and with `\u` before other than four hexadecimal digits."""
    open_, close = F.lit('```json\n{"path": "C:\\users\\new", "pair": "x\\\\cy", "tail": "z\\\\", "accent": "\\u00e9t\\u00E9", "lone": "a\\qb", '), F.lit("\n```")
    fields = F.to_json(F.struct("n_chars", "lang"))
    answer = F.concat(open_, F.when(fields == "{}", F.lit('"none": 0}')).otherwise(F.substr(fields, F.lit(2))), close)
    parsed = F.from_json(X.repair_json(answer), "n_chars long, lang string, path string, pair string, tail string, accent string, lone string")
    return table(spark, sf_dir, "documents").select("doc_id", parsed.alias("r")).select("doc_id", "r.*")


@query(r"""SELECT doc_id, lang, length(text) AS n FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL""")
def x15_fenced(spark, sf_dir):
    """The JSON within a fence, with talk around it."""
    d = table(spark, sf_dir, "documents").filter("lang is not null and text is not null")
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("lang", F.length("text").alias("n"))), F.lit("\n```\nAnything else?"))
    return d.select("doc_id", F.from_json(X.fenced_json(answer), "lang string, n long").alias("r")).select("doc_id", "r.*")


@query("""SELECT doc_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS plan_id
  FROM (SELECT doc_id, md5(coalesce(subreddit, '') || chr(31) || CAST(doc_id AS VARCHAR)) AS h FROM documents)""")
def x20_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_uuid(F.col("subreddit"), F.col("doc_id")).alias("plan_id"))


@query(r"""SELECT cluster_id, array_to_string(list_filter(texts, lambda t: t IS NOT NULL), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS joined,
  '- ' || array_to_string(list_transform(list_filter(texts, lambda t: t IS NOT NULL), lambda t: replace(t, chr(10), ' ')), chr(10) || '- ') AS prompt FROM cluster_data WHERE texts IS NOT NULL""")
def x17_joins(spark, sf_dir):
    return table(spark, sf_dir, "cluster_data").filter("texts is not null").select(
        "cluster_id", F.array_join("texts", "\n\n---\n\n").alias("joined"), inference.cluster_prompt(F.col("texts")).alias("prompt")
    )


@query(r"""SELECT doc_id, contains(upper(text), 'YES') AS yes, coalesce(replace(replace(replace(text, '\', '\\'), chr(9), ' '), chr(10), ' '), '\N') AS tsv,
  CASE WHEN length(text) > 250 THEN substr(text, 1, 250) || '...' ELSE text END AS short, hex(encode(source)) AS hexed FROM documents""")
def x19_x23_x24_x28_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.says_yes(t).alias("yes"), X.tsv_field(t).alias("tsv"), X.shorten(t).alias("short"), F.hex(F.encode("source", "utf-8")).alias("hexed")
    )


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm,
  round(list_max(embedding), 6) AS top, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings""")
def x21_x22_vectors(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(e), 4).alias("norm"), F.round(F.array_max(e), 6).alias("top"), V.argmax(e).alias("best"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding[1:5]))) AS e FROM embeddings)
  SELECT vec_id, round(e[1] / list_sum(e), 6) AS first, round(list_max(e) / list_sum(e), 6) AS top FROM e""")
def x22_softmax(spark, sf_dir):
    p = V.softmax(F.slice("embedding", 1, 5))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(p, F.lit(0)), 6).alias("first"), F.round(F.array_max(p), 6).alias("top"))


@query("""SELECT vec_id, round(CAST(CAST((CAST(embedding[1] AS DOUBLE) + embedding[7]) / 2 AS FLOAT) AS DOUBLE), 5) AS a,
  round(CAST(CAST((CAST(embedding[2] AS DOUBLE) + embedding[8]) / 2 AS FLOAT) AS DOUBLE), 5) AS b FROM embeddings""")
def x21_mean_pool(spark, sf_dir):
    """Three tokens of three numbers each, of which the second is masked."""
    e = F.col("embedding")
    tokens = F.array(F.slice(e, 1, 3), F.slice(e, 4, 3), F.slice(e, 7, 3))
    pooled = V.mean_pool(tokens, F.array(F.lit(1), F.lit(0), F.lit(1)))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(F.get(pooled, F.lit(i)).cast("double"), 5).alias(n) for i, n in enumerate("ab")])


# ---- sources and normalisation -----------------------------------------------------------------
def _raw(spark, sf_dir):
    """Messages in the shape of a raw dump: starting posts have a name and a title, comments a body."""
    m = _messages(spark, sf_dir, "link_id", "parent_id", "subreddit", "author", "body", "permalink", "created_utc", "ups", "downs")
    top = F.coalesce("parent_id", F.lit("")) == ""
    return m.select(
        "id", F.when(top, F.concat(F.lit("t3_"), "id")).alias("name"), "link_id", "parent_id", "subreddit", "author",
        F.when(top, F.col("body")).alias("title"), F.lit(None).cast("string").alias("selftext"), F.when(~top, F.col("body")).alias("body"), "permalink",
        F.when(F.col("author").startswith("m"), "moderator").alias("distinguished"),
        F.unix_seconds("created_utc").cast("double").alias("created_utc"), F.col("ups").cast("double").alias("ups"), F.col("downs").cast("double").alias("downs"),
        F.when(top, "submission").otherwise("comment").alias("kind"),
    )


_NORMAL = f"""WITH {_ONCE}, n AS (SELECT id, coalesce(parent_id, '') = '' AS top,
    CASE WHEN coalesce(parent_id, '') = '' THEN 't3_' || id ELSE coalesce(link_id, '') END AS link_id,
    CASE WHEN coalesce(parent_id, '') = '' THEN NULL ELSE parent_id END AS parent_id,
    coalesce(subreddit, '') AS subreddit, coalesce(author, '') AS author,
    CASE WHEN coalesce(parent_id, '') = '' THEN coalesce(body, '') || chr(10) ELSE coalesce(body, '') END AS body,
    CAST(coalesce(ups, 0) AS DOUBLE) AS ups, CAST(coalesce(downs, 0) AS DOUBLE) AS downs FROM once),
  k AS (SELECT * FROM n WHERE NOT contains(author, 'bot') AND NOT starts_with(author, 'm') AND ups * 0.8 + length(body) * 0.2 > 5
    AND NOT regexp_matches(body, '{_EXCLUDED}')),
  f AS (SELECT *, lower(regexp_replace(substr(subreddit, 1, 2), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS sanitized_prefix,
    regexp_matches(body, '(?i){_IDEAS}') AS flag FROM k)"""


@query(_NORMAL + " SELECT id, link_id, parent_id, body, sanitized_prefix, flag AS cpu_filter_is_idea, false AS is_idea FROM f")
def f1_f10_messages(spark, sf_dir):
    made = messages.message_table(_raw(spark, sf_dir), F.col("kind"))
    return made.select("id", "link_id", "parent_id", "body", "sanitized_prefix", "cpu_filter_is_idea", "is_idea")


@query(_NORMAL + " SELECT sanitized_prefix, count(*) AS n, CAST(sum(CAST(flag AS INTEGER)) AS BIGINT) AS n_ideas FROM f GROUP BY 1")
def s8_k1_flagship(spark, sf_dir):
    """Raw JSON lines to messages to a partitioned table, read back and counted per prefix."""
    raw = _raw(spark, sf_dir)
    lines = raw.select("kind", F.to_json(F.struct(*[c for c in raw.columns if c != "kind"])).alias("line"))
    parts = [dumps.parse_items(lines.filter(F.col("kind") == k)).withColumn("kind", F.lit(k)) for k in ("submission", "comment")]
    made = messages.message_table(parts[0].unionByName(parts[1]), F.col("kind"))
    path = scratch_path(spark, "messages")
    sinks.write_partitioned(made, path, ["sanitized_prefix"], mode="overwrite")
    stored = spark.read.parquet(path)
    return stored.groupBy("sanitized_prefix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cpu_filter_is_idea").cast("int")).alias("n_ideas"))


@query(f"""WITH {_ONCE}, q AS (SELECT id, CASE WHEN coalesce(body, '') = '' THEN 0 ELSE coalesce(ups, 0)
    * CASE WHEN (length(body) - length(replace(body, '!', ''))) / greatest(length(body), 1) > 0.05 OR len(regexp_extract_all(body, '\\p{{Lu}}')) / greatest(length(body), 1) > 0.3 THEN 0.5 ELSE 1 END
    * CASE WHEN regexp_matches(body, '{messages.DETAIL}') AND len(list_filter(regexp_split_to_array(body, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) > 100 THEN 1.5 ELSE 1 END END AS score FROM once)
  SELECT id, CAST(score AS DOUBLE) AS score FROM q WHERE score >= 1""")
def f7_quality(spark, sf_dir):
    scored = _messages(spark, sf_dir, "body", "ups").select("id", messages.quality_score(F.col("body"), F.col("ups")).alias("score"))
    return scored.filter("score >= 1")


@query(f"""WITH {_ONCE} SELECT id, body FROM once WHERE regexp_matches(body, '(?i){_IDEAS}')
  AND NOT is_idea AND nlp_top_score IS NULL AND length(body) > 10""")
def f11_f12_candidates(spark, sf_dir):
    m = _messages(spark, sf_dir, "body", "is_idea", "nlp_top_score").withColumn("cpu_filter_is_idea", X.any_phrase(F.col("body"), messages.IDEA_WORDS, True))
    return messages.long_enough(messages.nlp_candidates(m), "body", 10)


@query("""SELECT source, lang, count(*) AS n FROM documents WHERE subreddit NOT IN ('PlumCraft', 'AmberTalk') AND subreddit IN
  (SELECT subreddit FROM documents GROUP BY 1 HAVING count(*) >= 30) GROUP BY 1, 2""")
def f18_f19_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(~F.col("subreddit").isin("PlumCraft", "AmberTalk"))
    return messages.large_groups(docs, "subreddit", 30).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT cluster_id, coalesce(cluster_size, 0) AS cluster_size, '' AS generated_plan, CASE WHEN avg_quality_score >= 0.7 THEN 'high' ELSE 'low' END AS grade FROM opportunities WHERE cluster_id IN (1, 2, 5, 7, 9)""")
def f22_f25_f26_columns(spark, sf_dir):
    o = messages.with_default(table(spark, sf_dir, "opportunities"), "generated_plan", F.lit(""))
    return o.filter(F.col("cluster_id").isin(1, 2, 5, 7, 9)).select(
        "cluster_id", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"), "generated_plan",
        F.when(F.col("avg_quality_score") >= 0.7, "high").otherwise("low").alias("grade"),
    )


@query(f"""WITH {_ONCE} SELECT id, trim(body) AS body, CAST(ups AS VARCHAR) AS ups FROM once WHERE id <> '' AND length(subreddit) >= 2 AND trim(body) <> '' AND ups IS NOT NULL""")
def f20_f21_validated(spark, sf_dir):
    return messages.present(messages.validated(_messages(spark, sf_dir, "subreddit", "body", "ups")), ["ups"]).select("id", "body", "ups")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.gone'), 'none') AS gone FROM events WHERE event_type = 'click'""")
def f23_f24_fields(spark, sf_dir):
    events = spark.sql("SELECT event_id, props FROM {e} WHERE event_type = :kind", args={"kind": "click"}, e=table(spark, sf_dir, "events"))
    return messages.json_fields(events, "props", {"k": "0", "gone": "none"}).drop("props")


# ---- joins and write-back ----------------------------------------------------------------------
_RESULTS = r"r AS (SELECT regexp_replace(lower(regexp_replace(row_id, '[\s\p{Z}\p{Cf}]+', '', 'g')), '^t\d_', '') AS id, nlp_label, CASE WHEN CAST(nlp_score AS VARCHAR) = 'nan' THEN 0 ELSE nlp_score END AS nlp_score FROM nlp_results WHERE row_id IS NOT NULL), one AS (SELECT DISTINCT ON (id) * FROM r ORDER BY id, nlp_label NULLS FIRST, nlp_score NULLS FIRST)"


def _results(spark, sf_dir):
    return table(spark, sf_dir, "nlp_results").withColumn("row_id", X.bare_id(F.col("row_id")))


@query(f"""WITH {_ONCE}, {_RESULTS} SELECT id, coalesce(one.nlp_label = 'idea', once.is_idea) AS is_idea, coalesce(one.nlp_score, once.nlp_top_score) AS nlp_top_score
  FROM once LEFT JOIN one USING (id)""")
def j1_write_back(spark, sf_dir):
    return writeback.write_back(_messages(spark, sf_dir, "is_idea", "nlp_top_score"), _results(spark, sf_dir)).select("id", "is_idea", "nlp_top_score")


@query(f"""WITH {_ONCE}, {_RESULTS} SELECT id, CASE WHEN one.nlp_label = 'idea' THEN true ELSE once.is_idea END AS is_idea FROM once LEFT JOIN one USING (id)""")
def j2_write_back_once(spark, sf_dir):
    return writeback.write_back(_messages(spark, sf_dir, "is_idea", "nlp_top_score"), _results(spark, sf_dir), reset=False).select("id", "is_idea")


@query("""SELECT c.subreddit, c.cluster_id, c.message_count, o.cluster_size, o.avg_quality_score FROM cluster_data c JOIN opportunities o ON c.cluster_id = o.cluster_id AND c.subreddit = o.subreddit""")
def j3_merge(spark, sf_dir):
    merged = writeback.merge_plans(table(spark, sf_dir, "cluster_data"), table(spark, sf_dir, "opportunities"), ["subreddit", "cluster_id"])
    return merged.select("subreddit", "cluster_id", "message_count", "cluster_size", "avg_quality_score")


@query("""WITH u AS (SELECT cluster_id, max('plan-' || cluster_size) AS plan_id FROM opportunities WHERE cluster_size > 5 GROUP BY 1)
  SELECT cluster_id, coalesce(u.plan_id, '') AS generated_plan FROM cluster_data LEFT JOIN u USING (cluster_id)""")
def j4_plan_ids(spark, sf_dir):
    ideas = table(spark, sf_dir, "cluster_data").select("cluster_id", F.lit("").alias("generated_plan"))
    updates = table(spark, sf_dir, "opportunities").filter("cluster_size > 5").select("cluster_id", F.concat(F.lit("plan-"), F.col("cluster_size").cast("string")).alias("plan_id"))
    return writeback.set_plan_ids(ideas, updates, ["cluster_id"])


@query("""SELECT DISTINCT file_path, row_id FROM nlp_jobs j WHERE row_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nlp_results r WHERE r.row_id = j.row_id)""")
def j6_pending(spark, sf_dir):
    jobs = table(spark, sf_dir, "nlp_jobs").filter("row_id is not null").select("file_path", "row_id").distinct()
    return writeback.pending(jobs, table(spark, sf_dir, "nlp_results"), "row_id")


@query("""SELECT id, link_id, ingested_at FROM all_messages WHERE link_id IN (SELECT link_id FROM all_messages WHERE id IN
  (SELECT unnest(message_ids) FROM cluster_data))""")
def j5_j8_same_threads(spark, sf_dir):
    wanted = table(spark, sf_dir, "cluster_data").select(F.explode("message_ids").alias("id"))
    return writeback.same_threads(table(spark, sf_dir, "all_messages"), wanted).select("id", "link_id", "ingested_at")


@query("""WITH w AS (SELECT DISTINCT unnest(message_ids) AS id FROM cluster_data), s AS (SELECT DISTINCT id FROM all_messages)
  SELECT count(*) AS n, count(s.id) AS found, CASE WHEN count(s.id) = 0 THEN 0 WHEN count(s.id) < count(*) THEN 1 ELSE 2 END AS status FROM w LEFT JOIN s USING (id)""")
def gr4_id_status(spark, sf_dir):
    wanted = table(spark, sf_dir, "cluster_data").select(F.explode("message_ids").alias("id"))
    return writeback.id_status(wanted, table(spark, sf_dir, "all_messages"))


@query("""SELECT n_name, r_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j9_bridge(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")
    bridge = table(spark, sf_dir, "nation").withColumnsRenamed({"n_nationkey": "nation", "n_regionkey": "region"})
    right = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "region")
    return relations.through(left, bridge, right, "nation", "region").groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n_suppliers"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name IN ('Supplier#000000001', 'Supplier#000000003', 'Supplier#1', 'Supplier#3'))""")
def j10_any_tag(spark, sf_dir):
    tags = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag_id"), F.col("s_name").alias("name"))
    taggables = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("taggable_id"), F.col("l_suppkey").alias("tag_id"), F.lit("part").alias("taggable_type"))
    names = ["Supplier#000000001", "Supplier#000000003", "Supplier#1", "Supplier#3"]
    return relations.with_any_tag(table(spark, sf_dir, "part"), "p_partkey", taggables, tags, "part", names).select("p_partkey", "p_name")


# ---- chains -------------------------------------------------------------------------------------
_WALK = f"""WITH RECURSIVE {_ONCE},
  m AS (SELECT coalesce(subreddit, '') || '/' || id AS k, id, subreddit, is_idea, CASE WHEN coalesce(parent_id, '') <> '' THEN coalesce(subreddit, '') || '/' ||
      CASE WHEN contains(parent_id, '_') THEN split_part(parent_id, '_', 2) ELSE parent_id END END AS p FROM once),
  w(k, cur, hops) AS (SELECT k, k, 0 FROM m WHERE p IS NULL
    UNION ALL SELECT m.k, w.cur, w.hops + 1 FROM w JOIN m ON m.p = w.k)"""


@query(_WALK + " SELECT m.id, m.subreddit, w.hops FROM w JOIN m USING (k) WHERE m.is_idea")
def gr1_complete_ideas(spark, sf_dir):
    return chains.complete_ideas(_messages(spark, sf_dir, "subreddit", "parent_id", "link_id", "is_idea"))


@query(rf"""WITH RECURSIVE {_ONCE}, m AS (SELECT id, nullif(regexp_replace(trim(parent_id), '^[tT]\d_', ''), '') AS p, coalesce(body, '') AS body, ups, downs, is_idea FROM once),
  w(id, full_thread_body, total_ups, total_downs, hops) AS (
    SELECT id, body, CAST(coalesce(ups, 0) AS BIGINT), CAST(coalesce(downs, 0) AS BIGINT), 0 FROM m WHERE p IS NULL
    UNION ALL SELECT m.id, w.full_thread_body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || m.body, w.total_ups + coalesce(m.ups, 0), w.total_downs + coalesce(m.downs, 0), w.hops + 1
      FROM w JOIN m ON m.p = w.id WHERE w.hops < 100)
  SELECT w.id AS start_id, full_thread_body, total_ups, total_downs, total_ups / (hops + 1) AS avg_ups, total_downs / (hops + 1) AS avg_downs FROM w JOIN m USING (id) WHERE m.is_idea""")
def gr2_a9_threads(spark, sf_dir):
    m = materialize(_messages(spark, sf_dir, "parent_id", "link_id", "body", "ups", "downs", "is_idea"), "messages")  # read twice
    return chains.threads(m, m.filter("is_idea"))


@query("""WITH n AS (SELECT n_nationkey AS id, n_regionkey * 1000 + 2 + 2 * n_nationkey AS l FROM nation), r AS (SELECT r_regionkey AS id, r_regionkey * 1000 AS l, r_regionkey * 1000 + 999 AS g FROM region)
  SELECT 100 + r.id AS ancestor, n.id AS descendant FROM r JOIN n ON n.l > r.l AND n.l < r.g""")
def gr5_nested_set(spark, sf_dir):
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("id"), (F.col("r_regionkey") * 1000).alias("_lft"), (F.col("r_regionkey") * 1000 + 999).alias("_rgt"))
    left = F.col("n_regionkey") * 1000 + 2 + 2 * F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), left.alias("_lft"), (left + 1).alias("_rgt"))
    return chains.nested_set(r.unionByName(n))


# ---- aggregations --------------------------------------------------------------------------------
@query("""SELECT subreddit_prefix, count(*) AS n, count(DISTINCT subreddit) AS n_subreddits, count(*) FILTER (is_idea) AS n_ideas, CAST(sum(ups) AS BIGINT) AS ups FROM all_messages GROUP BY 1""")
def a1_a3_counts(spark, sf_dir):
    return table(spark, sf_dir, "all_messages").groupBy("subreddit_prefix").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("subreddit").alias("n_subreddits"), F.count(F.when(F.col("is_idea"), 1)).alias("n_ideas"), F.sum("ups").alias("ups")
    )


def _members(spark, sf_dir):
    """Messages with the pile they are listed in; piles of fewer than three messages count as noise."""
    piles = table(spark, sf_dir, "cluster_data").select("cluster_id", F.explode("message_ids").alias("id"), F.size("message_ids").alias("n")).distinct()
    labelled = piles.select("id", F.when(F.col("n") < 3, -1).otherwise(F.col("cluster_id")).alias("cluster_id"))
    return labelled.join(_messages(spark, sf_dir, "body", "ups", "downs", "nlp_top_score"), "id")


_MEMBERS = f"""{_ONCE}, piles AS (SELECT DISTINCT cluster_id, unnest(message_ids) AS id, len(message_ids) AS n FROM cluster_data),
  mem AS (SELECT id, CASE WHEN n < 3 THEN -1 ELSE cluster_id END AS cluster_id, body, ups, downs, nlp_top_score FROM piles JOIN once USING (id))"""


@query(f"""WITH {_MEMBERS} SELECT cluster_id, list(body ORDER BY id) FILTER (body IS NOT NULL OR body IS NULL) AS texts, list(id ORDER BY id) AS message_ids, CAST(coalesce(sum(ups), 0) AS BIGINT) AS total_ups,
  CAST(coalesce(sum(downs), 0) AS BIGINT) AS total_downs, count(*) AS message_count FROM mem WHERE cluster_id >= 0 GROUP BY 1""")
def a4_a7_rollup(spark, sf_dir):
    return rollups.cluster_rollup(_members(spark, sf_dir), ["cluster_id"]).drop("part")  # no cluster is that large here


@query(f"""WITH {_MEMBERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM mem WHERE cluster_id >= 0)
  SELECT cluster_id, count(*) AS cluster_size, round(coalesce(avg(nlp_top_score), avg(ups), 0.0), 5) AS avg_quality_score, list(body ORDER BY id) FILTER (r <= 10) AS representative_texts FROM ranked GROUP BY 1""")
def a5_opportunities(spark, sf_dir):
    return rollups.opportunities(_members(spark, sf_dir), ["cluster_id"]).withColumn("avg_quality_score", F.round("avg_quality_score", 5))


@query(rf"""WITH {_MEMBERS} SELECT cluster_id, CASE WHEN avg(length(body)) > 200 THEN 2 ELSE 0 END + CASE WHEN avg(CAST(coalesce(regexp_matches(body, '\d+'), false) AS INTEGER)) > 0.3 THEN 2 ELSE 0 END
  + CASE WHEN avg(CAST(coalesce(regexp_matches(body, '{rollups.ACTION}'), false) AS INTEGER)) > 0.4 THEN 3 ELSE 0 END AS quality FROM mem GROUP BY 1""")
def a6_quality(spark, sf_dir):
    return rollups.cluster_quality(_members(spark, sf_dir), ["cluster_id"], "body")


@query(f"""WITH {_MEMBERS} SELECT count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters, CAST(sum(CASE WHEN cluster_id < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise FROM mem""")
def a8_stats(spark, sf_dir):
    return rollups.cluster_stats(_members(spark, sf_dir))


@query("""WITH w AS (SELECT DISTINCT input_path FROM chain_files), d AS (SELECT DISTINCT input_path FROM embedding_jobs WHERE output_path IS NOT NULL)
  SELECT count(*) AS wanted, count(d.input_path) AS done, 100.0 * count(d.input_path) / count(*) AS percent FROM w LEFT JOIN d USING (input_path)""")
def a10_completion(spark, sf_dir):
    done = table(spark, sf_dir, "embedding_jobs").filter("output_path is not null").select("input_path")
    return rollups.completion(table(spark, sf_dir, "chain_files").select("input_path"), done)


@query("""SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2""")
def a12_facets(spark, sf_dir):
    return search.facets(table(spark, sf_dir, "documents"), ["lang", "source"])


# ---- sorts, limits, sets -------------------------------------------------------------------------
@query("""SELECT doc_id, created_utc FROM documents ORDER BY created_utc NULLS FIRST, doc_id LIMIT 20 OFFSET 40""")
def o1_o3_page(spark, sf_dir):
    return search.page(table(spark, sf_dir, "documents").select("doc_id", "created_utc"), [F.asc("created_utc"), F.asc("doc_id")], 3, 20)


@query("""SELECT cluster_id, cluster_size, subreddit FROM (SELECT DISTINCT cluster_id, cluster_size, subreddit FROM opportunities) ORDER BY cluster_size DESC NULLS LAST, cluster_id, subreddit LIMIT 10""")
def o4_o8_sorted(spark, sf_dir):
    o = table(spark, sf_dir, "opportunities").select("cluster_id", "cluster_size", "subreddit").distinct()
    column, down = search.sort_key("cluster_size_desc", o.columns)
    return search.page(o, [F.desc(column) if down else F.asc(column), F.asc("cluster_id"), F.asc("subreddit")])


@query()
def o6_random_row(spark, sf_dir):
    return search.random_row(table(spark, sf_dir, "documents").select("doc_id"), [F.asc("doc_id")], 7)


@query("""SELECT kind, count(*) AS n FROM (SELECT 'post' AS kind FROM all_messages WHERE coalesce(parent_id, '') = '' UNION ALL SELECT 'comment' FROM all_messages WHERE coalesce(parent_id, '') <> '') GROUP BY 1""")
def u1_u2_u6_union(spark, sf_dir):
    m = table(spark, sf_dir, "all_messages")
    top = F.coalesce("parent_id", F.lit("")) == ""
    parts = [m.filter(top).select(F.lit("post").alias("kind"), "id"), m.filter(~top).select(F.lit("comment").alias("kind"), "id")]
    return relations.same_schema_union(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT subreddit, 'both' AS side FROM (SELECT subreddit FROM documents INTERSECT SELECT subreddit FROM all_messages) UNION ALL
  SELECT subreddit, 'messages' FROM (SELECT subreddit FROM all_messages EXCEPT SELECT subreddit FROM documents)""")
def u3_u4_u5_sets(spark, sf_dir):
    d, m = (table(spark, sf_dir, t).select("subreddit") for t in ("documents", "all_messages"))
    return d.intersect(m).withColumn("side", F.lit("both")).unionByName(m.distinct().exceptAll(d.distinct()).withColumn("side", F.lit("messages")))


@query("""SELECT row_id, file_path FROM (SELECT row_id, min(file_path) AS file_path FROM nlp_results WHERE row_id IS NOT NULL GROUP BY 1) n WHERE row_id NOT IN (SELECT row_id FROM nlp_jobs WHERE row_id IS NOT NULL)""")
def u7_k8_insert_new(spark, sf_dir):
    new = table(spark, sf_dir, "nlp_results").filter("row_id is not null").select("row_id", "file_path")
    return sinks.insert_new(table(spark, sf_dir, "nlp_jobs"), new, ["row_id"])


# ---- search ---------------------------------------------------------------------------------------
_BM25 = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, len(w) AS dl, unnest(w) AS w FROM t), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
  tf AS (SELECT doc_id, dl, w, count(*) AS tf FROM s WHERE w IN ('glass', 'jar', 'label') GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
  b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (w), n GROUP BY 1)"""


_stored: dict[tuple, search.Index] = {}


def _index(spark, sf_dir, name: str, docs: DataFrame, id_col: str, fields: list[str]) -> search.Index:
    """The stored index of a table: built by the first query of a session that needs it, as a search service has it ready."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = search.build_index(docs, scratch_path(spark, f"index-{name}"), id_col, fields, parts=16)
    return _stored[key]


def _text_index(spark, sf_dir):
    return _index(spark, sf_dir, "documents", table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"])


@query(f"WITH {_BM25} SELECT doc_id AS id, round(score, 6) AS score FROM b")
def r1_relevance(spark, sf_dir):
    return search.relevance(_text_index(spark, sf_dir), "glass jar LABEL", {"text": 1.0}).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT d.doc_id, round(score, 6) AS score FROM b JOIN documents d USING (doc_id) WHERE lang = 'en' AND n_chars >= 0 AND n_chars <= 900 ORDER BY round(b.score, 9) DESC, doc_id LIMIT 10")
def r2_filtered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    found, _ = search.search(docs, "doc_id", _text_index(spark, sf_dir), {"text": 1.0}, "glass jar label", {"lang": "en"}, {"n_chars": (0, 900)})
    return found.select("doc_id", F.round("score", 6).alias("score"))


def _plans(spark, sf_dir) -> DataFrame:
    """A plan of ten searched fields for every document with text: its first sentences, one to a field, some of them nested."""
    said = F.split(F.col("text"), r"[.!?\n]+")
    part = lambda i: F.get(said, F.lit(i))
    names = schemas.SEARCHED
    fields = [F.struct(part(i).alias("summary")).alias(n) if n in ("market_analysis", "competition", "marketing_strategy") else part(i).alias(n) for i, n in enumerate(names)]
    flags = [(F.col("doc_id") % 2 == 0).alias("is_saas"), (F.col("doc_id") % 3 != 0).alias("is_solo_entrepreneur_possible"), (F.col("doc_id") % 11).alias("viability_score")]
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "subreddit", *fields, *flags)


_PLAN_FIELDS = ", ".join(f"('{n}', p[{i + 1}], {schemas.BOOSTS.get(n, 1.0)}, {'true' if n in ('market_analysis', 'competition', 'marketing_strategy') else 'false'})" for i, n in enumerate(schemas.SEARCHED))
_PLAN_BM25 = rf"""p AS (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]+') AS p FROM documents WHERE text IS NOT NULL),
  f AS (SELECT doc_id, v.* FROM p, LATERAL (VALUES {_PLAN_FIELDS}) v(field, t, boost, nested)),
  t AS (SELECT doc_id, field, boost, list_filter(regexp_split_to_array(lower(CASE WHEN nested THEN CASE WHEN t IS NULL THEN '' ELSE 'summary ' || t END ELSE t END), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM f WHERE nested OR t IS NOT NULL),
  n AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM t GROUP BY 1),
  tf AS (SELECT doc_id, field, boost, dl, w, count(*) AS tf FROM (SELECT doc_id, field, boost, len(w) AS dl, unnest(w) AS w FROM t) WHERE w IN ('glass', 'jar', 'label', 'honey') GROUP BY ALL),
  df AS (SELECT field, w, count(*) AS df FROM tf GROUP BY ALL),
  s AS (SELECT doc_id, field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS s FROM tf JOIN df USING (field, w) JOIN n USING (field) GROUP BY ALL),
  b AS (SELECT doc_id, round(max(s), 9) AS score FROM s GROUP BY 1)"""


@query(f"WITH {_PLAN_BM25} SELECT doc_id AS id, round(score, 5) AS score FROM b")
def r1_ten_fields(spark, sf_dir):
    plans = _plans(spark, sf_dir)
    index = _index(spark, sf_dir, "plans", plans, "doc_id", schemas.SEARCHED)
    boosts = {f: schemas.BOOSTS.get(f, 1.0) for f in schemas.SEARCHED}
    return search.relevance(index, "Glass, jar; label honey", boosts).withColumn("score", F.round("score", 5))


@query("""SELECT doc_id, subreddit, lang, n_chars FROM documents WHERE doc_id = 105""")
def r4_s19_by_id(spark, sf_dir):
    return search.by_id(table(spark, sf_dir, "documents"), "doc_id", 105).select("doc_id", "subreddit", "lang", "n_chars")


@query("""SELECT doc_id, subreddit FROM documents WHERE doc_id = -5""")
def r4_missing(spark, sf_dir):
    return search.by_id(table(spark, sf_dir, "documents"), "doc_id", -5).select("doc_id", "subreddit")


@query(r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]+') AS p FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, p[1] AS title, p[2] AS executive_summary, p[3] AS problem, p[4] AS solution, p[5] AS market_analysis, p[6] AS competition, p[7] AS marketing_strategy, p[8] AS call_to_action,
  p[9] AS cluster_summary, p[10] AS texts_combined FROM p""")
def r9_projection(spark, sf_dir):
    nested = ("market_analysis", "competition", "marketing_strategy")
    return _plans(spark, sf_dir).select("doc_id", *[F.col(f"{n}.summary").alias(n) if n in nested else F.col(n) for n in schemas.SEARCHED])


@query("""SELECT count(*) AS total FROM documents WHERE lang = 'de' AND n_chars >= 0""")
def r5_a13_total(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), "doc_id", equal={"lang": "de"}, ranges={"n_chars": (0, None)})[1]


@query("""SELECT count(*) AS n, count(*) FILTER (is_saas AND is_solo) AS fitting, count(DISTINCT doc_id) AS n_ids, max(total) AS total FROM (
  SELECT doc_id, doc_id % 2 = 0 AS is_saas, doc_id % 3 <> 0 AS is_solo, count(*) OVER () AS total FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 AND doc_id % 3 <> 0 LIMIT 10)""")
def r3_o5_sample(spark, sf_dir):
    """Ten random plans that fit, counted: how many, whether they fit, whether they differ, and the total."""
    plans = _plans(spark, sf_dir).select("doc_id", "is_saas", "is_solo_entrepreneur_possible")
    rows, total = search.sample(plans, 10, 42, {"is_saas": True, "is_solo_entrepreneur_possible": True})
    fits = F.count(F.when(F.col("is_saas") & F.col("is_solo_entrepreneur_possible"), 1))
    return rows.agg(F.count(F.lit(1)).alias("n"), fits.alias("fitting"), F.countDistinct("doc_id").alias("n_ids")).join(F.broadcast(total), F.lit(True))  # one row each


@query("""SELECT vec_id AS id, round(list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), 4) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)) DESC, id LIMIT 10""")
def r6_semantic(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.filter("vec_id = 7").first().embedding  # the one query vector
    return search.similar_to(vectors, "vec_id", "embedding", q, 10).withColumn("similarity", F.round("similarity", 4))


@query("""SELECT doc_id FROM documents WHERE (contains(text, 'er') OR contains(source, 'er')) AND lang = 'en'""")
def r7_contains(spark, sf_dir):
    return search.contains_any(table(spark, sf_dir, "documents"), ["text", "source"], "er", F.col("lang") == "en").select("doc_id")


@query("""WITH n AS (SELECT cluster_id AS _id, subreddit, cluster_size, row_number() OVER (PARTITION BY cluster_id ORDER BY cluster_size DESC NULLS LAST, subreddit DESC NULLS LAST) AS r FROM opportunities)
  SELECT _id, subreddit, cluster_size FROM n WHERE r = 1""")
def k11_r8_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "opportunities").select(F.col("cluster_id").alias("_id"), "subreddit", "cluster_size")
    return sinks.upsert(docs.limit(0), docs.select("_id", "subreddit", "cluster_size"), "_id", F.col("cluster_size"))


# ---- models ---------------------------------------------------------------------------------------
_CLASS = f"""{_ONCE}, c AS (SELECT id, length(body) - length(replace(body, '!', '')) AS a, length(body) - length(replace(body, '?', '')) AS b FROM once WHERE body <> '')"""


@query(f"""WITH {_CLASS} SELECT id AS row_id, CASE WHEN b > a THEN 'idea' ELSE 'pain_point' END AS nlp_label, round(1 / (1 + exp(-abs(a - b))), 4) AS nlp_score FROM c""")
def m1_classify(spark, sf_dir):
    return inference.classify(_messages(spark, sf_dir, "body"), "id", "body").withColumn("nlp_score", F.round(F.col("nlp_score").cast("double"), 4))


@query(f"""WITH {_CLASS} SELECT count(*) AS n, count(*) FILTER (b > a AND 1 / (1 + exp(-abs(a - b))) > 0.7) AS n_ideas FROM c""")
def m3_threshold(spark, sf_dir):
    found = inference.thresholded(inference.classify(_messages(spark, sf_dir, "body"), "id", "body"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_idea"), 1)).alias("n_ideas"))


@query()
def m4_embed(spark, sf_dir):
    e = inference.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", width=64)
    return e.select("doc_id", F.size("embedding").alias("width"), F.round(V.norm(F.col("embedding")), 3).alias("norm"))


@query("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      AND list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) <= 1.21),
  c AS (SELECT e.vec_id AS id FROM embeddings e LEFT JOIN p ON p.a = e.vec_id GROUP BY 1 HAVING count(p.b) + 1 >= 3),
  w(id, r) AS (SELECT id, id FROM c UNION SELECT p.b, w.r FROM w JOIN p ON p.a = w.id WHERE p.b IN (SELECT id FROM c)),
  l AS (SELECT id, min(r) AS label FROM w GROUP BY 1),
  x AS (SELECT p.a AS id, arg_min(l.label, p.b) AS label FROM p JOIN l ON l.id = p.b WHERE p.a NOT IN (SELECT id FROM c) GROUP BY 1)
  SELECT e.vec_id AS id, coalesce(l.label, x.label, -1) AS cluster_id FROM embeddings e LEFT JOIN l ON l.id = e.vec_id LEFT JOIN x ON x.id = e.vec_id""")
def m9_dbscan(spark, sf_dir):
    return density.dbscan(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1.10, 3)


@query(f"WITH {_ONCE} SELECT id AS row_id, 'none' AS nlp_label, CAST(0 AS DOUBLE) AS nlp_score FROM once WHERE body <> ''")
def m2_failed(spark, sf_dir):
    """A model that fails on every batch leaves every text without a label."""

    def failing(texts, labels):
        raise RuntimeError("no model")

    return inference.classify(_messages(spark, sf_dir, "body"), "id", "body", failing).withColumn("nlp_score", F.col("nlp_score").cast("double"))


@query("""WITH v AS (SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS a, length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) + 1.0 AS b FROM documents)
  SELECT doc_id, round(a / sqrt(a * a + b * b), 4) AS a, round(b / sqrt(a * a + b * b), 4) AS b FROM v""")
def m5_embed(spark, sf_dir):
    """Unit vectors of an encoder that counts characters."""
    encoder = lambda texts, width: [[len(t), t.count("e") + 1] for t in texts]
    e = inference.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", encoder, width=2)
    return e.select("doc_id", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(n) for i, n in enumerate("ab")])


@query("""SELECT c_custkey, CASE WHEN count(*) OVER w < 5 THEN -1 ELSE min(c_custkey) OVER w END AS least FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def m7_m8_hdbscan(spark, sf_dir):
    """Customers at the place of their nation: a cluster for each nation of five or more.

    Nations of fewer lie each far from all others, ever farther out. Beside a cluster they would be counted to it, as points that
    drop out of a cluster are, and two of them beside each other could make one.
    """
    few = F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")) < 5
    place = F.when(few, F.pow(F.lit(4.0), F.col("c_nationkey")) * 10_000.0).otherwise(F.col("c_nationkey") * 10.0)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("all").alias("g"), F.array(place, F.lit(1.0)).alias("v"))
    found = density.hdbscan(c, "g", "c_custkey", "v", method="eom")
    least = found.groupBy("cluster_id").agg(F.min("c_custkey").alias("least"))
    return found.join(least, "cluster_id").select("c_custkey", F.when(F.col("cluster_id") < 0, -1).otherwise(F.col("least")).alias("least"))


@query()
def m6_m7_hdbscan(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    reduced = density.reduce(vectors, "embedding", 15)
    return density.hdbscan(reduced, "label", "vec_id", "embedding").groupBy("label", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT cluster_id, length('- ' || array_to_string(list_transform(list_filter(texts, lambda t: t IS NOT NULL), lambda t: replace(t, chr(10), ' ')), chr(10) || '- ')) AS n FROM cluster_data WHERE texts IS NOT NULL)
  SELECT cluster_id, n % 2 = 0 AS is_viable_business, CAST(1 + n % 10 AS INTEGER) AS viability_score, n % 3 = 0 AS is_saas, NULL::VARCHAR AS error FROM p""")
def m10_analyse(spark, sf_dir):
    prompts = table(spark, sf_dir, "cluster_data").filter("texts is not null").select("cluster_id", inference.cluster_prompt(F.col("texts")).alias("prompt"))
    return inference.ask(prompts, "prompt", ["cluster_id"]).select("cluster_id", "is_viable_business", "viability_score", "is_saas", "error")


@query("""WITH p AS (SELECT cluster_id, '- ' || array_to_string(list_transform(list_filter(texts, lambda t: t IS NOT NULL), lambda t: replace(t, chr(10), ' ')), chr(10) || '- ') AS p FROM cluster_data WHERE texts IS NOT NULL)
  SELECT cluster_id, substr(replace(replace(split_part(trim(p), chr(10), 1)[1:40], chr(92), ' '), '"', ' '), 1, 40) AS title, 'a' || chr(92) || 'c' AS target_market, NULL::VARCHAR AS problem FROM p""")
def m11_x14_plans(spark, sf_dir):
    prompts = table(spark, sf_dir, "cluster_data").filter("texts is not null").select("cluster_id", inference.cluster_prompt(F.col("texts")).alias("prompt"))
    plans = inference.ask(prompts, "prompt", ["cluster_id"], schemas.PLAN, inference.repaired(inference.offline_planner))
    return plans.select("cluster_id", "title", F.col("market_analysis.target_market").alias("target_market"), "problem")


@query("""SELECT model, n, seconds, round(n / seconds, 3) AS rows_per_s FROM (SELECT lang AS model, count(*) AS n, 0.5 + length(lang) AS seconds FROM documents WHERE lang IS NOT NULL GROUP BY 1) ORDER BY rows_per_s DESC, model""")
def o10_benchmark(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").filter("lang is not null").groupBy(F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return inference.ranked(runs.withColumn("seconds", 0.5 + F.length("model")), "model").withColumn("rows_per_s", F.round("rows_per_s", 3))


@query("""WITH p AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(n % 11 AS DOUBLE) AS score, 'length' AS reasoning FROM p WHERE n % 11 >= 7""")
def m12_f16_rated(spark, sf_dir):
    """Texts rated by a model, those of 7 or more."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    rated = inference.rate(docs, "text", ["doc_id"])
    return messages.scored_at_least(rated.withColumn("answer", F.to_json(F.struct("score"))), "answer").drop("answer")


@query("""SELECT doc_id FROM documents WHERE length(text) % 2 = 0""")
def m12_validated(spark, sf_dir):
    """Texts that a model answers with a yes."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    answers = inference.told(docs, "text", ["doc_id"], lambda t: "No." if len(t) % 2 else "Yes, it is.")
    return answers.filter(X.says_yes(F.col("answer"))).select("doc_id")


@query("""SELECT cluster_id, message_count FROM cluster_data WHERE message_count % 2 = 0 AND cluster_id % 3 = 0 AND total_ups > 5 AND coalesce(CASE WHEN cluster_id % 5 = 0 THEN 'plan' WHEN cluster_id % 5 > 2 THEN '' END, '') = ''""")
def f15_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "cluster_data").select(
        "cluster_id", "message_count", (F.col("message_count") % 2 == 0).alias("is_viable_business"), (F.col("cluster_id") % 3 == 0).alias("is_saas"),
        (F.col("total_ups") > 5).alias("is_solo_entrepreneur_possible"),
        F.when(F.col("cluster_id") % 5 == 0, "plan").when(F.col("cluster_id") % 5 > 2, "").alias("generated_plan"),
    )
    return messages.plan_candidates(c).select("cluster_id", "message_count")


@query("""SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders""")
def f21_times(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("at"))
    iso = messages.with_time(orders, "at")
    epochs = messages.with_time(iso.select("o_orderkey", F.unix_seconds("at").cast("string").alias("at")), "at")
    return epochs.select("o_orderkey", "at")


# ---- layout and maintenance ------------------------------------------------------------------------
_PREFIX = r"lower(regexp_replace(substr(subreddit, 1, 2), '[^\p{L}\p{N}_]', '', 'g'))"


@query(rf"""SELECT coalesce(nullif({_PREFIX}, ''), 'misc') AS sanitized_prefix, coalesce(nullif(regexp_replace(subreddit, '[^\p{{L}}\p{{N}}_]', '', 'g'), ''), 'misc') AS subreddit_dir, count(*) AS n FROM all_messages GROUP BY 1, 2""")
def k2_by_subreddit(spark, sf_dir):
    m = table(spark, sf_dir, "all_messages").select("id", "subreddit").withColumn("sanitized_prefix", X.name_prefix(F.col("subreddit")))
    path = scratch_path(spark, "by-subreddit")
    sinks.write_by_subreddit(m, path, mode="overwrite", files_per_key=1)
    stored = spark.read.schema("id string, sanitized_prefix string, subreddit_dir string").parquet(path)
    return stored.groupBy("sanitized_prefix", "subreddit_dir").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(nullif(subreddit_prefix, ''), 'misc') AS subreddit_prefix, strftime(created_utc, '%m%y') AS mmyy, count(*) AS n FROM all_messages WHERE created_utc IS NOT NULL GROUP BY 1, 2""")
def k3_consolidated(spark, sf_dir):
    """Messages in two appends: those ingested on odd days go into partitions that hold the others."""
    m = table(spark, sf_dir, "all_messages").filter("created_utc is not null").withColumn("mmyy", F.date_format("created_utc", "MMyy"))
    odd = F.coalesce(F.dayofmonth("ingested_at") % 2 == 1, F.lit(False))
    path = scratch_path(spark, "partitions")
    for part in (m.filter(~odd), m.filter(odd)):
        sinks.consolidate(spark, path, part.select("id", "subreddit_prefix", "mmyy"), ["subreddit_prefix", "mmyy"])
    stored = spark.read.schema("id string, subreddit_prefix string, mmyy string").parquet(path)
    return stored.groupBy("subreddit_prefix", "mmyy").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT regexp_replace(subreddit, '[^A-Za-z0-9]', '', 'g') AS name FROM all_messages WHERE subreddit ILIKE '%shop%' AND regexp_replace(subreddit, '[^A-Za-z0-9]', '', 'g') <> '' GROUP BY 1""")
def s12_folders(spark, sf_dir):
    """A two-level layout written and listed again from its folder names."""
    m = table(spark, sf_dir, "all_messages").filter("subreddit is not null").select("id", "subreddit").withColumn("sanitized_prefix", X.name_prefix(F.col("subreddit")))
    path = scratch_path(spark, "catalog")
    sinks.write_partitioned(m.select("id", "sanitized_prefix", X.dir_name(F.col("subreddit")).alias("name")), path, ["sanitized_prefix", "name"], mode="overwrite", files_per_key=1)
    names = tables.folder_catalog(spark, path, "*SHOP*")
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(r"""SELECT subreddit_prefix, count(*) AS n, count(DISTINCT id) AS n_ids FROM all_messages WHERE subreddit_prefix <> '' GROUP BY 1""")
def s9_s11_scan(spark, sf_dir):
    """Folders whose files differ in columns, united by name, with the partition column and the file of each row."""
    base = scratch_path(spark, "scan")
    m = table(spark, sf_dir, "all_messages").filter("subreddit_prefix <> ''")
    m.filter("ups > 0").select("id", "ups", "subreddit_prefix").write.partitionBy("subreddit_prefix").parquet(f"{base}/t")
    m.filter("ups is null or ups <= 0").select("id", "downs", "subreddit_prefix").write.mode("append").partitionBy("subreddit_prefix").parquet(f"{base}/t")
    read = tables.with_file(tables.scan(spark, f"{base}/t", by_name=True)).filter("filename like '%subreddit_prefix=%' and (ups is null or downs is null)")
    return read.groupBy("subreddit_prefix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def _dump(spark, sf_dir, label: str) -> str:
    """Raw dump files of two kinds: submissions as .zst, comments as .jsonl."""
    raw, base = _raw(spark, sf_dir), scratch_path(spark, label)
    for kind, name in (("submission", "RS_2024"), ("comment", "RC_2024")):
        lines = raw.filter(F.col("kind") == kind).select(F.to_json(F.struct(*[c for c in raw.columns if c != "kind"])).alias("value"))
        dumps.write_lines(lines, f"{base}/{name}", name, pack=kind == "submission")
    return base


@query(f"WITH {_ONCE} SELECT CASE WHEN coalesce(parent_id, '') = '' THEN 'submission' ELSE 'comment' END AS kind, count(*) AS n, count(DISTINCT id) AS n_ids FROM once GROUP BY 1")
def s1_s7_dumps(spark, sf_dir):
    """Dump files found by name, told apart, read by line from .zst and .jsonl, and parsed."""
    files = dumps.pick_files(dumps.discover(spark, _dump(spark, sf_dir, "dump")), year="2024", not_month="2024-13")
    out = None
    for kind in ("submission", "comment"):
        paths = [r.path for r in files.filter(F.col("kind") == kind).select("path").toLocalIterator()]  # the driver lists them for any scan
        items = dumps.parse_items(dumps.read_lines(spark, paths)).withColumn("kind", F.lit(kind))
        out = items if out is None else out.unionByName(items)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


@query("""SELECT 'broken.parquet' AS name, 'restored' AS done UNION ALL SELECT 'empty.parquet', 'deleted' UNION ALL SELECT 'gone.parquet', 'restored' UNION ALL SELECT 'old.parquet.tmp.1', 'deleted' ORDER BY 1""")
def t1_s14_repair(spark, sf_dir):
    """A folder with damaged files and leftovers of writers, put right."""
    base = scratch_path(spark, "damaged")
    fs, hadoop_path = filesystem(spark, base)
    source = hadoop_path(f"{sf_dir}/nation.parquet")
    if fs.getFileStatus(source).isDirectory():
        source = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().endswith(".parquet"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in ("good.parquet", "broken.parquet.tmp.7", "gone.parquet.tmp.2", "old.parquet", "old.parquet.tmp.1"):
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, hadoop_path(f"{base}/{name}"), False, conf)
    for name, content in (("broken.parquet", b"PAR1 no end"), ("empty.parquet", b"")):
        out = fs.create(hadoop_path(f"{base}/{name}"), True)
        out.write(bytearray(content))
        out.close()
    done = tables.repair(spark, base, fix=True)
    if not tables.damaged_files(spark, base).isEmpty():
        raise RuntimeError("damaged files are left")
    return spark.createDataFrame([(path.rpartition("/")[2], what) for path, what in done], "name string, done string")


@query("""SELECT c_custkey % 100 AS id, max(CAST(c_custkey AS BIGINT)) AS c FROM customer GROUP BY 1""")
def k14_vectors(spark, sf_dir):
    """Vectors upserted in two rounds; the second replaces those of the same ids."""
    path = scratch_path(spark, "vectors")
    c = table(spark, sf_dir, "customer")
    last = c.groupBy((F.col("c_custkey") % 100).alias("id")).agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    for which in ("low", "high"):
        points = last.select("id", F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>").alias("vector"), F.struct(F.col(which).cast("long").alias("c")).alias("payload"))
        sinks.upsert_vectors(spark, path, points, buckets=4)
    near = F.abs(V.norm(F.col("vector")) - 1) < 1e-6
    return spark.read.parquet(path).filter(near).select("id", F.col("payload.c").alias("c"))


@query("""SELECT doc_id, CAST(n_chars AS VARCHAR) AS n_chars, lang, NULL::VARCHAR AS title FROM documents""")
def k12_k13_mapping(spark, sf_dir):
    """An index started anew with a mapping that is extended by an unknown column."""
    docs, mapping = sinks.extended(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id bigint, n_chars string, title string")
    path = scratch_path(spark, "search-docs")
    docs.withColumn("gone", F.lit(1)).write.parquet(path)
    copy = sinks.recreate(spark, path, mapping)
    stored = spark.read.parquet(path)
    sinks.drop_table(spark, copy, confirm=True)
    return stored


@query("""WITH s AS (SELECT DISTINCT id FROM all_messages WHERE ups > 3), l AS (SELECT file_path, row_id, row_number() OVER (PARTITION BY file_path ORDER BY sent_at, batch_id, row_id NULLS FIRST, text) - 1 AS line FROM nlp_jobs)
  SELECT file_path, count(*) AS lines, CAST(coalesce(max(CASE WHEN s.id IS NOT NULL THEN line + 1 END), 0) AS BIGINT) AS resume FROM l LEFT JOIN s ON l.row_id = s.id GROUP BY 1""")
def gr4_resume(spark, sf_dir):
    order = Window.partitionBy("file_path").orderBy("sent_at", "batch_id", "row_id", "text")
    lines = table(spark, sf_dir, "nlp_jobs").select("file_path", F.col("row_id").alias("id"), (F.row_number().over(order) - 1).alias("line_number"))
    return writeback.resume_points(lines, table(spark, sf_dir, "all_messages").filter("ups > 3"))


@query("""SELECT count(*) AS n, count(*) AS blank, CAST(greatest(1, ceil(count(*) / 20000.0)) AS BIGINT) AS files FROM all_messages""")
def k4_t2_rewrite(spark, sf_dir):
    """Many small files rewritten into files of bounded rows, with a column added on the way."""
    path = scratch_path(spark, "small-files")
    table(spark, sf_dir, "all_messages").select("id", "body").repartition(40).write.parquet(path)
    add = lambda t: messages.with_default(t, "generated_plan", F.lit("")).repartition(max(1, -(-t.count() // 20_000)))
    stored = sinks.rewrite(spark, path, add, rows_per_file=20_000)
    return stored.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("generated_plan") == "", 1)).alias("blank"), F.countDistinct(F.col("_metadata.file_path")).alias("files")
    )


@query("""SELECT subreddit FROM (SELECT DISTINCT subreddit FROM all_messages WHERE subreddit ILIKE '%shop%') ORDER BY 1""")
def s12_s13_catalog(spark, sf_dir):
    return tables.catalog(table(spark, sf_dir, "all_messages"), "subreddit", "*SHOP*")


@query("""SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'all_messages', count(*) FROM all_messages UNION ALL SELECT 'nlp_jobs', count(*) FROM nlp_jobs""")
def t3_row_counts(spark, sf_dir):
    out = None
    for name in ("documents", "all_messages", "nlp_jobs"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def s8_x30_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE lang IS NOT NULL AND n_chars > 0""")
def s17_k15_csv(spark, sf_dir):
    """CSV part files merged to one and read again."""
    base = scratch_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").filter("lang is not null and n_chars > 0").select("doc_id", "lang", "n_chars")
    sinks.write_csv(docs.repartition(3), f"{base}/parts")
    tables.merge_csv(spark, f"{base}/parts", f"{base}/merged")
    return spark.read.option("header", "true").schema("doc_id long, lang string, n_chars long").csv(f"{base}/merged")


@query("""SELECT cluster_id, cluster_size FROM opportunities WHERE avg_quality_score IS NOT NULL""")
def k10_f17_ndjson(spark, sf_dir):
    """Rows without an error written as JSON lines and read again."""
    path = scratch_path(spark, "ndjson")
    rows = table(spark, sf_dir, "opportunities").select("cluster_id", "cluster_size", F.when(F.col("avg_quality_score").isNull(), "failed").alias("error"))
    sinks.write_ndjson(rows, path)
    return spark.read.schema("cluster_id int, cluster_size long").json(path)


@query(f"WITH {_ONCE} SELECT id AS row_id FROM once WHERE regexp_matches(body, '(?i)idea') AND NOT is_idea AND nlp_top_score IS NULL ORDER BY id LIMIT 10")
def s16_peek(spark, sf_dir):
    """The first jobs of a queue, which stay in it."""
    from loomspark.streaming import queues

    path = scratch_path(spark, "peeked")
    m = _messages(spark, sf_dir, "body", "is_idea", "nlp_top_score").withColumn("cpu_filter_is_idea", X.any_phrase(F.col("body"), ["idea"], True))
    queues.enqueue(m, path)
    return queues.peek(spark, path).select("row_id")


@query("""SELECT count(*) AS n_rows, 7 AS n_columns FROM documents""")
def s18_inspect(spark, sf_dir):
    seen = tables.inspect(table(spark, sf_dir, "documents"))
    return spark.createDataFrame([(seen["rows"], seen["columns"])], "n_rows long, n_columns int")


# ---- streaming ---------------------------------------------------------------------------------------
@query(f"""WITH {_CLASS}, cand AS (SELECT id FROM once WHERE regexp_matches(body, '(?i){_IDEAS}') AND NOT is_idea AND nlp_top_score IS NULL)
  SELECT id, CASE WHEN b > a THEN 'idea' ELSE 'pain_point' END AS nlp_label FROM c JOIN cand USING (id)""")
def st1_st7_queue(spark, sf_dir):
    """Candidates enqueued under a brake, twice, through the classifier stream and the write-back stream: every id is handed on once."""
    from loomspark.streaming import queues

    base = scratch_path(spark, "queue")
    m = _messages(spark, sf_dir, "body", "is_idea", "nlp_top_score").withColumn("cpu_filter_is_idea", X.any_phrase(F.col("body"), messages.IDEA_WORDS, True))
    m = materialize(m, "candidates")
    queues.enqueue_slowly(m, f"{base}/jobs", lambda: 0)
    queues.enqueue(m, f"{base}/jobs")  # delivered again
    queues.consume(spark, f"{base}/jobs", f"{base}/results", f"{base}/c1").awaitTermination()
    stored = spark.read.schema("row_id string, nlp_label string, nlp_score float").parquet(f"{base}/results")
    stored.write.parquet(f"{base}/queue")
    apply = lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/applied/{n}")
    queues.write_back_stream(spark, f"{base}/queue", f"{base}/state", f"{base}/c2", apply).awaitTermination()
    return spark.read.parquet(f"{base}/applied/*").select(F.col("row_id").alias("id"), "nlp_label")


# ---- bridge and web tables ---------------------------------------------------------------------------
@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def d1_mark(spark, sf_dir):
    return relations.mark(table(spark, sf_dir, "customer"), F.col("c_acctbal") < 0, "c_mktsegment", F.lit("debt")).select("c_custkey", "c_mktsegment")


@query("""SELECT n_nationkey, CASE n_nationkey WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 9 THEN 2 ELSE n_regionkey END AS "order" FROM nation""")
def d2_reorder(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("order"))
    return relations.reorder(rows, "n_nationkey", [5, 3, 9])


@query("""SELECT file_path, row_id, sent_at FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY file_path NULLS FIRST, sent_at) AS r FROM nlp_jobs) WHERE r = 1 OR row_id IS NULL""")
def d7_d9_unique(spark, sf_dir):
    return relations.unique_by(table(spark, sf_dir, "nlp_jobs").select("file_path", "row_id", "sent_at"), ["row_id"])


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def d10_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return relations.cascade(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey").select("o_orderkey")


@query("""SELECT DISTINCT o_custkey AS user_id, o_orderkey % 50 AS team_id FROM orders WHERE o_custkey < 200 UNION SELECT l_suppkey, l_orderkey % 50 FROM lineitem WHERE l_suppkey < 200""")
def j11_memberships(spark, sf_dir):
    owned = table(spark, sf_dir, "orders").filter("o_custkey < 200").select(F.col("o_custkey").cast("long").alias("user_id"), (F.col("o_orderkey") % 50).cast("long").alias("team_id"))
    joined = table(spark, sf_dir, "lineitem").filter("l_suppkey < 200").select(F.col("l_suppkey").cast("long").alias("user_id"), (F.col("l_orderkey") % 50).cast("long").alias("team_id"))
    return relations.memberships(owned, joined)


@query("""SELECT n_nationkey, n_name, count(s_suppkey) AS n, coalesce(min(s_name), '') AS first FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_name <> 'GONE' GROUP BY 1, 2""")
def d3_d4_collections(spark, sf_dir):
    """Collections with the list of what they hold."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", "s_suppkey")
    held = relations.with_children(table(spark, sf_dir, "nation"), s, "n_nationkey", "s_nationkey", ["s_name", "s_suppkey"], "suppliers")
    return held.select("n_nationkey", "n_name", F.size("suppliers").cast("long").alias("n"), F.coalesce(F.get("suppliers", F.lit(0))["s_name"], F.lit("")).alias("first"))


@query("""SELECT o_custkey, o_orderkey, place, c_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders) JOIN customer ON o_custkey = c_custkey WHERE place <= 2""")
def d8_d11_latest(spark, sf_dir):
    """The two latest orders of each customer, with the name: as comments with their user, or a digest."""
    newest = relations.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey", 2)
    return newest.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_custkey", "o_orderkey", "place", "c_name")


@query("""SELECT o_custkey AS user_id, o_orderkey % 20 AS plan_id FROM orders WHERE o_custkey < 100 AND o_orderkey % 20 <> 3 UNION SELECT c_custkey, 20 FROM customer WHERE c_custkey < 100""")
def d6_attach(spark, sf_dir):
    """A bridge table with rows added that may be there already, and others taken away."""
    held = table(spark, sf_dir, "orders").filter("o_custkey < 100").select(F.col("o_custkey").cast("long").alias("user_id"), (F.col("o_orderkey") % 20).cast("long").alias("plan_id")).distinct()
    new = table(spark, sf_dir, "customer").filter("c_custkey < 100").select(F.col("c_custkey").cast("long").alias("user_id"), F.lit(20).cast("long").alias("plan_id"))
    return relations.detach(relations.attach(relations.attach(held, new), held), spark.createDataFrame([(3,)], "plan_id long"))
