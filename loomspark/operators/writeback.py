"""Results joined back to the rows they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_results(results: DataFrame, key: str = "row_id") -> DataFrame:
    """One result per key: the least by label and score, so that repeated ones don't multiply rows. NaN scores are 0."""
    clean = results.filter(F.col(key).isNotNull()).select(key, "nlp_label", F.nanvl("nlp_score", F.lit(0.0).cast("float")).alias("nlp_score"))
    return clean.groupBy(key).agg(F.min(F.struct("nlp_label", "nlp_score")).alias("r")).select(key, "r.*")


def write_back(messages: DataFrame, results: DataFrame, reset: bool = True) -> DataFrame:
    """Messages with is_idea and nlp_top_score from results (row_id, nlp_label, nlp_score).

    With `reset`, a label other than 'idea' sets is_idea to false; otherwise it only ever becomes true.
    Without a label, or without a result, the old values stay.
    """
    r = best_results(results).withColumnsRenamed({"row_id": "id", "nlp_label": "_label", "nlp_score": "_score"})
    is_label = F.col("_label") == "idea"
    idea = F.when(F.col("_label").isNotNull(), is_label) if reset else F.when(is_label, F.lit(True))
    return messages.join(r, "id", "left").withColumns(
        {"is_idea": F.coalesce(idea, F.col("is_idea")), "nlp_top_score": F.coalesce("_score", "nlp_top_score")}
    ).drop("_label", "_score")


def set_plan_ids(ideas: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Ideas with generated_plan from updates (keys, plan_id); the old value stays where there is none."""
    one = updates.groupBy(*keys).agg(F.max("plan_id").alias("plan_id"))
    return ideas.join(one, keys, "left").withColumn("generated_plan", F.coalesce("plan_id", "generated_plan")).drop("plan_id")


def merge_plans(plans: DataFrame, ideas: DataFrame, keys: list[str], suffix: str = "_idea") -> DataFrame:
    """Plans with their ideas; columns of ideas that clash get the suffix. Nulls in keys match nothing."""
    clash = [c for c in ideas.columns if c in plans.columns and c not in keys]
    return plans.join(ideas.withColumnsRenamed({c: c + suffix for c in clash}), keys)


def pending(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def same_threads(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """All messages of the threads (link_id) that hold a wanted id."""
    links = messages.join(wanted.select("id").distinct(), "id", "left_semi").select("link_id").filter("link_id is not null").distinct()
    return messages.join(links, "link_id", "left_semi")


def id_status(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """n, found and status: 0 none, 1 some, 2 all of the wanted ids are stored."""
    mark = wanted.select("id").distinct().join(stored.select("id").distinct().withColumn("_in", F.lit(1)), "id", "left")
    counted = mark.agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("found"))
    return counted.withColumn("status", F.when(F.col("found") == 0, 0).when(F.col("found") < F.col("n"), 1).otherwise(2))


def resume_points(lines: DataFrame, stored: DataFrame, file: str = "file_path", line: str = "line_number") -> DataFrame:
    """(file, lines, resume): the line after the last one whose id is stored, 0 if none is, per file.

    One join instead of probing samples: exact also if stored lines don't form a prefix. Null ids are never stored.
    """
    mark = stored.select("id").distinct().withColumn("_in", F.lit(True))
    found = lines.join(mark, "id", "left").groupBy(file)
    return found.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.max(F.when(F.col("_in"), F.col(line) + 1)), F.lit(0)).cast("long").alias("resume"))
