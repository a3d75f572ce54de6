"""Reply chains: which ideas hang on an unbroken path, and the text of such paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import second_segment
from loomspark.operators import hierarchy, skew
from loomspark.runtime import materialize


def complete_ideas(messages: DataFrame) -> DataFrame:
    """Ideas whose parents lead to a root within their own subreddit; broken and cyclic chains are left out.

    A parent id is what stands between its first two underscores. Messages of other subreddits don't
    count as parents, so ids are looked up together with the subreddit.
    """
    key = F.concat_ws("/", F.coalesce("subreddit", F.lit("")), "id")
    parent = F.when(F.coalesce("parent_id", F.lit("")) != "", F.concat_ws("/", F.coalesce("subreddit", F.lit("")), second_segment(F.col("parent_id"))))
    keyed = messages.filter("id is not null and id <> ''").withColumn("_key", key)
    states = hierarchy.resolve(keyed, "_key", parent, F.col("link_id"))
    ideas = keyed.filter("is_idea").select("_key", "id", "subreddit").distinct()
    return ideas.join(states.filter("state = 'complete'").select(F.col("id").alias("_key"), "hops"), "_key").select("id", "subreddit", "hops")


def threads(messages: DataFrame, starts: DataFrame, max_hops: int = 100) -> DataFrame:
    """Per start id: bodies from the root to it, and sums and means of votes over that path.

    Paths of more than `max_hops` links, broken and cyclic ones are left out. Null votes count 0 in sums;
    means are over all messages of the path.
    """
    once = messages.filter("id is not null and id <> ''").groupBy("id").agg(
        F.min(F.struct("parent_id", "link_id", "body", "ups", "downs")).alias("r")
    ).select("id", "r.*")
    resolved = hierarchy.message_forest(once.withColumn("trunc_link_id", F.lit(None).cast("string")))
    # ancestors have fewer hops, so what is too deep can go before the paths are made
    ways = hierarchy.paths(resolved.filter((F.col("state") == "complete") & (F.col("hops") <= max_hops)))
    steps = ways.join(starts.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("start_id"), F.posexplode("path").alias("at", "id"))
    # a root lies on the paths of all its descendants
    steps = materialize(steps, "steps")
    load = steps.groupBy("id").agg(F.count(F.lit(1)).alias("load"))
    told = skew.lookup(steps, once.select("id", "body", "ups", "downs").join(load, "id"), "id")
    # a path has at most max_hops + 1 messages, so the list is bounded
    return told.groupBy("start_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("body", F.lit("")).alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("full_thread_body"),
        F.coalesce(F.sum("ups"), F.lit(0)).alias("total_ups"), (F.coalesce(F.sum("ups"), F.lit(0)) / F.count(F.lit(1))).alias("avg_ups"),
        F.coalesce(F.sum("downs"), F.lit(0)).alias("total_downs"), (F.coalesce(F.sum("downs"), F.lit(0)) / F.count(F.lit(1))).alias("avg_downs"),
    )


def nested_set(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant) of rows with id, _lft and _rgt: a range join over sorted intervals."""
    a = nodes.select(F.col("id").alias("ancestor"), F.col("_lft").alias("l"), F.col("_rgt").alias("r"))
    d = nodes.select(F.col("id").alias("descendant"), F.col("_lft").alias("x"))
    width = 4096  # intervals meet only in the blocks they span
    spans = a.withColumn("block", F.explode(F.sequence(F.floor(F.col("l") / width), F.floor(F.col("r") / width))))
    return spans.join(d.withColumn("block", F.floor(F.col("x") / width)), "block").filter("x > l and x < r").select("ancestor", "descendant")
