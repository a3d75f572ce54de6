"""Clusters rolled up to ideas and opportunities, and statistics about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark import schemas

# Fixed value: words that mark action.
ACTION = r"(?i)(build|create|develop|solve|implement|design)"


def cluster_rollup(members: DataFrame, keys: list[str], sort: str = "id", part_rows: int = 100_000) -> DataFrame:
    """Texts, ids, votes and size per cluster, and `part`; noise (-1) is left out, missing sums are 0.

    The lists are what a cluster is handed on as, in the order of the ids. A cluster of more than `part_rows` members has several
    rows, parts 0, 1 and so on by the hash of the id, so that no list outgrows a row; its figures are those of each part.
    """
    text = schemas.first_column(members.columns, schemas.TEXT_COLUMNS)
    ups = "ups" if "ups" in members.columns else "score"
    rows = members.filter("cluster_id >= 0")
    large = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts")).filter("_parts > 1")  # fewer than rows / part_rows
    part = F.pmod(F.xxhash64(F.col(sort).cast("string")), F.coalesce("_parts", F.lit(1).cast("long"))).cast("int")
    rows = rows.join(F.broadcast(large), keys, "left").withColumn("part", part)
    item = F.sort_array(F.collect_list(F.struct(F.col(sort).cast("string").alias("i"), F.col(text).alias("t"))))
    downs = F.coalesce(F.sum("downs"), F.lit(0)) if "downs" in members.columns else F.lit(0)
    return rows.groupBy(*keys, "part").agg(
        item.alias("items"), F.coalesce(F.sum(ups), F.lit(0)).cast("long").alias("total_ups"), downs.cast("long").alias("total_downs"),
        F.count(F.lit(1)).alias("message_count"),
    ).select(
        *keys, "part", F.transform("items", lambda x: x["t"]).alias("texts"), F.transform("items", lambda x: x["i"]).alias("message_ids"),
        "total_ups", "total_downs", "message_count",
    )


def opportunities(members: DataFrame, keys: list[str], first: int = 10, sort: str = "id") -> DataFrame:
    """Size, mean of the first score column that has one (else 0.0), and the first texts by id."""
    text = schemas.first_column(members.columns, schemas.TEXT_COLUMNS)
    scores = [F.avg(c) for c in schemas.SCORE_COLUMNS if c in members.columns]
    rows = members.filter("cluster_id >= 0")
    order = Window.partitionBy(*keys).orderBy(sort)
    # only the first few texts of a cluster are brought together
    heads = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= first).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(text).alias("t")))), lambda x: x["t"]).alias("representative_texts")
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cluster_size"), F.coalesce(*scores, F.lit(0.0)).cast("double").alias("avg_quality_score"))
    return sizes.join(heads, keys)


def cluster_quality(members: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Score 0 to 7 by mean length (2), share of texts with figures (2) and with action words (3)."""
    share = lambda pattern: F.avg(F.coalesce(F.col(text).rlike(pattern), F.lit(False)).cast("double"))
    return members.groupBy(*keys).agg(
        (
            F.when(F.avg(F.length(text)) > 200, 2).otherwise(0) + F.when(share(r"\d+") > 0.3, 2).otherwise(0)
            + F.when(share(ACTION) > 0.4, 3).otherwise(0)
        ).alias("quality")
    )


def good_clusters(members: DataFrame, keys: list[str], text: str, least: int = 5) -> DataFrame:
    good = cluster_quality(members, keys, text).filter(F.col("quality") >= least)
    return members.join(good.select(*keys), keys, "left_semi")


def cluster_stats(members: DataFrame) -> DataFrame:
    """Number of clusters and of noise rows."""
    return members.agg(
        F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"),
        F.sum(F.when(F.col("cluster_id") < 0, 1).otherwise(0)).alias("n_noise"),
    )


def completion(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct wanted rows, how many are done, and the percentage."""
    w, d = wanted.distinct(), done.distinct().withColumn("_d", F.lit(1))
    return w.join(d, w.columns, "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("_d").alias("done")).withColumn(
        "percent", F.when(F.col("wanted") > 0, 100.0 * F.col("done") / F.col("wanted")).otherwise(0.0)
    )
