"""Set operations and bridge-table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def same_schema_union(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns; differing schemas are an error."""
    out = parts[0]
    for part in parts[1:]:
        if set(part.dtypes) != set(out.dtypes):
            raise ValueError(f"schemas differ: {out.dtypes} and {part.dtypes}")
        out = out.unionByName(part)
    return out


def attach(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """Bridge rows plus those of `new` that aren't there yet."""
    return bridge.unionByName(new.distinct().join(bridge, bridge.columns, "left_anti"))


def detach(bridge: DataFrame, gone: DataFrame) -> DataFrame:
    return bridge.join(gone, gone.columns, "left_anti")


def through(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of both sides that a bridge table connects."""
    return left.join(bridge, left_key).join(right, right_key)


def with_any_tag(rows: DataFrame, key: str, taggables: DataFrame, tags: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """Rows of one kind that have at least one of the tags."""
    wanted = taggables.filter(F.col("taggable_type") == kind).join(tags.filter(F.col("name").isin(names)), "tag_id", "left_semi")
    return rows.join(wanted.select(F.col("taggable_id").alias(key)), key, "left_semi")


def reorder(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Column `order` set to the place in the given list; others keep theirs."""
    kind = dict(rows.dtypes)[key]
    place = F.array_position(F.array(*[F.lit(o) for o in order]).cast(f"array<{kind}>"), F.col(key)) - 1
    return rows.withColumn("order", F.when(place >= 0, place).otherwise(F.col("order")))


def mark(rows: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def cascade(children: DataFrame, gone: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent isn't among the deleted ones; a null reference stays."""
    return children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def unique_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the least; rows with a null in the key are all kept, as in SQL's UNIQUE."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    rest = [c for c in rows.columns if c not in keys]
    once = rows.filter(full).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return once.select(*rows.columns).unionByName(rows.filter(~full))


def memberships(owned: DataFrame, joined: DataFrame) -> DataFrame:
    """Distinct rows of both: what someone owns and what they are a member of."""
    return same_schema_union([owned, joined]).distinct()


def with_children(parents: DataFrame, children: DataFrame, key: str, foreign: str, item: list[str], name: str, most: int | None = None) -> DataFrame:
    """Parents with the list `name` of their children's `item` columns in order; an empty list without children.

    With `most`, the first so many are listed, and no more than these are brought together.
    """
    rows = children.select(F.col(foreign).alias(key), F.struct(*item).alias("_c")).filter(F.col(key).isNotNull())
    if most is not None:
        first = Window.partitionBy(key).orderBy("_c")
        rows = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most).drop("_r")
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list("_c")).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def latest(rows: DataFrame, key: str, at: str, tie: str, most: int) -> DataFrame:
    """The `most` newest rows of each key, the newest first in column `place`."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.col(tie))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
