"""Full-text search over a stored index of terms; filters, paging, facets and samples over document tables."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.vectors import cosine
from loomspark.sources.sinks import exists

K1, B = 1.2, 0.75  # the usual constants of the Okapi formula
# Names that the interface gives to sort columns.
SORTS = {"date": "created_at", "popularity": "total_ups"}


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_words(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})


@dataclass
class Index:
    """An inverted table: `postings` (part, term, field, id, tf, len), `fields` (field, n, mean)."""

    spark: SparkSession
    path: str
    parts: int
    id_type: str

    @property
    def postings(self) -> DataFrame:
        # an index of no documents has no file to take the schema from
        schema = f"term string, field string, id {self.id_type}, tf int, len int, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    @property
    def fields(self) -> DataFrame:
        return self.spark.read.schema("field string, n long, mean double").parquet(f"{self.path}/fields")


def build_index(docs: DataFrame, path: str, id_col: str, fields: list[str], parts: int = 64) -> Index:
    """Write the terms of the fields once: one row per term, field and document, in folders by the term's hash.

    Nested fields count with all text they hold. Null fields don't count as documents of the field, empty ones do. Files are sorted
    by term, so a query reads the folders of its words and there the row groups that hold them. Ids must be
    unique. A term in very many documents is spread over several files.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    text = {f: F.col(f) if kinds[f] == "string" else F.to_json(f) if kinds[f] in ("struct", "array", "map") else F.col(f).cast("string") for f in fields}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in text.items()]))
    long = docs.select(F.col(id_col).alias("id"), each.alias("e")).select("id", "e.field", terms(F.col("e.text")).alias("terms")).filter("terms is not null")
    long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")
    tf = long.select("id", "field", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("id", "field", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    placed = tf.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", "field", "id", "tf", "len")
    # range partitioning spreads a frequent term over tasks
    ordered = placed.repartitionByRange("part", "term", "id").sortWithinPartitions("part", "term")
    ordered.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{path}/postings")
    return Index(spark, path, parts, dict(docs.dtypes)[id_col])


def open_index(docs: DataFrame, path: str, id_col: str, fields: list[str], parts: int = 64) -> Index:
    """The index at `path`, built there if it is missing."""
    if exists(docs.sparkSession, f"{path}/postings/_SUCCESS"):
        return Index(docs.sparkSession, path, parts, dict(docs.dtypes)[id_col])
    return build_index(docs, path, id_col, fields, parts)


def part_of(spark: SparkSession, words: list[str], parts: int) -> list[int]:
    """Folders of a query's words; as many rows as the query has words."""
    marks = spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    return sorted({r[0] for r in marks.collect()})


def relevance(index: Index, query: str, boosts: dict[str, float]) -> DataFrame:
    """(id, score) of the documents with any word of the query: the best boosted Okapi BM25 score of the fields, to nine digits.

    Only the postings of the query's words are read. Lengths and document frequencies are over all documents with a value in the
    field. A query without words finds nothing.
    """
    spark, words = index.spark, query_words(query)
    if not words or not boosts:
        return index.postings.select("id").withColumn("score", F.lit(0.0)).filter("false")
    of_word = F.col("part").isin(part_of(spark, words, index.parts)) & F.col("term").isin(words)
    hits = index.postings.filter(of_word & F.col("field").isin(list(boosts)))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # words times fields rows
    weight = spark.createDataFrame([(f, float(b)) for f, b in boosts.items()], "field string, boost double")
    known = F.broadcast(index.fields.join(weight, "field").join(df, "field").select("field", "term", (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("boost")).alias("idf"), "mean"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean"))
    scored = hits.join(known, ["field", "term"]).select("id", "field", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("s"))
    return scored.groupBy("id", "field").agg(F.sum("s").alias("s")).groupBy("id").agg(F.round(F.max("s"), 9).alias("score"))


def filtered(docs: DataFrame, equal: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """Rows that match all given values and bounds; None means no filter, a bound of 0 is a bound."""
    out = docs
    for column, value in (equal or {}).items():
        if value is not None and value != "":
            out = out.filter(F.col(column) == F.lit(value))
    for column, (low, high) in (ranges or {}).items():
        if low is not None:
            out = out.filter(F.col(column) >= low)
        if high is not None:
            out = out.filter(F.col(column) <= high)
    return out


def sort_key(sort: str, columns: list[str]) -> tuple[str, bool]:
    """(column, descending) of e.g. 'viability_score_desc'; names of several words keep their underscores."""
    name, _, way = sort.rpartition("_")
    if way not in ("asc", "desc"):
        raise ValueError(f"sort must end in _asc or _desc: {sort}")
    column = SORTS.get(name, name)
    if column not in columns:
        raise ValueError(f"no column {column}")
    return column, way == "desc"


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 10, largest: int = 100) -> DataFrame:
    """A page of a total order; the page number is at least 1, the size from 1 to `largest`."""
    size = min(max(1, size), largest)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def search(docs: DataFrame, id_col: str, index: Index | None = None, boosts: dict[str, float] | None = None, query: str = "", equal: dict | None = None, ranges: dict | None = None, sort: str = "", number: int = 1, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(page, total) of a search: filters, relevance if there is a query, then the sort or the score, ties by id.

    Without a query every row counts, with a score of 0. A column `score` of the documents is replaced.
    """
    rows = filtered(docs, equal, ranges).drop("score")
    if query_words(query) and index is not None:
        found = relevance(index, query, boosts or {}).withColumnRenamed("id", id_col)
        rows = rows.join(found, id_col)
    elif query:
        rows = rows.withColumn("score", F.lit(0.0)).filter("false")
    else:
        rows = rows.withColumn("score", F.lit(0.0))
    if sort:
        column, down = sort_key(sort, docs.columns)
        order = [F.desc(column) if down else F.asc(column), F.asc(id_col)]
    else:
        order = [F.desc("score"), F.asc(id_col)]
    return page(rows, order, number, size), rows.agg(F.count(F.lit(1)).alias("total"))


def by_id(docs: DataFrame, id_col: str, wanted) -> DataFrame:
    """The document with an id, or no row; the filter reaches the scan."""
    return docs.filter(F.col(id_col) == F.lit(wanted))


def sample(df: DataFrame, size: int, seed: int, equal: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, total): `size` of the rows that match, in an order that depends on the seed and the rows only, and how many match.

    The order is a hash of the row, so it is the same however the table is laid out.
    """
    rows = filtered(df, equal)
    mark = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    return rows.orderBy(mark, *df.columns).limit(size), rows.agg(F.count(F.lit(1)).alias("total"))


def random_row(df: DataFrame, order: list[Column], seed: int) -> DataFrame:
    """One row at a random place of a total order; no row of an empty table."""
    n = df.count()
    return df.orderBy(*order).offset(random.Random(seed).randrange(n) if n else 0).limit(1)


def contains_any(df: DataFrame, columns: list[str], words: str, extra: Column | None = None) -> DataFrame:
    """Rows with `words` in any of the columns, and (not or) the extra condition."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).contains(words), F.lit(False))
    return df.filter(hit & extra) if extra is not None else df.filter(hit)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of every column's values, counted in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def similar_to(vectors: DataFrame, id_col: str, column: str, query: list[float], k: int) -> DataFrame:
    """(id, similarity): the k most similar vectors to one, exactly; a top-k, not a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(column), q).alias("similarity")).filter("similarity is not null").orderBy(F.desc("similarity"), "id").limit(k)
