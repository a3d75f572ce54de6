"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import glyphs, grid, leaks, neighbours, personal, tokens
from loomspark.runtime import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf_dir, "message_vectors"), target=0.99, least=0.8)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "message_vectors")).withColumn("similarity", F.round("similarity", 4))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "message_vectors")
    queries = vectors.filter("vec_id % 100 = 0")  # the query set that searches are stated for
    truth = neighbours.exact(vectors, queries).groupBy("id").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("wanted"))
    near = neighbours.nearest(vectors).filter("id % 100 = 0")
    # a neighbour as similar as the tenth true one is as good, whichever of the tied ones it is
    hits = near.join(truth, "id").filter("similarity >= worst - 0.0005").groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    return truth.join(hits, "id", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.sum(F.coalesce("hits", F.lit(0))) / F.sum("wanted"), 4).alias("recall")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_spans(table(spark, sf_dir, "all_messages"), "id", "body", table(spark, sf_dir, "known_names"))
    return found.select(F.col("id").alias("message_id"), "kind", "start_at").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "all_messages").select("id", "body", "ingested_at")
    return personal.redact(messages, "body", table(spark, sf_dir, "known_names"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = grid.cluster_texts(grid.distinct_messages(table(spark, sf_dir, "cluster_data")))
    return members.filter("cluster_size >= 5").select("message_id", "first_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = materialize(grid.distinct_messages(table(spark, sf_dir, "cluster_data")), "messages")
    members, _ = grid.cluster_texts(messages)
    return grid.describe(members, messages)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = tokens.encode_column(docs).select("doc_id", F.size("ids").alias("n_tokens"))
    return docs.select("doc_id", "lang", "n_chars").join(counted, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars")
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).filter("2 * exact_words >= item_words").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.lookalike_pairs(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents look like how many others that aren't the same characters."""
    found = glyphs.lookalike_classes(table(spark, sf_dir, "documents"))
    return found.groupBy("links").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("class_id").alias("n_classes"))


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.consistent_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall,
    "p3_found": p3_found, "p3_clusters": p3_clusters,
    "p2_found": p2_found, "p2_redacted": p2_redacted,
    "p8_ids": p8_ids, "p8_lengths": p8_lengths,
    "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_classes": p10_classes, "p10_texts": p10_texts,
}


# What the SQL takes for alike, typed apart from the operator's table, so that either shows what the other lacks.
_ALIKE = (
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl үy АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW ӀI ҮY "
    "αa γy ιi οo νv ρp υu ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ օo սu հh զq ցg ոn ՕO ՏS ԼL ɑa ɡg "
    "ᎪA ᏴB ᏟC ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ"
).split()
_LIGATURES = "ﬀff ﬁfi ﬂfl ﬃffi ﬄffl ﬅst ﬆst".split()
_SIGNS = [(c, " ") for c in "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"] + [(c, "-") for c in "\u2010\u2011\ufe63\uff0d"]
_SIGNS += [(c, unicodedata.normalize("NFKC", c)) for c in map(chr, (*range(0xFF01, 0xFF5F), 0xFFE0, 0xFFE1, 0xFFE2, 0xFFE4, 0xFFE5, 0xFFE6)) if c != "\uff0d"] + [("\uffe3", "\u00af")]
_UNSEEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"


def _accented() -> list[tuple[str, str]]:
    """Composed letters over a letter of _ALIKE, and the Latin letter under the same accents."""
    latin = {pair[0]: pair[1] for pair in _ALIKE}
    apart = ((c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))))
    return [(c, unicodedata.normalize("NFC", latin[d[0]] + d[1:])) for c, d in apart if len(d) > 1 and d[0] in latin]


def _quoted(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _shape(column: str) -> str:
    """The look-alike form in DuckDB, with accents composed."""
    c = f"regexp_replace(nfc_normalize({column}), '([\\p{{So}}\\p{{Sk}}\\x{{FE0F}}])\\x{{200D}}(\\p{{So}})', '\\1\ue00d\\2', 'g')"
    c = f"nfc_normalize(regexp_replace({c}, '[{_UNSEEN}]', '', 'g'))"
    single = [p for p in _accented() if len(p[1]) == 1] + [(p[0], p[1]) for p in _ALIKE] + _SIGNS
    c = f"translate({c}, {_quoted(''.join(a for a, _ in single))}, {_quoted(''.join(b for _, b in single))})"
    for sign, letters in [p for p in _accented() if len(p[1]) > 1] + [(p[0], p[1:]) for p in _LIGATURES]:
        c = f"replace({c}, '{sign}', '{letters}')"
    return f"nfc_normalize({c})"


# small letters whose capitals look like Latin ones
_WORDS = "list_filter(regexp_split_to_array(translate(lower({}), 'нвкмтβεζηκμτχ', 'hbkmtbezhkmtx'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

SQL: dict[str, str] = {
    "p1_found": """
        WITH v AS (SELECT vec_id, embedding AS e FROM message_vectors WHERE embedding IS NOT NULL AND len(embedding) = 384
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM p)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE place <= 10 AND s >= 0.8""",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(_shape("text"))} AS w FROM documents WHERE text <> ''),
        i AS (SELECT item_id, {_WORDS.format(_shape("text"))} AS w FROM eval_items WHERE text <> ''),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
        ig AS (SELECT item_id, len(w) AS n, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM i)),
        c AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(p, p + 8)) AS q FROM dg JOIN ig USING (g))
        SELECT doc_id, item_id FROM c GROUP BY doc_id, item_id, n HAVING 2 * count(*) >= n""",
    "p10_found": f"""
        WITH d AS (SELECT doc_id, text, {_shape("text")} AS form FROM documents WHERE text IS NOT NULL),
        k AS (SELECT * FROM d WHERE regexp_matches(form, '[^\\s]'))
        SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
}
