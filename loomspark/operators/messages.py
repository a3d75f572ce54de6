"""Raw items to one message table: normalise, filter, flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import any_phrase, name_prefix, share_of, word_count

# Phrases that mark speculation and complaints.
EXCLUDED = [
    "why doesn't someone", "wouldn't it be cool if", "in a perfect world", "they should just", "if I won the lottery",
    "magical solution", "cure for cancer", "world peace", "free .* for everyone",
]
# Words that mark an idea.
IDEA_WORDS = [
    "idea", "solution", "concept", "opportunity", "build", "create", "develop", "imagine", "what if", "improve", "new way", "innovate",
]
# Fixed value: what counts as a figure that supports a text.
DETAIL = r"\$\d+|[0-9]+%|\d+ (users|customers|months)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def submissions(items: DataFrame) -> DataFrame:
    """Starting posts: link_id is the name, no parent, body is title, line feed, selftext."""
    return items.select(
        _text("id").alias("id"), _text("name").alias("link_id"), F.lit(None).cast("string").alias("parent_id"),
        *[_text(c).alias(c) for c in ("subreddit", "author")],
        F.concat(_text("title"), F.lit("\n"), _text("selftext")).alias("body"), _text("permalink").alias("permalink"),
        *[_number(c).alias(c) for c in ("created_utc", "ups", "downs")], "distinguished",
    )


def comments(items: DataFrame) -> DataFrame:
    return items.select(
        *[_text(c).alias(c) for c in ("id", "link_id", "parent_id", "subreddit", "author", "body", "permalink")],
        *[_number(c).alias(c) for c in ("created_utc", "ups", "downs")], "distinguished",
    )


def by_people(df: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Without authors that have 'bot' in their name (also inside a word), and without moderators' posts."""
    author = F.lower("author") if ignore_case else F.col("author")
    mod = F.coalesce(F.col("distinguished").isin("moderator", "admin"), F.lit(False))
    return df.filter(~F.coalesce(author.contains("bot"), F.lit(False)) & ~mod)


def engaging(df: DataFrame, least: float = 5.0) -> DataFrame:
    """0.8 * ups + 0.2 * length of the body above `least`."""
    return df.filter(F.col("ups") * 0.8 + F.length("body") * 0.2 > least)


def quality_score(body: Column, ups: Column) -> Column:
    """Votes, halved for shouting, raised by half for long texts with figures; 0 for an empty text."""
    loud = (share_of(body, "!") > 0.05) | (share_of(body, r"\p{Lu}") > 0.3)
    detailed = body.rlike(DETAIL) & (word_count(body) > 100)
    score = F.coalesce(ups.cast("double"), F.lit(0.0)) * F.when(loud, 0.5).otherwise(1.0) * F.when(detailed, 1.5).otherwise(1.0)
    return F.when(F.coalesce(body, F.lit("")) == "", 0.0).otherwise(score)


def flagged(df: DataFrame, idea_words: list[str] | None = None, ignore_case: bool = True) -> DataFrame:
    """Adds prefix, keyword flag and the empty result columns."""
    return df.withColumns(
        {
            "sanitized_prefix": name_prefix(F.col("subreddit")),
            "cpu_filter_is_idea": any_phrase(F.col("body"), idea_words or IDEA_WORDS, ignore_case),
            "is_idea": F.lit(False),
            "nlp_top_score": F.lit(None).cast("float"),
        }
    )


def message_table(items: DataFrame, kind: Column, idea_words: list[str] | None = None) -> DataFrame:
    """Raw items, told apart by `kind`, to the message table; one pass over each kind, no shuffle."""
    both = submissions(items.filter(kind == "submission")).unionByName(comments(items.filter(kind == "comment")))
    kept = engaging(by_people(both)).filter(~any_phrase(F.col("body"), EXCLUDED))
    return flagged(kept, idea_words).drop("distinguished")


def nlp_candidates(messages: DataFrame) -> DataFrame:
    """Flagged messages that haven't been classified."""
    return messages.filter("cpu_filter_is_idea and not is_idea and nlp_top_score is null").select("id", "body")


def long_enough(df: DataFrame, column: str, least: int) -> DataFrame:
    return df.filter(F.length(column) > least)


def large_groups(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of groups with at least `least` rows."""
    big = df.groupBy(key).count().filter(F.col("count") >= least).select(key)
    return df.join(big, key, "left_semi")


def with_default(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, value)


def validated(df: DataFrame) -> DataFrame:
    """Rows with an id, a subreddit of two characters or more and a body; the body is trimmed."""
    trimmed = df.withColumn("body", F.trim("body"))
    return trimmed.filter("id <> '' and length(subreddit) >= 2 and body <> ''")


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in the columns, which become strings."""
    return df.dropna(subset=columns).withColumns({c: F.col(c).cast("string") for c in columns})


def json_fields(df: DataFrame, column: str, defaults: dict[str, str | None]) -> DataFrame:
    """Fields of a JSON object as columns, with a default where the object or the field is missing or null."""
    found = {f: F.coalesce(F.get_json_object(column, f"$.{f}"), F.lit(d)) for f, d in defaults.items()}
    return df.withColumns(found)


def plan_candidates(ideas: DataFrame) -> DataFrame:
    """Viable ideas for software that one person can build, without a plan yet; a null flag is no."""
    flags = ("is_viable_business", "is_saas", "is_solo_entrepreneur_possible")
    out = ideas
    for flag in flags:
        out = out.filter(F.coalesce(F.col(flag), F.lit(False)))
    if "generated_plan" not in ideas.columns:
        return out
    return out.filter(F.coalesce("generated_plan", F.lit("")) == "")


def scored_at_least(df: DataFrame, answer: str, least: float = 7.0) -> DataFrame:
    """Rows whose JSON answer has a `score` of at least `least`; an answer without one doesn't."""
    return df.filter(F.coalesce(F.get_json_object(answer, "$.score").try_cast("double"), F.lit(0.0)) >= least)


def with_time(df: DataFrame, column: str = "created_utc") -> DataFrame:
    """The column as a time, from epoch seconds or ISO text; null where it is neither."""
    text = F.col(column).cast("string")
    seconds = F.timestamp_seconds(text.try_cast("double"))
    return df.withColumn(column, F.coalesce(seconds, F.try_to_timestamp(text)))
