"""Text and id expressions; all native, none needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's dot also stops at \r and other line ends; (?d) limits it to \n
UNIX_LINES = "(?d)"


def bare_id(c: Column) -> Column:
    """An id without type prefix, capitals, white space or invisible characters; '' and null stay."""
    squeezed = F.lower(F.regexp_replace(c, r"[\s\p{Z}\p{Cf}]+", ""))
    return F.regexp_replace(squeezed, r"^t\d_", "")


def strip_type(c: Column) -> Column:
    """A reference without its `t1_` / `t3_` prefix, otherwise as stored."""
    return F.regexp_replace(F.trim(c), r"^[tT]\d_", "")


def second_segment(c: Column) -> Column:
    """Text between the first and second underscore, or the whole text if there is none."""
    return F.when(c.contains("_"), F.split(c, "_")[1]).otherwise(c)


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "_"), -1)


def name_prefix(c: Column, n: int = 2) -> Column:
    """First n code points, only letters, digits and underscores, in lower case."""
    return F.lower(F.regexp_replace(F.substring(c, 1, n), r"[^\p{L}\p{N}_]", ""))


def path_name(c: Column) -> Column:
    """ASCII letters, digits, hyphen and underscore in lower case; '_' for an empty name."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("_")).otherwise(
        F.lower(F.regexp_replace(c, r"[^A-Za-z0-9\-_]", ""))
    )


def dir_name(c: Column) -> Column:
    """Letters, digits and underscores; case is kept."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")


def any_phrase(c: Column, phrases: list[str], ignore_case: bool = False) -> Column:
    """True where one of the patterns occurs."""
    flags = "(?di)" if ignore_case else UNIX_LINES
    return c.rlike(flags + "|".join(f"(?:{p})" for p in phrases))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def share_of(c: Column, pattern: str) -> Column:
    """Matches of a pattern per code point; an empty text counts as one code point."""
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


def month_tag(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "MMyy")


def epoch_text(epoch: Column) -> Column:
    """'YYYY-mm-dd HH:MM:SS' in UTC; null where the value is not a number."""
    seconds = epoch.try_cast("double").cast("long")
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def round_to_long(c: Column) -> Column:
    """Half-to-even rounding, unlike a cast, which cuts the fraction off."""
    return F.rint(c).cast("long")


def repair_json(c: Column) -> Column:
    r"""Model output without code fences and with every backslash doubled that starts no escape of JSON.

    Escapes are read in pairs from the left, so a doubled backslash stays as it is, whatever follows; `\u` is one
    only before four hexadecimal digits.
    """
    unfenced = F.regexp_replace(F.trim(c), r"(?m)^```(?:json)?\s*|\s*```$", "")
    return F.trim(F.regexp_replace(unfenced, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})', r"$1\\\\"))


def fenced_json(c: Column) -> Column:
    """What stands in the first fence marked as JSON to the last fence; '' without one."""
    return F.regexp_extract(c, r"(?s)```json\n(.*)\n```", 1)


def stable_uuid(*parts: Column) -> Column:
    """An id in the form of a UUID that depends on the columns only; nulls count as ''. For random ids there is `F.uuid()`."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])


def says_yes(c: Column) -> Column:
    return F.upper(c).contains("YES")


def tsv_field(c: Column) -> Column:
    r"""A tab-separated field: backslash doubled, tab and line feed to blank, null to \N."""
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.translate(doubled, "\t\n", "  "), F.lit("\\N"))


def shorten(c: Column, n: int = 250) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def glob_match(c: Column, glob: str) -> Column:
    """Case-insensitive shell pattern with * and ?."""
    parts = {"*": ".*", "?": "."}
    body = "".join(parts.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in glob)
    return c.rlike(f"(?is)^{body}$")
