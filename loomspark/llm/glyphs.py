"""One form for texts that look the same but are written with different characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators.skew import lookup
from loomspark.runtime import materialize

# Letters of other scripts and the Latin letters they look like (after UTS #39).
LOOKALIKE_FROM = (
    "аеорсухѕіјһԁԛԝѵӏү" "АВЕКМНОРСТУХЅІЈԌԚԜӀҮ"  # Cyrillic
    "αγιονρυϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"  # Greek
    "օսհզցո" "ՕՏԼ"  # Armenian
    "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ"  # Cherokee
    "ɑɡ"  # Latin variants
)
LOOKALIKE_TO = (
    "aeopcyxsijhdqwvly" "ABEKMHOPCTYXSIJGQWIY"
    "ayiovpucj" "ABEZHIKMNOPTYXCJ"
    "ouhqgn" "OSL"
    "ABCEHJKLMPRSTVWZ"
    "ag"
)
# Blanks of one width or another, and the signs that are drawn as a hyphen.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
WIDE_SIGNS = {"\uffe0": "\u00a2", "\uffe1": "\u00a3", "\uffe2": "\u00ac", "\uffe3": "\u00af", "\uffe4": "\u00a6", "\uffe5": "\u00a5", "\uffe6": "\u20a9"}
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
JOINED_EMOJI = "\ue00d"  # stands for a joiner that merges two pictures into one, which is visible

# full-width forms follow their ASCII forms at a fixed distance
WIDE_FROM = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F) if chr(c + 0xFEE0) not in HYPHENS)
WIDE_TO = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c + 0xFEE0) not in HYPHENS)


def _spelled(ranges: str) -> str:
    """The characters of a class of single characters and ranges."""
    out, i = [], 0
    while i < len(ranges):
        if ranges[i + 1 : i + 2] == "-":
            out += [chr(c) for c in range(ord(ranges[i]), ord(ranges[i + 2]) + 1)]
            i += 3
        else:
            out.append(ranges[i])
            i += 1
    return "".join(out)


JOINER = "\u200d"
SIGNS_FROM = SPACES + HYPHENS + WIDE_FROM + "".join(WIDE_SIGNS)
SIGNS_TO = " " * len(SPACES) + "-" * len(HYPHENS) + WIDE_TO + "".join(WIDE_SIGNS.values())
GONE = _spelled(INVISIBLE) + JOINER  # translate drops what has no counterpart
SCRIPTS = "".join(chr(c) for c in range(0x370, 0x590))  # the blocks of Greek, Cyrillic and Armenian
HOT_ROWS = 100_000  # documents of one text that are put into pairs by one task
MARKS = "".join(chr(c) for c in range(0x300, 0x370) if chr(c) not in GONE)


def _not_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def _mapped(text: Column, extra_from: str = "", extra_to: str = "") -> Column:
    """Translation is one pass without a pattern; the patterns run only on the few texts that need them."""
    joined = F.when(
        text.contains(JOINER), F.regexp_replace(text, "([\\p{So}\\p{Sk}\ufe0f])" + JOINER + "(?=\\p{So})", "$1" + JOINED_EMOJI)
    ).otherwise(text)
    opened = joined
    for sign, letters in LIGATURES.items():
        opened = F.replace(opened, F.lit(sign), F.lit(letters))
    c = F.when(F.translate(text, "".join(LIGATURES), "") != text, opened).otherwise(joined)
    return F.when(_not_ascii(text), F.translate(c, SIGNS_FROM + extra_from + GONE, SIGNS_TO + extra_to)).otherwise(text)


def plain_signs(text: Column) -> Column:
    """Without invisible characters; spaces, hyphens, wide forms and ligatures in their plain form."""
    return _mapped(text)


def _normal(text: Column, way: str) -> Column:
    """Accents apart ("decompose") or in one letter ("compose"), by the ICU library of Spark's collations; not for nulls."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(way), text, F.lit(False))


def skeleton(text: Column) -> Column:
    """`plain_signs` with look-alike letters of other scripts mapped to Latin ones, in composed form.

    Accents are taken apart first, so an accented letter is mapped like the letter below its accent.
    """
    # as a list of one, since an expression that is named several times is evaluated as often
    apart = F.array(_normal(text, "decompose"))
    shape = F.transform(apart, lambda t: _mapped(t, LOOKALIKE_FROM, LOOKALIKE_TO))
    return F.when(_not_ascii(text), _normal(F.get(shape, F.lit(0)), "compose")).otherwise(text)


def is_visible(text: Column) -> Column:
    """Whether the text holds anything but blanks and invisible characters; looks no further than the first."""
    return text.rlike(f"[^\\s{SPACES}{INVISIBLE}{JOINER}]")


def oddness(text: Column) -> Column:
    """How many characters are unusual: invisible, wide, special blanks, marks, mixed scripts in a word."""
    signs = F.length(text) - F.length(F.translate(text, SIGNS_FROM + GONE + MARKS + "".join(LIGATURES), ""))
    other = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]"
    mixed = F.when(
        F.translate(text, SCRIPTS, "") != text, F.regexp_count(text, F.lit(rf"\p{{IsLatin}}(?={other})|{other}(?=\p{{IsLatin}})"))
    ).otherwise(0)
    return F.when(_not_ascii(text), signs + mixed).otherwise(0)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_oddness: bool = False) -> DataFrame:
    """(doc_id, variant, shape, mark, letters, odd, form) of the documents with visible text, as a stored table.

    variant is the text's digest, shape that of its mapped form. mark and letters are short hashes of the form and of its
    letters and digits alone, by which later stages tell what has to be compared. odd is null unless asked for.
    """
    text = F.col(text_col)
    odd = oddness(text) if with_oddness else F.lit(None).cast("int")
    rows = docs.filter(is_visible(text)).select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_col, 256)).alias("variant"), odd.alias("odd"), skeleton(text).alias("form"))
    letters = F.xxhash64(F.regexp_replace("form", r"[^\p{L}\p{N}]+", ""))
    return materialize(
        rows.select("doc_id", "variant", F.unhex(F.sha2("form", 256)).alias("shape"), F.xxhash64("form").alias("mark"), letters.alias("letters"), "odd", "form"), "text-rows"
    )


def text_classes(rows: DataFrame) -> DataFrame:
    """(variant, class_id, odd, load, holder): one row per distinct text of `text_rows`.

    Texts are alike if their forms are equal under Spark's UNICODE collation. That collation heeds accents and case, but
    not how an accent is written, nor control characters. Forms can be equal under it only if their letters and digits are,
    so nothing but forms of the same letters is compared by it, and only where there are several. class_id is the least
    shape of the class, load counts the rows of the text and holder is the least document that has it.
    """
    # copies meet here with map-side combining, and no text is shuffled: a text stored very often is one row from here on
    variants = rows.groupBy("variant", "shape").agg(F.min("odd").alias("odd"), F.count(F.lit(1)).alias("load"), F.min("doc_id").alias("holder"))
    several = rows.groupBy("letters").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low <> high").select("letters")
    compared = rows.join(several, "letters", "left_semi").groupBy("letters", "shape").agg(F.any_value("form").alias("form"))
    alike = Window.partitionBy("letters", F.collate("form", "UNICODE"))  # distinct forms, of which few are equal under it
    joined = compared.repartition("letters").select("shape", F.min("shape").over(alike).alias("class_id")).filter("shape <> class_id")
    joined = materialize(joined, "joined-shapes")
    named = variants if joined.isEmpty() else variants.join(joined, "shape", "left")
    class_id = F.col("shape") if joined.isEmpty() else F.coalesce("class_id", "shape")
    return materialize(named.select("variant", class_id.alias("class_id"), "odd", "load", "holder"), "classes")


def lookalike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links): one row per document with visible text.

    links counts the documents that look the same but aren't the same characters. Null, empty and blank
    texts are in no class. Other columns are ignored.
    """
    rows = text_rows(docs, id_col, text_col)
    classes = text_classes(rows)
    total = classes.groupBy("class_id").agg(F.sum("load").alias("all"), F.count(F.lit(1)).alias("variants"))
    table = classes.join(total, "class_id").select("variant", "class_id", (F.col("all") - F.col("load")).alias("links"), "load")
    return lookup(rows.select("doc_id", "variant"), materialize(table, "links"), "variant").select("doc_id", "class_id", "links")


def consistent_texts(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and text: for every class the plain form of its canonical member.

    That is the text with the fewest unusual characters, then of the least digest. Null, empty and blank texts come out as
    they are, with a null class.
    """
    rows = text_rows(docs, with_oddness=True)
    classes = text_classes(rows)
    chosen = classes.groupBy("class_id").agg(F.min(F.struct("odd", "variant", "holder")).alias("best")).select("class_id", F.col("best.holder").alias("holder"))
    plain = F.replace(plain_signs(F.col("text")), F.lit(JOINED_EMOJI), F.lit(JOINER))
    texts = materialize(docs.select(F.col("doc_id").alias("holder"), plain.alias("plain")).join(chosen, "holder").select("class_id", "plain"), "canonical")
    # a class by its number of rows, so that a text stored very often is no one task's work
    loads = classes.groupBy("class_id").agg(F.sum("load").alias("load"))
    members = lookup(rows.select("doc_id", "variant"), classes.select("variant", "class_id", "load"), "variant")
    placed = lookup(members.select("doc_id", "class_id"), texts.join(loads, "class_id"), "class_id")
    return docs.select("doc_id", "text").join(placed, "doc_id", "left").select("doc_id", "class_id", F.coalesce("plain", "text").alias("text"))


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b): documents of a class whose stored texts differ. `lookalike_classes` gives the same without pairs.

    Variants of a class are paired first; documents are put in for each pair of variants, so copies
    of one text are never compared with each other. A text of very many documents is put in in parts.
    """
    rows = text_rows(docs)
    classes = text_classes(rows)
    several = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class_id")
    variants = materialize(classes.join(several, "class_id", "left_semi").withColumn("parts", F.ceil(F.col("load") / HOT_ROWS)), "several")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    members = materialize(lookup(rows.select("doc_id", "variant"), variants.select("variant", "class_id", "parts", "load"), "variant").select("doc_id", "variant", part.alias("part")), "members")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda i: variants.select("class_id", F.col("variant").alias(f"v{i}"), F.col("parts").alias(f"n{i}"))
    pairs = side(1).join(side(2), "class_id").filter("v1 < v2").select("v1", "v2", every("n1").alias("p1"), "n2").select("v1", "v2", "p1", every("n2").alias("p2"))
    one, two = (members.select(F.col("variant").alias(f"v{i}"), F.col("part").alias(f"p{i}"), F.col("doc_id").alias(f"d{i}")) for i in (1, 2))
    return pairs.join(one, ["v1", "p1"]).join(two, ["v2", "p2"]).select(F.least("d1", "d2").alias("doc_a"), F.greatest("d1", "d2").alias("doc_b"))
