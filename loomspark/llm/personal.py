"""Personal data in free text: find spans, score them, replace them with typed placeholders."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NAMES = 1_000_000  # entries of a name list that are sent to the tasks
ACCEPT = 0.5

# ---- e-mail -------------------------------------------------------------------------------------
_LOCAL = r"[\w.+%'-]{0,63}[\w+]"
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s{1,3}dot\s{1,3})"
_LABEL = r"[\w-]{1,63}"  # all parts are bounded, so that no text makes a search quadratic
EMAIL = re.compile(
    rf"(?<![\w.@/]){_LOCAL}{_AT}[^\W_][\w-]{{0,62}}(?:{_DOT}[^\W_][\w-]{{0,62}}){{0,6}}{_DOT}[^\W\d_]{{2,24}}(?![\w@])", re.IGNORECASE
)
SPOKEN_EMAIL = re.compile(
    rf"(?<![\w.@/]){_LOCAL}(?:\s{{1,3}}dot\s{{1,3}}[\w+-]{{1,63}}){{0,6}}\s{{1,3}}at\s{{1,3}}{_LABEL}(?:\s{{1,3}}dot\s{{1,3}}{_LABEL}){{0,6}}\s{{1,3}}dot\s{{1,3}}[^\W\d_]{{2,24}}(?!\w)", re.IGNORECASE
)
SPOKEN_LOCAL = re.compile(
    rf"(?<![\w.@/])[\w+-]{{1,63}}(?:\s{{1,3}}dot\s{{1,3}}[\w+-]{{1,63}}){{1,6}}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{0,6}}{_DOT}[^\W\d_]{{2,24}}(?!\w)", re.IGNORECASE
)

# ---- phone: pattern and score before context ------------------------------------------------------
_EXT = r"(?:\s?(?:ext\.?|x)\s?\d{1,5})?"
_END = r"(?![\w]|[-/.:]\d)"
_BEG = r"(?<![\w.:/$€£+-])(?<!\d[ ,])"
PHONES = [
    (re.compile(rf"(?<![\w+])\+\d{{1,3}}(?:[ .\-/]?\(?\d{{1,5}}\)?){{2,7}}{_EXT}{_END}"), 0.85),
    (re.compile(rf"{_BEG}00[ -]?[1-9]\d(?:[ .\-/]?\(?\d{{1,5}}\)?){{3,7}}{_EXT}{_END}"), 0.6),
    (re.compile(rf"(?<![\w)])\([2-9]\d\d\)[ .-]?[2-9]\d\d[ .-]?\d{{4}}{_EXT}{_END}"), 0.75),
    (re.compile(rf"(?<![\w)])\(0\d{{2,5}}\)[ .\-/]?\d{{3,8}}(?:[ .-]\d{{2,5}}){{0,2}}{_EXT}{_END}"), 0.7),
    (re.compile(rf"{_BEG}(?:1[ .-])?[2-9]\d\d([ .-])[2-9]\d\d\1\d{{4}}{_EXT}{_END}"), 0.5),
    (re.compile(rf"{_BEG}0\d{{2,4}}[ /]\d{{3,6}}(?:[ -]\d{{2,6}}){{0,2}}{_EXT}{_END}"), 0.5),
    (re.compile(rf"{_BEG}1[2-9]\d{{2}}[2-9]\d{{6}}{_EXT}{_END}"), 0.4),
    (re.compile(rf"{_BEG}0\d{{9,10}}{_EXT}{_END}"), 0.35),
    (re.compile(rf"{_BEG}[2-9]\d\d[-.]\d{{4}}{_EXT}{_END}"), 0.2),
]
PHONE_BEFORE = re.compile(
    r"(?:\b(?:tel|telephone|telefon|phone|cell|mobile|mob|fax|call|ring|text|sms|whatsapp|signal|hotline|handy|dial|reach|number is|my number|ring us on|t|m|p)\b[^\w\n]*(?:(?:us|me|on|at|is|only|please|no|nr|number|line)\b[^\w\n]*){0,3})\(?$",
    re.IGNORECASE,
)
PHONE_AFTER = re.compile(r"^\)?\s*(?:is my (?:cell|phone|number)|,?\s*(?:and )?ask for)", re.IGNORECASE)
NOT_PERSONAL = re.compile(
    r"\b(?:model|serial|part|order|version|firmware|isbn|issn|batch|code|port|pages?|sku|item|stand|article|ref|reference|ticket|invoice|build|release|rev|revision|lot|tracking|gateway|paid|between|chapter|issue|week)\b"
    r"(?:\s*(?:no|nr|number|id|is|it|#)\b)*[^\w\n]*$",
    re.IGNORECASE,
)
UNIT_AFTER = re.compile(r"^ ?(?:km|kg|g|m|cm|mm|l|litres?|liters?|%|percent|eur|usd|dollars?|units?|times|of them|people|pieces)\b(?! ?\d)", re.IGNORECASE)

# ---- identity numbers: pattern, what it is, and the check its digits have to pass, if the scheme has one -----------
ID_SHAPES = [
    (re.compile(r"(?<![\w])[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"), "account", "mod97"),
    (re.compile(r"(?<![\w.+-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])"), "card", "luhn"),
    (re.compile(r"(?<![\w.+-])3[47]\d\d([ -]?)\d{6}\1\d{5}(?![\w-])"), "card", "luhn"),
    (re.compile(r"(?<![\w])[A-Za-z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-Da-d](?!\w)"), "insurance", None),
    (re.compile(r"(?<![\w])[A-Z]{2,5}-?\d{5,8}-[A-Z]?\d{1,3}(?!\w)", re.IGNORECASE), "licence", None),
    (re.compile(r"(?<![\w])[A-Z]{1,3}\d{2}-\d{5,8}(?!\w)", re.IGNORECASE), "permit", None),
    (re.compile(r"(?<![\w])[A-Z]\d{3}[ -]\d{3}[ -]\d{3}(?![\w])", re.IGNORECASE), "health", None),
    (re.compile(r"(?<![\w.-])(?:\d{8}|[XYZ]-?\d{7})[ -]?[A-HJ-NP-TV-Z](?![\w-])"), "national", "letter23"),
    (re.compile(r"(?<![\w])[A-Z]{1,2}\d{6,9}[A-Z]?(?!\w)", re.IGNORECASE), "passport", None),
    (re.compile(r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}-\d\d(?![\w])"), "national", "mod11"),
    (re.compile(r"(?<![\w.-])\d{2,3}/\d{3}/\d{4,5}(?![\w/])"), "tax", None),
    (re.compile(r"(?<![\w.-])\d{6}-\d{4}(?![\w-])"), "national", "dated_luhn"),
    (re.compile(r"(?<![\w.-])\d{3}([ -])\d\d\1\d{4}(?![\w-])"), "social", None),
    (re.compile(r"(?<![\w.+-])\d{2}[ .]\d{3}[ .]\d{3}[ .]\d{3}(?![\w-])"), "tax", "mod11_10"),
    (re.compile(r"(?<![\w.-])\d{4}[ -]\d{4}[ -]\d{2}[ -]\d(?![\w-])"), "national", None),
    (re.compile(r"(?<![\w.-])(?<!\+\d )(?<!\+\d\d )\d{3}[ -]\d{3}[ -]\d{3,4}(?![\w-])"), "any", None),
    (re.compile(r"(?<![\w.$-])\d{8,12}(?![\w-])"), "any", None),
]
# evidence: a label, a check that holds or fails, a word that speaks against it; ACCEPT is what it has to come to
LABEL_BEFORE, LABEL_AFTER, CHECK_HOLDS, CHECK_FAILS, SPEAKS_AGAINST = 0.7, 0.5, 0.6, -0.2, -0.5
_ID_WORDS = (
    r"social(?:\s+security)?|ssn|passport|reisepass|passeport|national\s+id(?:entity)?|id[\s-]*card|id[\s-]*nr|id\s+number|identity\s+(?:card|number)|"
    r"national\s+insurance|ni\s+number|nino|insurance\s+(?:no|number|card)|tax\s*(?:id|number|no)|personal\s+tax|steuer\w*|tin|vat\s+id|"
    r"driv(?:er|ing|er's)\s+licen[cs]e|licen[cs]e\s+(?:no|number)|health\s+(?:card|insurance|no|number)|residence\s+permit|aufenthalts\w*|permit\s+(?:no|number)|dni|nie|nif|cpf|pesel"
)
ID_BEFORE = re.compile(rf"\b(?:{_ID_WORDS})\b(?:\s+(?:card|no|nr|number|id|is|was|security))*[^\w\n]{{0,4}}$", re.IGNORECASE)
# a label after the number counts only if no other number follows it
ID_AFTER = re.compile(rf"^[^\n.!?]{{0,32}}?\b(?:{_ID_WORDS})\b(?![^\n.!?]{{0,14}}?\d)", re.IGNORECASE)

# ---- addresses ----------------------------------------------------------------------------------
_TYPES = (
    r"street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|close|cl|terrace|ter|way|place|pl|square|sq|crescent|cres|"
    r"mews|row|parade|grove|gardens|gdns|hill|walk|alley|quay|wharf|highway|hwy|parkway|pkwy|circle|cir|yard|green|rise|view|path"
)
_UNIT = r"(?:(?:unit|flat|apt|apartment|suite|room)\s*\d{1,4}[a-z]?\s*[/,]?\s*)"
STREETS = [
    re.compile(
        rf"(?<![\w$€£.,/-]){_UNIT}?\d{{1,4}}[a-z]?,?\s{{1,4}}(?:(?:n|s|e|w|ne|nw|se|sw)\.?\s{{1,4}})?((?:[^\W\d_][\w'’-]{{0,40}}\s{{1,4}}){{1,3}}?)(?:{_TYPES})\b(?:\s{{1,4}}(?:{_TYPES})\b)?\.?",
        re.IGNORECASE,
    ),
    re.compile(rf"(?<![\w$€£.,/-]){_UNIT}?\d{{1,4}}[a-z]?(?:\s?(?:bis|ter))?,?\s{{1,4}}(?:rue|avenue|boulevard|allée|place|quai|chemin|impasse|route)\s{{1,4}}((?:(?:de\s{{1,4}}la|des|du|de)\s{{1,4}}|d['’])?)[^\W\d_][\w'’-]{{0,40}}", re.IGNORECASE),
    re.compile(r"(?<![\w-])[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm)\s{1,4}\d{1,4}(?:\s?[a-z])?\b()", re.IGNORECASE),
    # no word that says what it is, but a town and code after it
    re.compile(
        rf"(?<![\w$€£.,/-])(?i:{_UNIT})?\d{{1,4}}[A-Za-z]?,?\s{{1,4}}((?:[^\W\d_][\w'’-]{{0,40}}\s{{1,4}}){{0,2}}[^\W\d_][\w'’-]{{0,40}})[ ]*[,\n]\s*(?=[^\W\d_a-z][\w'’-]+\s{{1,4}}\d{{5}}(?!\s?\d))"
    ),
    re.compile(r"(?<![\w-])(?:calle|avenida|avda\.?|plaza|paseo|camino|via|viale|piazza|corso|rua|travessa)\s{1,4}((?:[^\W\d_][\w'’-]{0,40}\s?){1,4}?),?\s{1,4}\d{1,4}(?:\s?[a-z])?\b", re.IGNORECASE),
]
FRENCH = STREETS[1]
STREET_TAIL = re.compile(
    r"^(?:,?\s*(?:apt|apartment|flat|unit|suite)\.?\s*\d{1,4}[a-z]?|,?\s*\d{1,2}\s?º\s?\w?)?(?:(?:[,\n]\s*)?(?:\d{4,6}\s+[^\W\d_][\w'’-]*|(?!tel|phone|cell|call|fax|t:)[^\W\d_][\w'’-]*\s+\d{4,6}\b(?!\s?\d)))?", re.IGNORECASE
)
# words that don't stand in a street's name
_PLAIN = frozenset(
    "a an the of for to and or but in on at by with from is are was were be it its that this we you they i my our your their his her us me them "
    "one no not so if as than then per each every any some all more most less out up down off over under only just about same new other what which who how when".split()
)

# ---- names --------------------------------------------------------------------------------------
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’][^\W\d_]+)?"
_PARTICLE = r"(?:(?:von|van|de|di|da|del|der|den|du|la|le|zu|bin|al)\s+){1,3}"
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
TITLE = re.compile(r"(?<![\w;])(?:mr|mrs|ms|miss|mx|dr|prof|professor|herr|frau|sir|madame|señor|señora|sr|sra)\b\.?\s+$", re.IGNORECASE)
CUE = re.compile(
    r"(?:\b(?:my name is|i am called|signed|regards|best|cheers|sincerely|yours|spoke (?:with|to)|talk(?:ed)? to|met with|ask(?:ed)? for|credit(?:ed)? (?:goes )?to|thanks to|thank you|says|written by|sent by|"
    r"my (?:landlord|landlady|sister|brother|mother|father|mum|dad|wife|husband|son|daughter|boss|doctor|friend|colleague|partner|aunt|uncle|cousin|neighbou?r))\b[,:]?\s+|(?:^|[\n.!?]\s*)[—–-]{1,2}\s*)$",
    re.IGNORECASE,
)
AFTER_NAME = re.compile(r"^\s+(?:wrote|called|told|said|says|asked)\b")
FIELD_EDGE = re.compile(r"(?:^|[\n|])\s*$")
COMPANY = re.compile(r"^\s+(?:studio|kit|kits|ltd|limited|inc|corp|gmbh|ag|llc|works|labs?|company|co|brand|model|shop|store|group|design|press|tools?|boards?|slip)\b", re.IGNORECASE)
HANDLE = re.compile(r"(?:@|\bu/|\br/|#|/)[\w-]*$")


# What a text must hold for a search to be worth while: conditions that every hit of that search meets.
NUMBERISH = re.compile(r"\d(?:[^\d\n]{0,4}\d){5}|\d(?:\s?\d){5}")
STREET_WORDS = frozenset(_TYPES.split("|")) | frozenset(
    "rue avenue boulevard allée place quai chemin impasse route calle avenida avda plaza paseo camino via viale piazza corso rua travessa".split()
)
TOWN_CODE = re.compile(r"\d[A-Za-z]?,?\s{1,4}[^\d\n,]{1,160}[,\n]\s{0,4}[^\W\d_][\w'’-]{1,60}\s{1,4}\d{5}")
STREET_END = re.compile(r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm)\s+\d")
CUE_WORDS = frozenset(
    "mr mrs ms miss mx dr prof professor herr frau sir madame señor señora sr sra name called signed regards best cheers sincerely yours spoke talk talked met ask asked "
    "credit credited thanks thank says written sent landlord landlady sister brother mother father mum dad wife husband son daughter boss doctor friend colleague partner aunt uncle cousin neighbor neighbour".split()
)
INITIAL_FIELD = re.compile(r"(?:^|[\n|])[ \t]{0,8}[A-Z]\.")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def luhn(token: str) -> bool:
    """The check of payment cards and many national numbers: doubled digits add up to a multiple of ten."""
    digits = re.sub(r"\D", "", token)
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0 and len(set(digits)) > 1


def mod97(token: str) -> bool:
    """The ISO 7064 mod 97-10 check of account numbers that start with a country."""
    text = re.sub(r"\W", "", token).upper()
    if not 15 <= len(text) <= 34 or not text.isascii() or not text.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def mod11(token: str) -> bool:
    """Two check digits by weighted sums modulo 11, over eleven digits."""
    digits = re.sub(r"\D", "", token)
    if len(digits) != 11 or len(set(digits)) == 1:
        return False
    for n in (9, 10):
        rest = sum(int(d) * (n + 1 - i) for i, d in enumerate(digits[:n])) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return True


def mod11_10(token: str) -> bool:
    """The ISO 7064 mod 11,10 check of eleven digits, of which the first ten aren't all different."""
    digits = re.sub(r"\D", "", token)
    if len(digits) != 11 or digits[0] == "0" or not 8 <= len(set(digits[:10])) <= 9:
        return False
    rest = 10
    for d in digits[:10]:
        rest = ((int(d) + rest) % 10 or 10) * 2 % 11
    return (11 - rest) % 10 == int(digits[10])


def dated_luhn(token: str) -> bool:
    """Six digits that are a date (days may be raised by 60) and four with a Luhn digit."""
    digits = re.sub(r"\D", "", token)
    return 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) % 60 <= 31 and luhn(digits)


def letter23(token: str) -> bool:
    """A letter that stands for the number modulo 23."""
    text = re.sub(r"\W", "", token).upper()
    number = int(str("XYZ".find(text[0])) + text[1:-1] if text[0] in "XYZ" else text[:-1])
    return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == text[-1]  # fixed value: the published order of letters


CHECKS = {f.__name__: f for f in (luhn, mod97, mod11, mod11_10, dated_luhn, letter23)}


class Finder:
    """Finds spans (start, end, kind) in a text; `names` maps lower-case words to 'given' or 'family'."""

    def __init__(self, names: dict[str, str], plain_words: set[str] | None = None):
        self.names = names
        # list entries that are words of the language too count only with a cue beside them
        self.plain = plain_words or set()

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """Spans in text order, without overlaps. Null and empty texts have none."""
        if not text:
            return []
        taken: list[tuple[int, int, str]] = []
        low = text.lower()
        vocabulary = set(LETTERS.findall(low))
        if "@" in text or "at" in vocabulary and ("dot" in vocabulary or "(at" in low or "( at" in low or "[at" in low or "[ at" in low or "{" in low):
            for pattern in (SPOKEN_LOCAL, EMAIL, SPOKEN_EMAIL):
                self._add(taken, ((m.start(), m.end(), "email") for m in pattern.finditer(text)))
        long_number = NUMBERISH.search(text) is not None
        if long_number:
            self._add(taken, self._identities(text))
        # what follows may not reach into spans found before
        if not vocabulary.isdisjoint(STREET_WORDS) or STREET_END.search(low) or TOWN_CODE.search(text):
            self._add(taken, self._addresses(self._masked(text, taken)))
        if long_number:
            self._add(taken, self._phones(self._masked(text, taken)))
        if not vocabulary.isdisjoint(self.names) or self._cued(text, vocabulary) or INITIAL_FIELD.search(text):
            self._add(taken, self._people(text, vocabulary))
        return taken

    def redact(self, text: str | None) -> str | None:
        """The text with every span replaced by its kind in brackets, e.g. [EMAIL]."""
        if not text:
            return text
        out, at = [], 0
        for a, b, kind in self.find(text):
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join(out) + text[at:]

    @staticmethod
    def _masked(text: str, taken: list) -> str:
        if not taken:
            return text
        out, at = [], 0
        for a, b, _ in taken:
            out += [text[at:a], "\0" * (b - a)]
            at = b
        return "".join(out) + text[at:]

    @staticmethod
    def _add(taken: list, spans) -> None:
        """Keep spans in order and apart; what came first holds."""
        for span in spans:
            at = bisect.bisect(taken, span)
            if (at == 0 or taken[at - 1][1] <= span[0]) and (at == len(taken) or span[1] <= taken[at][0]):
                taken.insert(at, span)

    def _identities(self, text: str):
        """Numbers of a known shape. A check that holds is enough by itself, one that fails leaves only a label just before the number."""
        for shape, sort, check in ID_SHAPES:
            for m in shape.finditer(text):
                a, b = m.span()
                before, after = text[max(0, a - 48) : a], text[b : b + 56]
                score = 0.1
                if check:
                    score += CHECK_HOLDS if CHECKS[check](m.group()) else CHECK_FAILS
                if sort in ("card", "account"):
                    pass  # nothing but the check makes one
                elif ID_BEFORE.search(before):
                    score += LABEL_BEFORE
                elif ID_AFTER.search(after):
                    score += LABEL_AFTER
                elif PHONE_BEFORE.search(before):
                    score += SPEAKS_AGAINST
                if NOT_PERSONAL.search(before):
                    score += SPEAKS_AGAINST
                if score >= ACCEPT:
                    yield a, b, "id_number"

    def _phones(self, text: str):
        for pattern, base in PHONES:
            for m in pattern.finditer(text):
                a, b = m.span()
                if text[b - 1] == ")" and m.group().count("(") < m.group().count(")"):
                    b -= 1
                before, after = text[max(0, a - 40) : a], text[b : b + 24]
                if not 7 <= sum(c.isdigit() for c in m.group()) <= 20:
                    continue
                score = base
                if PHONE_BEFORE.search(before) or PHONE_AFTER.search(after):
                    score += 0.4
                elif re.search(r"(?:^|[\n|]|,)\s*\(?$", before) and re.search(r"^\)?\s*(?:$|[\n|,.])", after):
                    score += 0.3  # a field of its own, as in a signature
                if NOT_PERSONAL.search(before) or UNIT_AFTER.search(after):
                    score -= 0.6
                if ID_BEFORE.search(before):
                    score -= 0.3
                if score >= ACCEPT:
                    yield a, b, "phone"

    def _addresses(self, text: str):
        for pattern in STREETS:
            at = 0
            while m := pattern.search(text, at):
                a, b = m.span()
                inner = m.group(1).lower().replace(",", " ").split()
                if any(w in _PLAIN for w in inner) and pattern is not FRENCH:
                    at = a + 1
                    continue
                b += STREET_TAIL.match(text[b:]).end()
                yield a, b, "address"
                at = b

    @staticmethod
    def _cued(text: str, vocabulary: set[str]) -> bool:
        return not vocabulary.isdisjoint(CUE_WORDS) or "—" in text or "–" in text or "\n-" in text or text.startswith("-") or ". -" in text

    def _people(self, text: str, vocabulary: set[str]):
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        lowered = [w.lower() for _, _, w in words]
        hits = [i for i, w in enumerate(lowered) if w in self.names]
        spans = []
        used = -1
        for i in hits:
            if i <= used:
                continue
            span = self._around(text, words, lowered, i)
            if span:
                spans.append((words[span[0]][0], words[span[1]][1], "name"))
                used = span[1]
        # unlisted names are found by what stands before them
        for i, (a, b, w) in enumerate(words if self._cued(text, vocabulary) or spans or hits else ()):
            if w[0].isupper() and lowered[i] not in self.names and lowered[i] not in _PLAIN and (len(w) > 2 or self._initial(text, words, i)):
                before = text[max(0, a - 32) : a]
                titled = TITLE.search(before)
                if titled or CUE.search(before):
                    if re.fullmatch(r"(?i)mr|mrs|ms|miss|mx|dr|prof|professor|herr|frau", w):
                        continue
                    j = self._extend(text, words, lowered, i, loose=True)
                    tail = text[words[j][1] :]
                    weak = before.rstrip()[-1:] in "—–-" or bool(re.search(r"(?i)(?:best|cheers|thanks to|ask for),?\s*$", before))
                    ends = not tail or bool(re.match(r"\s*(?:$|[\n|,.;!])|\s+[A-Z0-9(<]|\s+(?:for|at|and|or|is|was|has|had|will|would)\b", tail))
                    if titled or j > i or (not weak and w.lower() not in _OPENERS) or (ends and w.lower() not in ("the", "you", "everyone", "all")):
                        spans.append((a, words[j][1], "name"))
            elif w[0].isupper() and lowered[i] not in _PLAIN and len(w) > 2 and AFTER_NAME.match(text[b : b + 14]) and re.search(r"(?:^|[.!?\n]\s*)$", text[max(0, a - 3) : a]) and lowered[i] in self.names:
                spans.append((a, b, "name"))
        # an initial and a surname in a field of their own
        for m in () if not INITIAL_FIELD.search(text) else re.finditer(rf"(?:^|[\n|])[ \t]{{0,8}}((?:{_CAP}|[A-Z]\.)(?:\s[A-Z]\.)?\s+(?:{_PARTICLE})?({_CAP}))(?=\s*(?:$|[\n|]))", text):
            if re.match(r"[A-Z]\.", m.group(1)):
                spans.append((m.start(1), m.end(1), "name"))
        for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not HANDLE.search(text[max(0, a - 24) : a]) and not re.match(r"[@_/]|\d|-\w+@", text[b : b + 24]):
                yield a, b, kind

    def _initial(self, text, words, i) -> bool:
        a, b, w = words[i]
        return len(w) == 1 and w.isupper() and text[b : b + 1] == "."

    def _gap(self, text, words, i, j) -> str:
        return text[words[i][1] : words[j][0]]

    def _extend(self, text, words, lowered, i, loose=False) -> int:
        """Last word of the name that starts with word i: initials, particles, surname, second surname."""
        j, n = i, len(words)
        upper = words[i][2].isupper() and len(words[i][2]) > 1
        if self._initial(text, words, i) and j + 1 < n and self._gap(text, words, j, j + 1) in (". ", "."):
            j += 1
        elif j + 1 < n and self._initial(text, words, j + 1) and self._gap(text, words, j, j + 1) == " " and j + 2 < n and self._gap(text, words, j + 1, j + 2) == ". " and words[j + 2][2][0].isupper():
            j += 2
        else:
            k = j + 1
            while k < n and lowered[k] in ("von", "van", "de", "di", "da", "del", "der", "den", "du", "la", "le", "zu") and self._gap(text, words, k - 1, k) == " ":
                k += 1
            if k < n and self._gap(text, words, k - 1, k) == " ":
                w = words[k][2]
                known = self.names.get(lowered[k])
                fits = known == "family" and (lowered[k] not in self.plain or w[0].isupper() or words[i][2].islower()) or (
                    w[0].isupper() and known != "given" and lowered[k] not in _PLAIN and (k > j + 1 or not self._sentence(text, words, k)) and (w.isupper() == upper or not upper)
                    and len(w) > 3 and not COMPANY.match(text[words[j][1] :]) and not re.match(r"-[^\W\d_A-Z]", text[words[k][1] : words[k][1] + 2])
                )
                if fits:
                    j = k
        while j + 1 < n and self._gap(text, words, j, j + 1) == "-" and words[j + 1][2][0].isupper() == words[j][2][0].isupper():
            j += 1
        return j

    def _sentence(self, text, words, k) -> bool:
        """Whether word k is a common sentence opener rather than a surname."""
        return words[k][2].lower() in _OPENERS

    def _around(self, text, words, lowered, i) -> tuple[int, int] | None:
        a, b, w = words[i]
        kind = self.names[lowered[i]]
        first, last = i, i
        before = text[max(0, a - 32) : a]
        cue = bool(TITLE.search(before) or CUE.search(before))
        plain = lowered[i] in self.plain
        if COMPANY.match(text[b : b + 16]) and not cue:
            return None
        if kind == "given":
            last = self._extend(text, words, lowered, i)
            if last > i:
                if COMPANY.match(text[words[last][1] : words[last][1] + 16]):
                    return None
                if not (plain and w.islower()) or cue:
                    known_pair = any(lowered[k] in self.names for k in range(i + 1, last + 1))
                    if not plain or cue or known_pair or self._field(text, words, i, last):
                        return self._reach_back(text, words, lowered, first), last
                return None
            if plain:
                ok = cue and w[0].isupper() or w[0].isupper() and self._field(text, words, i, i)
                return (i, i) if ok else None
            if w[0].isupper() or cue or self._field(text, words, i, i):
                return self._reach_back(text, words, lowered, i), i
            return None
        # a surname: with a given name after a comma, before it, an initial, or a title
        if i + 1 < len(words) and self._gap(text, words, i, i + 1) == ", " and self.names.get(lowered[i + 1]) == "given" and (not plain or lowered[i + 1] not in self.plain):
            return i, i + 1
        if i + 2 < len(words) and self._gap(text, words, i, i + 1) == "-" and self._gap(text, words, i + 1, i + 2) == ", " and self.names.get(lowered[i + 2]) == "given":
            return i, i + 2
        while last + 1 < len(words) and self._gap(text, words, last, last + 1) == "-" and words[last + 1][2][0].isupper() == w[0].isupper():
            last += 1
        first = self._reach_back(text, words, lowered, i)
        if first < i:
            if COMPANY.match(text[words[last][1] : words[last][1] + 16]):
                return None
            return first, last
        if cue and w[0].isupper():
            return i, max(last, self._comma_given(text, words, last))
        if not plain and w[0].isupper() and i + 1 < len(words) and self._gap(text, words, last, last + 1) == ", " and self._field(text, words, i, last + 1) and words[last + 1][2][0].isupper():
            return i, last + 1
        if not plain and (self._field(text, words, i, last) and w[0].isupper() or w[0].isupper() and AFTER_NAME.match(text[words[last][1] :][:14])):
            return i, last
        return None

    def _comma_given(self, text, words, j) -> int:
        if j + 1 < len(words) and self._gap(text, words, j, j + 1) == ", " and self.names.get(words[j + 1][2].lower()) == "given":
            return j + 1
        return j

    def _field(self, text, words, i, j) -> bool:
        """Whether words i to j fill a line or a field between bars."""
        return bool(FIELD_EDGE.search(text[max(0, words[i][0] - 3) : words[i][0]])) and bool(
            re.match(r"\s*(?:$|[\n|])|,\s*(?:\S+@|\+?\(?\d|T:|Tel)", text[words[j][1] : words[j][1] + 40])
        )

    def _reach_back(self, text, words, lowered, i) -> int:
        """First word of a name that ends with the listed surname i: initial, particle, unlisted given name."""
        k = i
        while k > 0 and lowered[k - 1] in ("von", "van", "de", "di", "da", "del", "der", "den", "du", "la", "le", "zu") and self._gap(text, words, k - 1, k) == " ":
            k -= 1
        if k > 0 and self._initial(text, words, k - 1) and self._gap(text, words, k - 1, k) == ". ":
            k -= 1
            if k > 0 and self._gap(text, words, k - 1, k) == " " and self._could_be_given(text, words, lowered, k - 1):
                k -= 1
            return k
        if self.names[lowered[i]] == "family" and k > 0 and self._gap(text, words, k - 1, k) == " " and self._could_be_given(text, words, lowered, k - 1):
            if lowered[i] in self.plain and words[i][2].islower() and words[k - 1][2][0].isupper():
                return i
            return k - 1
        return i if k == i or self.names[lowered[i]] == "given" else i

    def _could_be_given(self, text, words, lowered, k) -> bool:
        a, b, w = words[k]
        if lowered[k] in _PLAIN or lowered[k] in _OPENERS or len(w) < 3 or TITLE.search(text[max(0, a - 1) : b] + " "):
            return False
        if w[0].isupper():
            return lowered[k] not in _NOT_GIVEN
        return self.names.get(lowered[k]) == "given" or bool(FIELD_EDGE.search(text[max(0, a - 3) : a])) or bool(CUE.search(text[max(0, a - 32) : a]))


# words that open sentences or stand as labels: function words, modal verbs, times, ways of contact, kinds of identity numbers
_OPENERS = frozenset(
    "the our my we i it in if is you they that this there what why would could can has have had no not nobody somebody someone same some every everyone each don't do does did "
    "last please so since still thanks an a at after and as ask all any by but because before between both call for from here how me now of on only or out to until was were when where who will with "
    "these those then though yesterday today tomorrow tonight soon later again also maybe perhaps honestly frankly actually basically really clearly obviously luckily sadly finally hopefully apparently recently usually just mail text phone tel ring reach fax whatsapp sms "
    "passport national insurance tax residence social driver driving health licence license permit unit flat apartment suite room".split()
)
_NOT_GIVEN = frozenset("landlord landlady sister brother mother father says said name mr mrs ms dr prof signed regards cheers best thanks".split())


def name_list(names: DataFrame) -> dict[str, str]:
    """A name list (name_text, name_kind) as lower-case words; its size is checked before it is sent out."""
    n = names.count()
    if n > MAX_NAMES:
        raise ValueError(f"{n} names; at most {MAX_NAMES} are sent to the tasks")
    out: dict[str, str] = {}
    for r in names.select("name_text", "name_kind").toLocalIterator():
        if r.name_text and r.name_text.strip():
            word = r.name_text.strip().lower()
            # a word of both kinds may stand alone, as a given name may
            out[word] = "given" if out.get(word) == "given" else (r.name_kind or "family")
    return out


def plain_words(texts: DataFrame, column: str, names: dict[str, str]) -> set[str]:
    """Listed names that are written in lower case, as a word of the language, in many texts.

    Counted over all texts: in lower case at least 5 times, without another listed name beside it, and in no less
    than a quarter of all uses. Only counts of listed names come to the driver.
    """
    listed = [n for n in names if n.isalpha()]
    if not listed:
        return set()
    spark = texts.sparkSession
    known = F.broadcast(spark.createDataFrame([(n,) for n in listed], "word string"))  # no more than MAX_NAMES
    tokens = F.regexp_extract_all(F.col(column), F.lit(r"(?<![\p{L}\p{N}_@.\-])\p{L}+(?![\p{L}\p{N}_@\-]|\.\p{L})"), F.lit(0))
    none = F.array(F.lit(""))
    beside = texts.select(tokens.alias("t")).filter("size(t) > 0").select(
        F.explode(F.arrays_zip(F.col("t").alias("w"), F.concat(none, "t").alias("before"), F.concat(F.slice("t", F.lit(2), F.size("t")), none).alias("after"))).alias("p")
    ).select("p.*").filter("w is not null")
    uses = beside.withColumn("word", F.lower("w")).join(known, "word")
    for side in ("before", "after"):
        other = known.select(F.col("word").alias(f"{side}_word"))
        uses = uses.join(other, F.lower(side) == F.col(f"{side}_word"), "left")
    alone = F.col("before_word").isNull() & F.col("after_word").isNull()
    counts = uses.groupBy("word").agg(F.count(F.when((F.col("w") == F.col("word")) & alone, 1)).alias("low"), F.count(F.lit(1)).alias("n")).filter("low >= 5 and 4 * low >= n")
    return {r.word for r in counts.toLocalIterator()}


def find_spans(texts: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id, kind, start_at, end_at): one row per span and distinct id; positions are in code points.

    kind is 'email', 'phone', 'id_number', 'address' or 'name'. Rows with null or empty text give
    none; rows stored several times count once. Other columns are ignored. The search is narrow;
    only the spans found are shuffled, to drop those of repeated rows.
    """
    finder = _finder(texts, text_col, names)
    id_type = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b, kind in finder.find(text):
                    rows.append(i), kinds.append(kind), starts.append(a), ends.append(b)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(kinds), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    [id_col, "kind", "start_at", "end_at"],
                )

    found = texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, kind string, start_at int, end_at int")
    return found.distinct()


def redact(texts: DataFrame, text_col: str, names: DataFrame) -> DataFrame:
    """The same rows and columns with `text_col` redacted; null and empty texts stay as they are."""
    finder = _finder(texts, text_col, names)
    place = texts.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([finder.redact(t) for t in batch.column(place).to_pylist()], pa.string())
            columns = [clean if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return texts.mapInArrow(run, texts.schema)


def _finder(texts: DataFrame, text_col: str, names: DataFrame) -> Finder:
    listed = name_list(names)
    return Finder(listed, plain_words(texts, text_col, listed))
