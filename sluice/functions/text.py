"""Text scalars as Column expressions: folding, keys, numbers, URLs, masking."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Accented letters and what they fold to, one for one.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸàáâãäåçèéêëìíîïñòóôõöùúûüýÿ’‘ʼ＇`´"
FOLDED = "AAAAAACEEEEIIIINOOOOOUUUUYYaaaaaaceeeeiiiinooooouuuuyy''''''"
#: Letters that fold to two.
DIGRAPHS = (("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae"), ("ß", "ss"))
#: White space but line breaks, and what shows nothing: marks that combine, format and
#: control characters, fillers.
BLANKS = r"[ \t\x{000B}\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
INVISIBLE = r"[\p{Mn}\p{Cf}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2065}\x{2800}\x{3164}\x{FFA0}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings of a missing value.
NULLISH = ("", "-", "--", "n/a", "na", "n/c", "nc", "null", "nd", "non communique", "non communiqué")


def fold(text: Column) -> Column:
    """Accents and ligatures to plain letters, what shows nothing left out, runs of
    blanks to one, blank lines left out, ASCII lower case. null stays null."""
    for letter, plain in DIGRAPHS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    text = F.translate(text, ACCENTED + UPPER, FOLDED + LOWER)
    text = F.translate(text, UPPER, LOWER)
    text = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), BLANKS, " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[\n ]*", "\n"), F.lit(" \n"))


#: An HTML entity that was not decoded.
ENTITY = r"&(?:[a-zA-Z][a-zA-Z0-9]{1,10}|#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,6});"


def readable_fold(text: Column) -> Column:
    """fold(), null for a text that still holds an undecoded entity: it is unreadable."""
    return F.when(~text.rlike(ENTITY), fold(text))


def unescaped(text: Column) -> Column:
    """Entities decoded, in up to three passes as long as something changes."""

    def passes(t):
        for _ in range(3):
            t, before = html.unescape(t), t
            if t == before:
                break
        return t

    def read(texts: pd.Series) -> pd.Series:
        return texts.map(passes, na_action="ignore")

    return pandas_udf(read, "string")(text)


def unescaped_each(texts: Column) -> Column:
    """Entities of every text of an array decoded as in unescaped()."""

    def passes(t):
        for _ in range(3):
            t, before = html.unescape(t), t
            if t == before:
                break
        return t

    def read(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: [t if t is None or "&" not in t else passes(t) for t in row], na_action="ignore")

    return pandas_udf(read, "array<string>")(texts)


def tolerant_fold(text: Column) -> Column:
    """Decoded and folded; null if it stays unreadable."""
    return readable_fold(unescaped(text))


def unicode_trim(text: Column) -> Column:
    """Separators, control and format characters off both ends."""
    return F.regexp_replace(text, r"^[\p{Z}\p{C}\s]+|[\p{Z}\p{C}\s]+$", "")


def without_parameters(text: Column) -> Column:
    """Addresses in a text without query and fragment; paths stay."""
    return F.regexp_replace(text, r"(?i)(https?://[^\s<>\"'?#]*)[?#][^\s<>\"']*", "$1")


def text_surface(title: Column, description: Column, card: Column) -> Column:
    """Title, description and the card's own text, a line each, without address parameters."""
    parts = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.when(card != "", card))
    return without_parameters(F.btrim(parts, F.lit(" \t\n\r")))


def commune_key(text: Column) -> Column:
    """Folded, everything but letters and digits one space, '' for unreadable text."""
    return F.coalesce(F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " ")), F.lit(""))


def field_key(text: Column) -> Column:
    """A field name without the words de, d', du, des between others and without
    anything but letters and digits."""
    key = fold(text)
    for word in (" de ", " d'", " du ", " des "):
        key = F.replace(key, F.lit(word), F.lit(" "))
    return F.regexp_replace(key, "[^a-z0-9]", "")


#: Words that have no plural, and acronyms that may be spelled with separators.
INVARIANT = ("lli", "plai", "plus", "pls", "anru", "anah", "hlm", "sne", "apl")
SPELLED = ("plai", "pls", "anru", "anah", "hlm")
_BETWEEN_WORDS = r"(?:[\s_/+\x{00B7}\x{2010}-\x{2015}-]|(?<=[a-z])\.(?=[a-z]))*"
_BETWEEN_LETTERS = r"[\s_/.+\x{00B7}\x{2010}-\x{2015}-]*"


def inflected(phrase: str, separators: bool = False) -> str:
    """A pattern for a phrase in folded text, whole words in any number and gender.
    With ``separators`` words may be joined by other marks than blanks, and the
    letters of acronyms may be apart."""

    def word(w: str) -> str:
        if separators and w in SPELLED:
            return _BETWEEN_LETTERS.join(w)
        if separators and "." in w:
            letters = w.split(".")
            return f"(?!{''.join(letters)}(?![a-z0-9]))" + _BETWEEN_WORDS.join(letters)
        if w in INVARIANT:
            return re.escape(w)
        if w.endswith("al"):
            return f"(?:{re.escape(w)}(?:es|e)?|{re.escape(w[:-2])}aux)"
        return f"{re.escape(w)}(?:es|e|s|x)?"

    gap = _BETWEEN_WORDS if separators else r"\s*"
    return "(?<![a-z0-9])" + gap.join(map(word, phrase.split(" "))) + "(?![a-z0-9])"


def token_position(folded: Column, token: str) -> Column:
    """Position from 1 of a token not bounded by letters or digits, 0 without one."""
    return F.regexp_instr(folded, F.lit(f"(?<![a-z0-9]){token}(?![a-z0-9])"))


def nullish_to_null(text: Column) -> Column:
    return F.when(~F.lower(F.trim(text)).isin(*NULLISH), text)


def first_present(*candidates: Column) -> Column:
    """The first candidate that is not null and not a spelling of a missing value."""
    return F.coalesce(*[nullish_to_null(c) for c in candidates])


def number(text: Column) -> Column:
    """First number in French or English spelling as double: a last separator before
    exactly three digits groups thousands, otherwise it is the decimal one."""
    bare = F.regexp_replace(text, r"(?<=[0-9])[ \x{00A0}\x{2007}\x{2009}\x{202F}](?=[0-9]{3}(?![0-9]))", "")
    token = F.regexp_extract(bare, r"-?[0-9][0-9.,]*", 0)
    token = F.regexp_replace(token, "[.,]+$", "")
    grouped = token.rlike(r"^-?[0-9]{1,3}([.,][0-9]{3})+$")
    last = F.regexp_extract(token, r"^(.*)[.,]([0-9]+)$", 1)
    digits = F.when(grouped, F.regexp_replace(token, "[.,]", "")).when(last != "", F.concat(F.regexp_replace(last, "[.,]", ""), F.lit("."), F.regexp_extract(token, r"[.,]([0-9]+)$", 1))).otherwise(token)
    return digits.try_cast("double")


def plausible(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def french_number(value: Column) -> Column:
    """Whole number with spaces between thousands."""
    return F.translate(F.format_number(value, 0), ",", " ")


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def stable_url_id(url: Column) -> Column:
    """scheme://host/path, without query and fragment."""
    return F.regexp_extract(url, r"^[^?#]*", 0)


def percent_encode(text: Column) -> Column:
    """RFC 3986 encoding: form encoding with its two differences undone."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


#: What is masked, and by what.
SECRETS = (
    (r"(api\.telegram\.org/bot)[^/ \n\r\t]+", "$1[secret]"),
    (r"\b[0-9]{8,12}:[A-Za-z0-9_-]{30,}", "[secret]"),
    (r"(ntfy\.[A-Za-z0-9.-]+/)[^/ \n\r\t?]+", "$1[secret]"),
    (r"\b(AUTH|AUTHENTICATE)[ \t]+([A-Za-z0-9-]{3,20})[ \t]+[A-Za-z0-9+/=]{12,}", "$1 $2 [secret]"),
    (r"\b[A-Za-z0-9+/]{16,}==", "[secret]"),
    (r"(?i)\b(RFR)[A-Za-z0-9_ -]{0,8}?[:=] *[0-9][0-9.,]*", "$1=[secret]"),
    (r"[A-Za-z0-9._%+-]+(@|%40)[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"(?i)(bearer|basic) +[A-Za-z0-9._~+/-]{8,}=*", "$1 [secret]"),
    (r"(?i)(password|passwd|token|secret|api[_-]?key)( *[:=] *)[^ \n\r\t]{4,}", "$1$2[secret]"),
    (r"(https?://)[^/@ \n]+:[^/@ \n]+@", "$1[secret]@"),
)


def redact(text: Column) -> Column:
    """Mail addresses, tokens, encoded credentials and passwords masked."""
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of a strict ISO-8601 instant with a zone, null otherwise."""
    strict = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$")
    plain = F.regexp_replace(F.regexp_replace(text, "-00:00$", "Z"), r"\.[0-9]+", "")
    return F.when(strict, F.unix_timestamp(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))


def term_hits(folded: Column, terms: dict[str, str]) -> Column:
    """Labels whose pattern fires, in the order of ``terms``."""
    return F.array_compact(F.array(*[F.when(folded.rlike(p), F.lit(label)) for label, p in terms.items()]))


def first_pattern(folded: Column, patterns: list[str]) -> Column:
    """The first pattern that fires, null if none does."""
    return F.coalesce(*[F.when(folded.rlike(p), F.lit(p)) for p in patterns])
