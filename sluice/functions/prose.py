"""Readers of folded prose: mentions that no negation takes back, heating, lift, floor and
amenities. Mentions are Column expressions over sentences; the other readers are short
regular expression readers over Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Negations up to two words before a mention and right after it, how far
#: they are looked for, and negations of other readers.
BEFORE = r"\b(?:pas|non|hors|sans|aucune?|ni|exclus?)\b[ ]*(?:besoin[ ]+d['’](?:etre|avoir)[ ]+|de[ ]+|d['’]|en[ ]+)?(?:[^ .\n]+[ ]+){0,2}$"
AFTER = r"^[ ]*[(:,]?[ ]*(?:non\b|exclus?\b|refuses?\b|n['’]est pas\b|pas (?:possible|accepte|envisage)|(?:[^ .\n]+[ ]+)?s['’]abstenir|not accepted|excluded)"
WINDOW = 40
NEGATIONS = r"\b(?:sans|pas|non|aucune?|ni|jamais|hors)\b"


def let(value: Column, body) -> Column:
    """What ``body`` makes of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def sentences(text: Column) -> Column:
    """Folded text by its lines and full stops."""
    return F.split(text, r"\n|\. ")


def occurrences(sentence: Column, pattern: str, before: int, after: int) -> Column:
    """(before, word, after) of each place in a sentence where the pattern holds, with so
    many characters at most on either side."""
    words, rest = F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0)), F.split(sentence, pattern, -1)
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part))

    def place(word: Column, i: Column) -> Column:
        at = length(F.slice(rest, F.lit(1), i + 1)) + length(F.slice(words, F.lit(1), i))
        left = F.substring(sentence, F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(before)))
        return F.struct(left.alias("before"), word.alias("word"), F.substring(sentence, at + F.length(word) + 1, F.lit(after)).alias("after"))

    return F.transform(words, place)


def last_of(text: Column, cues: dict[str, str]) -> Column:
    """The name of the cue that comes last in a text, null if none does."""
    # As much as can stand before a cue is left to it, so what follows is the last one.
    tail = F.regexp_extract(text, f"(?s)^.*((?:{'|'.join(cues.values())}).*)$", 1)
    return let(tail, lambda t: F.coalesce(*[F.when(t.rlike(f"^(?:{pattern})"), F.lit(name)) for name, pattern in cues.items()]))


def mentions(text: Column, pattern: str, window: int = WINDOW) -> Column:
    """Does folded text hold the pattern with no negation beside it: up to two words before
    it in its sentence, or right after it? Every occurrence is tried."""
    open_ = lambda o: ~o["before"].rlike(BEFORE) & ~o["after"].rlike(AFTER)
    stated = lambda s: s.rlike(pattern) & F.exists(occurrences(s, pattern, window, window), open_)
    # Few texts hold a pattern at all; only those are taken apart.
    return F.when(text.rlike(pattern), F.exists(sentences(text), stated)).otherwise(False)


def mention(pattern: str, window: int = WINDOW):
    """Column function: does the folded text mention the pattern un-negated?"""
    return lambda text: mentions(text, pattern, window)


#: A mention of hail, and a negation up to two words before it.
HAIL = r"\bgrel(?:e|ee|es|ees)\b"
NO_HAIL = r"(?:\bnon|\bsans|\bpas\s+de|\baucune?|\bjamais|\bni)[\s-]+(?:\w+[\s-]+){0,2}$"
_HAIL, _NO_HAIL = re.compile(HAIL), re.compile(NO_HAIL)


def hail(text: str | None) -> bool:
    """True if folded text states damage by hail."""
    return any(not _NO_HAIL.search(text[max(0, m.start() - 40) : m.start()]) for m in _HAIL.finditer(text or ""))


#: Sources of energy and what names them.
ENERGIES = (("electrique", r"electri(?:que|cite)"), ("gaz", r"\bgaz\b"), ("fioul", r"\bfioul\b"), ("urbain", r"(?:reseau|chauffage) urbain"), ("pompe", r"pompe a chaleur"))


def heating(text: str | None) -> tuple[str | None, str | None]:
    """(mode, energy) of the first heating that is stated: the mode within 24
    characters after the word, the nearest energy within 64."""
    text = text or ""
    for m in re.finditer(r"chauffage", text):
        if re.search(NEGATIONS, re.split(r"[.!?;\n]", text[max(0, m.start() - 24) : m.start()])[-1]):
            continue
        after = text[m.end() : m.end() + 24]
        mode = next((name for name in ("individuel", "collectif") if name in after), None)
        near = []
        for name, pattern in ENERGIES:
            for e in re.finditer(pattern, text[max(0, m.start() - 64) : m.end() + 64]):
                near.append((abs(e.start() - min(64, m.start())), name))
        return mode, min(near)[1] if near else None
    return None, None


def lift(text: str | None) -> bool | None:
    """Whether prose states a lift: the nearest marker before it decides, ``: non``
    after it too; null if no lift is named."""
    text = text or ""
    for m in re.finditer(r"ascenseur", text):
        if re.match(r"\s*:\s*(?:non|aucun)", text[m.end() : m.end() + 16]):
            return False
        before = re.split(r"[.!?;\n]", text[max(0, m.start() - WINDOW) : m.start()])[-1]
        no = [x.start() for x in re.finditer(r"sans|aucune?|pas d|depourvue?|\bni ", before)]
        yes = [x.start() for x in re.finditer(r"avec|dispose|possede|equipe|presence|\bpar\b|dote|offre", before)]
        if no and (not yes or max(no) > max(yes)):
            return False
        return True
    return None


#: Floors in words.
ORDINALS = ("rez-de-chaussee", "premier", "deuxieme", "troisieme", "quatrieme", "cinquieme", "sixieme", "septieme", "huitieme", "neuvieme", "dixieme")


def floor(text: str | None) -> int | None:
    text = text or ""
    m = re.search(r"\b(\d{1,2}) ?(?:er|e|eme|nd|nde)? ?(?:etage)", text)
    if m:
        return int(m[1])
    for i, word in enumerate(ORDINALS):
        if re.search(rf"\b{word}\b" + (" etage" if i else ""), text) or (not i and re.search(r"\brdc\b", text)):
            return i
    return None


#: Amenities, the words for parking, and words that include it.
AMENITIES = ("terrasse", "balcon", "loggia", "jardin", "cave")
PARKING = ("parking", "stationnement", "garage", "box")
INCLUDED = ("inclus", "incluse", "compris", "comprise", "attribue", "attribuee")
_NAMED = re.compile(r"[,\d]\s*(?:les|des|aux)\s+$")
_GROUND = re.compile(r"\brez[\s-]*de[\s-]*$")


def amenities(text: str | None) -> list[str]:
    """What folded prose offers. A plural behind an article names a street or a
    residence, a floor is no garden; parking is included only by a word for it
    within 40 characters, unless it comes on top of the rent."""
    text, out = text or "", []
    for stem in AMENITIES:
        for m in re.finditer(rf"\b{stem}s?\b", text):
            before = text[max(0, m.start() - 16) : m.start()]
            if not (m[0].endswith("s") and _NAMED.search(before)) and not (stem == "jardin" and _GROUND.search(before)):
                out.append(stem)
                break
    places = [text[m.end() : m.end() + 40] for stem in PARKING for m in re.finditer(rf"\b{stem}s?\b", text)]
    if places:
        out.append("parking inclus" if any("en sus" not in p and any(w in p for w in INCLUDED) for p in places) else "parking")
    return out


def _reader(kind: str, read):
    """A Column function that reads a folded text per row; its type is parsed when it
    is first used, since that needs a session."""

    def column(text):
        return pandas_udf(read, kind)(text)

    return column


def _heating(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([heating(t) for t in text], columns=["mode", "energy"])


def _lift(text: pd.Series) -> pd.Series:
    return pd.Series([lift(t) for t in text], dtype=object)


def _floor(text: pd.Series) -> pd.Series:
    return pd.Series([floor(t) for t in text], dtype="Int32")


def _amenities(text: pd.Series) -> pd.Series:
    return text.map(amenities)


heating_of = _reader("struct<mode:string,energy:string>", _heating)
lift_of = _reader("boolean", _lift)
floor_of = _reader("int", _floor)
amenities_of = _reader("array<string>", _amenities)
hail_of = _reader("boolean", lambda text: text.map(hail).astype(bool))


def hits_of(text: Column, terms: dict[str, str]) -> Column:
    """Labels of the terms that folded text mentions without a negation, in their order."""
    return F.array_compact(F.array(*[F.when(mentions(text, pattern), F.lit(label)) for label, pattern in terms.items()]).cast("array<string>"))
