"""Raw field values to typed ones; what is not recognised is unknown, never a default."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .text import fold, nullish_to_null, number

#: Spellings of yes and no; a lift is stated by its own name.
YES = ("true", "oui", "yes", "1", "y", "o", "avec", "present", "présent", "ascenseur")
NO = ("false", "non", "no", "0", "n", "sans", "absent", "aucun")
#: départements of the region by the start of a postcode.
DEPARTMENTS = {"75": "Paris", "77": "Seine-et-Marne", "78": "Yvelines", "91": "Essonne", "92": "Hauts-de-Seine", "93": "Seine-Saint-Denis", "94": "Val-de-Marne", "95": "Val-d'Oise"}
#: What names a fuel, and a gearbox.
FUELS = (("hybride", "hybride|hybrid"), ("electrique", "electrique|electric"), ("diesel", "diesel|gazole"), ("essence", "essence|bioethanol|sans plomb|petrol"), ("gpl", "gpl|lpg"))
GEARBOXES = (("manuelle", r"\b(?:bvm|manuelle|manual|manuel)\b"), ("automatique", r"\b(?:auto|automatique|automatic|bva|edc|dsg|cvt|dct|eat[0-9]?|s-?tronic|steptronic|multitronic|powershift)\b"))
#: Levels of nesting that are read.
DEPTH = 12


def scalar_of(value: Column) -> Column:
    """A JSON value as text: of a list its first element that is no list, no object and
    not a spelling of a missing value; of an object nothing."""
    plain = F.filter(F.from_json(value, "array<string>"), lambda v: ~v.rlike(r"^\s*[\[{]") & nullish_to_null(v).isNotNull())
    return F.when(value.rlike(r"^\s*\["), F.try_element_at(plain, F.lit(1))).when(~value.rlike(r"^\s*\{"), value)


def int_of(text: Column) -> Column:
    """The first number of a text, rounded half away from zero."""
    return F.round(number(text), 0).cast("long")


def bool_of(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def floor_field(text: Column) -> Column:
    """A floor stated in a field: a whole number, the ground floor, or an ordinal before
    a single ``étage``; a count of floors is none."""
    plain, folded = F.trim(text), fold(text)
    ordinal = F.regexp_extract(folded, r"([0-9]+)\s*(?:er|ere|eme|e)?\s*etage\b", 1)
    return F.when(plain.rlike("^-?[0-9]+$"), plain.try_cast("int")).when(folded.rlike(r"\brdc\b|\brez.?de.?chaussee\b"), 0).when(ordinal != "", ordinal.try_cast("int"))


def flatten(text: Column) -> Column:
    """A JSON document as a map of dotted paths to text: true and false by name, nulls
    left out, DEPTH levels. Unreadable JSON gives an empty map."""

    def walk(value, name, depth, out):
        if isinstance(value, (dict, list)):
            if depth <= DEPTH:
                for key, inner in value.items() if isinstance(value, dict) else enumerate(value):
                    walk(inner, f"{name}.{key}" if name else str(key), depth + 1, out)
        elif isinstance(value, bool):
            out[name] = "true" if value else "false"
        elif value is not None and name:
            out[name] = str(value)
        return out

    def read(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return walk(json.loads(t), "", 0, {})
            except (ValueError, TypeError):
                return {}

        return texts.map(one)

    return pandas_udf(read, "map<string,string>")(text)


def without_sentinel(value: Column, unknown: str) -> Column:
    """null where a value is a portal's own word for unknown."""
    return F.when(~value.rlike(unknown), value)


def department(postcode: Column) -> Column:
    """Name and number of the département of a whole postcode, null outside of the region."""
    digits = F.regexp_replace(F.coalesce(postcode, F.lit("")), "[^0-9]", "")
    names = F.create_map(*[F.lit(x) for pair in DEPARTMENTS.items() for x in pair])
    name = F.try_element_at(names, F.substring(digits, 1, 2))
    return F.when(F.length(digits) == 5, F.concat(name, F.lit(" ("), F.substring(digits, 1, 2), F.lit(")")))


def floor_label(floor: Column, short: bool = False) -> Column:
    ground = "RDC" if short else "rez-de-chaussée"
    return F.when(floor < 0, "sous-sol").when(floor == 0, ground).when(floor == 1, "1er étage").when(floor > 1, F.concat(floor.cast("string"), F.lit("e étage")))


def fuel(text: Column) -> Column:
    """Kind of fuel; ``autre`` for one that is stated but not known, null if none is."""
    folded = fold(text)
    known = F.coalesce(*[F.when(folded.rlike(pattern), F.lit(name)) for name, pattern in FUELS], F.lit("autre"))
    return F.when(F.trim(text) != "", known)


def gearbox(text: Column) -> Column:
    folded = fold(text)
    return F.coalesce(*[F.when(folded.rlike(pattern), F.lit(name)) for name, pattern in GEARBOXES])


def digits_of(text: Column) -> Column:
    """All digits of a text as one number."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(digits != "", digits.try_cast("long"))


def registered(text: Column) -> Column:
    """Struct of year and month (null if unstated or out of range) of ``2015-09`` or ``2015``."""
    year = F.regexp_extract(text, r"^\s*([0-9]{4})", 1)
    month = F.regexp_extract(text, r"^\s*[0-9]{4}-([0-9]{1,2})", 1).try_cast("int")
    return F.struct(year.try_cast("int").alias("year"), F.when((year != "") & month.between(1, 12), month).alias("month"))


def vehicle_age(year: Column, month: Column, at_year: int, at_month: int = 12) -> Column:
    """Years since the first registration, two decimals, never below 0; June if only
    the year is known, null without one."""
    months = (at_year - year) * 12 + (at_month - F.coalesce(month, F.lit(6)))
    return F.when(year.isNotNull(), F.greatest(F.lit(0.0), F.round(months / 12, 2)))


#: Acronyms of financing that a list of codes may consist of.
ACRONYMS = "lli|pls|plus|plai|anru|anah|hlm"


def code_list(text: Column) -> Column:
    """True if every token is an acronym, one to three capitals or digits, and at least
    one is an acronym: a list of codes, no prose."""
    tokens = F.filter(F.split(F.trim(text), r"[\s/,;:()+&.-]+"), lambda t: t != "")
    acronym = rf"^(?i:{ACRONYMS})$"
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(acronym) | t.rlike("^(?:[A-Z]{1,3}|[0-9]+)$")) & F.exists(tokens, lambda t: t.rlike(acronym))


def vocabulary_hit(text: Column, phrases: list[str]) -> Column:
    """The first phrase (folded) that a name or value holds: as words after camel case is
    split, or, from eight letters and digits on, anywhere among its letters and digits."""
    spaced = fold(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^\\p{L}\\p{N}'’]+", " "))
    packed = F.regexp_replace(fold(text), "[^a-z0-9]", "")
    found = []
    for phrase in phrases:
        bare = "".join(c for c in phrase if c.isalnum())
        hit = F.concat(F.lit(" "), spaced, F.lit(" ")).contains(f" {phrase} ")
        found.append(F.when(hit | packed.contains(bare) if len(bare) >= 8 else hit, F.lit(phrase)))
    return F.coalesce(*found)


#: Figures of a card: rents (the surest first), surface, rooms, postcodes of the region.
RENTS = (
    r"(?i)([0-9][0-9 \x{00A0}\x{202F}.,]{2,})[ \x{00A0}]*(?:€|EUR|euros?)[ ]*(?:/[ ]*mois|par mois|mensuel)?[ ]*(?:CC|charges comprises)",
    r"(?i)(?:loyer|prix)[ ]*(?:CC|charges comprises)?[ ]*:?[ ]*([0-9][0-9 \x{00A0}\x{202F}.,]{2,})[ \x{00A0}]*(?:€|EUR|euros?)",
    r"(?i)([0-9][0-9 \x{00A0}\x{202F}.,]{2,})[ \x{00A0}]*(?:€|EUR|euros?)[ ]*(?:/[ ]*mois|par mois|mensuel)",
    r"(?i)([0-9][0-9 \x{00A0}\x{202F}.,]{2,})[ \x{00A0}]*(?:€|EUR|euros?)",
)
SURFACE = r"(?i)(?<![A-Za-z0-9])([0-9]{1,4}(?:[.,][0-9]{1,2})?)\s*(?:m²|m2|m\^2)"
ROOMS = r"(?i)(?:(?<![A-Za-z0-9])(?:T|F)\s?([0-9])\b|\b([0-9])\s*pi[eè]ces?\b)"
POSTCODE = r"\b((?:78|95|92|91|93|94|77|75)[0-9]{3})\b"


def card_facts(text: Column) -> Column:
    """Struct of rent, surface, rooms and postcode read from the words of a card: the
    first plausible rent of the surest kind, the first surface and rooms if plausible."""
    from .text import without_parameters

    body = without_parameters(text)
    rents = [F.try_element_at(F.filter(F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(1)), int_of), lambda v: v.between(200, 20_000)), F.lit(1)) for p in RENTS]
    surface = number(F.nullif(F.regexp_extract(body, SURFACE, 1), F.lit("")))
    rooms = F.coalesce(F.nullif(F.regexp_extract(body, ROOMS, 1), F.lit("")), F.nullif(F.regexp_extract(body, ROOMS, 2), F.lit(""))).try_cast("int")
    return F.struct(
        F.coalesce(*rents).alias("rent"),
        F.when(surface.between(5, 1000), surface).alias("surface"),
        F.when(rooms.between(1, 12), rooms).alias("rooms"),
        F.nullif(F.regexp_extract(body, POSTCODE, 1), F.lit("")).alias("postcode"),
    )
