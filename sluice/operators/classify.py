"""Classes of listings out of their words.

A reader finds signals, each with the tier of its evidence; Columns decide: the
lowest tier wins, an eligible winner against any excluded signal or doubt is
unknown, and what is unknown is never announced as a match.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sluice.functions.coerce import code_list
from sluice.functions.prose import let, occurrences
from sluice.functions.text import ACCENTED, ENTITY, FOLDED, field_key, fold, inflected, readable_fold, unescaped_each

#: Classes that are never announced, and those that may be.
EXCLUDED = ("PLS", "PLUS", "PLAI", "ANRU", "ANAH", "CONVENTIONNE", "SOCIAL")
ELIGIBLE = ("LLI", "LIBRE")
#: Names of fields that state a class, as field keys.
TENURE_FIELDS = ("tenurefield", "financement", "typefinancement", "financementlogement", "typeproduit", "produit", "categorie", "category", "categorielogement", "typelogement", "dispositif", "regime", "conventionnement", "agrement")
#: Labels in folded prose and their class.
LABELS = {
    "logement locatif intermediaire": "LLI",
    "logement intermediaire": "LLI",
    "loyer intermediaire": "LLI",
    "lli": "LLI",
    "loyer libre": "LIBRE",
    "pret locatif intermediaire": "LLI",
    "conventionne anah": "ANAH",
    "loc'avantages": "ANAH",
    "loc avantages": "ANAH",
    "locavantages": "ANAH",
    "louer abordable": "ANAH",
    "convention anah": "ANAH",
    "conventionne anru": "ANRU",
    "pret locatif a usage social": "PLUS",
    "pret locatif aide d'integration": "PLAI",
    "pret locatif social": "PLS",
    "logement locatif social": "SOCIAL",
    "logement social": "SOCIAL",
    "habitation a loyer modere": "SOCIAL",
    "hlm": "SOCIAL",
    "plai": "PLAI",
    "pls": "PLS",
    "p.l.u.s": "PLUS",
    "anru": "ANRU",
    "anah": "ANAH",
    "conventionne": "CONVENTIONNE",
}
#: Phrases about the procedure; UNKNOWN ones only raise a doubt.
PROCEDURAL = {
    "sans condition de commission": "LLI",
    "sans commission d'attribution": "LLI",
    "attribution directe": "LLI",
    "numero unique d'enregistrement": "SOCIAL",
    "numero unique": "UNKNOWN",
    "loyer maitrise": "UNKNOWN",
    "loyer abordable": "UNKNOWN",
    "systeme national d'enregistrement": "SOCIAL",
    "sne": "SOCIAL",
    "demande de logement social": "SOCIAL",
    "commission d'attribution": "SOCIAL",
    "commission attribution": "SOCIAL",
    "caleol": "SOCIAL",
}
#: The lowest income ceiling, what is too little to be one, and bases of confidence by tier.
LOWEST_CEILING, LEAST_CEILING = 36_144, 10_000
BASE = {1: 97, 2: 90, 3: 80, 4: 70, 5: 50}
SIGNAL = "array<struct<tier:int,tenure:string,position:int,length:int>>"


#: Phrases that a word for without takes back, and the acronym that is also a word.
TAKEN_BACK = ("commission d'attribution", "commission attribution")
AMBIGUOUS = "plus"
#: Letters from which on a phrase is looked for without its gaps.
PACKED = 8


def _excluded_pattern() -> str:
    """All phrases that name a class that is not eligible, in one expression for folded text."""
    phrases = sorted((p for table in (LABELS, PROCEDURAL) for p, tenure in table.items() if tenure not in ELIGIBLE), key=lambda p: (-len(p), p))
    back = r"(?<!sans )(?<!sans passage en )"
    found = [(back if p in TAKEN_BACK else "") + inflected(p, separators=True) for p in phrases]
    return "|".join([*found, rf"(?<![a-z0-9]){AMBIGUOUS}(?![a-z0-9])"])


def excluded_word(text: Column) -> Column:
    """What names a class that is not eligible in a name, an address or a value: in its
    folded words, in its words with camel case taken apart, or, for phrases of several
    words, anywhere among its letters and digits. null for nothing or unreadable text."""
    pattern = _excluded_pattern()
    packed = {re.sub("[^a-z0-9]", "", p): p for table in (LABELS, PROCEDURAL) for p, tenure in table.items() if tenure not in ELIGIBLE and " " in p}
    bare = sorted((k for k in packed if len(k) >= PACKED), key=lambda k: (-len(k), k))
    joined = "|".join(("(?<!sans)" if packed[k] in TAKEN_BACK else "") + k for k in bare)
    apart = F.regexp_replace(F.regexp_replace(F.translate(text, ACCENTED, FOLDED), "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    found = lambda t, p: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    hit = let(F.struct(fold(text).alias("folded"), fold(apart).alias("apart")), lambda t: F.coalesce(found(t["folded"], f"(?:{pattern})"), found(t["apart"], f"(?:{pattern})"), found(F.regexp_replace(t["folded"], "[^a-z0-9]", ""), f"(?:{joined})")))
    return F.when(text.rlike(r"\p{L}") & ~text.rlike(ENTITY), F.regexp_replace(hit, r"\s+", " "))


def _pattern(phrases) -> re.Pattern:
    longest = sorted(phrases, key=lambda p: (-len(p), p))
    return re.compile(r"(?<![a-z0-9])(" + "|".join(p.replace(".", r"\.").replace(" ", r"\s+") for p in longest) + r")(?:e?s)?(?![a-z0-9])")


_LABEL, _PROCEDURE = _pattern(LABELS), _pattern(PROCEDURAL)
_CEILING = re.compile(r"plafonds? de ressources?[^0-9]{0,40}(\d{2,3}(?:[ .]?\d{3}))")
_PLUS = re.compile(r"(?<![A-Za-z0-9])PLUS(?![A-Za-z0-9])")
_FINANCED = re.compile(r"(?:logements?|financements?|categories?|types?|produits?|agrement|dispositif|programme|regime|convention\w*)\W{0,3}$")


def signals(folded: str | None, raw: str | None = None) -> list[tuple[int, str, int, int]]:
    """(tier, class, position, length) of what prose states: labels (2), procedure (3)
    and ceilings of income (4). A label across a line break can't make a listing
    eligible; the bare word for an agreement right after an eligible label is part
    of it; a capital PLUS counts after a word of financing and is a doubt else."""
    text, out = folded or "", []
    for m in _LABEL.finditer(text):
        tenure = LABELS[re.sub(r"\s+", " ", m[1])]
        if "\n" in m[0] and tenure in ELIGIBLE:
            tenure = "UNKNOWN"
        before = out[-1] if out else None
        if m[1] == "conventionne" and before and before[1] == "LLI" and text[before[2] + before[3] : m.start()].strip(" ,-") == "":
            continue
        out.append((2, tenure, m.start(), len(m[0])))
    for m in _PROCEDURE.finditer(text):
        phrase = re.sub(r"\s+", " ", m[1])
        if phrase.startswith("commission") and re.search(r"\bsans\s+(?:passage en\s+)?$", text[: m.start()][-24:]):
            continue
        out.append((3, PROCEDURAL[phrase], m.start(), len(m[0])))
    for m in _CEILING.finditer(text):
        amount = int(re.sub(r"[ .]", "", m[1]))
        if LEAST_CEILING <= amount < LOWEST_CEILING and not re.search(r"\b(?:sans|aucune?|pas de)\s+$", text[: m.start()][-16:]):
            out.append((4, "SOCIAL", m.start(), len(m[0])))
    for m in _PLUS.finditer(raw or ""):
        out.append((2, "PLUS" if _FINANCED.search((raw or "")[: m.start()].lower()[-24:]) else "UNKNOWN", m.start(), 4))
    return sorted(out, key=lambda s: (s[0], s[2], -s[3]))


def _read(folded: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([[{"tier": a, "tenure": b, "position": c, "length": d} for a, b, c, d in signals(f, r)] for f, r in zip(folded, raw, strict=True)])


#: What identifies a listing and is looked through for words as well, where it is given.
IDENTITY = ("url", "commune", "postcode", "external_id")


def _signal(tier: int, tenure_: str):
    return F.struct(F.lit(tier).alias("tier"), F.lit(tenure_).alias("tenure"), F.lit(0).alias("position"), F.lit(0).alias("length"))


def field_doubts(listings: DataFrame) -> DataFrame:
    """Adds doubts: the words that name an excluded class in what identifies a listing, in
    the names of its fields, and in the values of fields that don't state a class; a
    value that stays unreadable is the doubt ?. The card's own text, and a title or
    description that the text holds anyway, are not looked through."""
    given = F.array(*[F.col(c).cast("string") if c in listings.columns else F.lit(None).cast("string") for c in IDENTITY])
    inside = lambda e: e["key"].isin("title", "description") & (e["value"] != "") & F.contains(F.col("text"), e["value"])
    entries = F.filter(F.map_entries("fields"), lambda e: (e["key"] != "_text") & ~F.coalesce(inside(e), F.lit(False)))
    listings = listings.withColumn("__entries", F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))
    names, values = F.transform("__entries", lambda e: e["key"]), F.transform("__entries", lambda e: e["value"])
    listings = listings.withColumn("__plain", unescaped_each(F.concat(given, names, values)))
    n, first = F.size("__entries"), F.lit(len(IDENTITY) + 1)
    known = F.transform("__entries", lambda e: field_key(e["key"]).isin(*TENURE_FIELDS))
    of_value = lambda v, stated: F.when(~stated, F.when(v.rlike(ENTITY), "?").otherwise(excluded_word(v)))
    found = F.concat(
        F.transform(F.slice("__plain", F.lit(1), first - 1 + n), excluded_word),
        F.zip_with(F.slice("__plain", first + n, n), known, of_value),
    )
    return listings.withColumn("doubts", F.array_compact(found)).drop("__entries", "__plain")


def tenure(listings: DataFrame) -> DataFrame:
    """Adds doubts, signals, tenure, confidence and outcome. listings has text, fields
    (map<string,string>), default_tenure (of its source, may be null), mixed
    (boolean: the source lists several classes) and detail_read (boolean), and
    may have url, commune, postcode and external_id.

    Fields of a known name are tier 1, a list of codes among them with PLUS means that
    class, and words in any other field or in what identifies the listing are doubts of
    tier 1. The default is tier 5 and counts only without any other signal. Excluded is
    REJECT, unknown is DIGEST, a reading below 60 of a mixed source whose detail
    was not read is unknown.
    """
    named = F.filter(F.map_entries("fields"), lambda e: field_key(e["key"]).isin(*TENURE_FIELDS))
    stated = F.concat_ws("\n", F.transform(named, lambda e: fold(e["value"])))
    read = pandas_udf(_read, SIGNAL)
    by_field = F.transform(read(stated, F.lit("")), lambda s: F.struct(F.lit(1).alias("tier"), s["tenure"].alias("tenure"), s["position"].alias("position"), s["length"].alias("length")))
    codes = F.transform(F.filter(named, lambda e: code_list(e["value"]) & e["value"].rlike(rf"(?i)(?<![a-z0-9]){AMBIGUOUS}(?![a-z0-9])")), lambda e: _signal(1, "PLUS"))
    out = field_doubts(listings)
    out = out.withColumn("signals", F.concat(by_field, codes, F.transform("doubts", lambda d: _signal(1, "UNKNOWN")), read(fold(F.col("text")), F.col("text"))))
    default = F.when((F.size("signals") == 0) & F.col("default_tenure").isNotNull(), F.array(F.struct(F.lit(5).alias("tier"), F.col("default_tenure").alias("tenure"), F.lit(0).alias("position"), F.lit(0).alias("length"))))
    out = out.withColumn("signals", F.coalesce(default, F.col("signals")))
    known = F.filter("signals", lambda s: s["tenure"] != "UNKNOWN")
    doubt = F.exists("signals", lambda s: s["tenure"] == "UNKNOWN")
    first = F.array_sort(F.transform(known, lambda s: F.struct(s["tier"].alias("tier"), s["position"].alias("position"), (-s["length"]).alias("length"), s["tenure"].alias("tenure"))))
    out = out.withColumn("__win", F.try_element_at(first, F.lit(1)))
    winner = F.col("__win.tenure")
    agree = lambda s: (s["tenure"] == winner) | ((s["tenure"] == "SOCIAL") & winner.isin(*EXCLUDED)) | ((winner == "SOCIAL") & s["tenure"].isin(*EXCLUDED))
    others = F.filter(known, lambda s: s["tier"] != F.col("__win.tier"))
    base = F.element_at(F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair]), F.col("__win.tier"))
    confidence = F.greatest(F.lit(10), F.least(F.lit(99), base + 3 * F.size(F.filter(others, agree)) - 15 * F.size(F.filter(others, lambda s: ~agree(s)))))
    conflict = winner.isin(*ELIGIBLE) & (doubt | F.exists("signals", lambda s: s["tenure"].isin(*EXCLUDED)))
    weak = winner.isin(*ELIGIBLE) & (confidence < 60) & F.col("mixed") & ~F.col("detail_read")
    unknown = winner.isNull() | conflict | weak
    out = out.withColumns({"tenure": F.when(unknown, "UNKNOWN").otherwise(winner), "confidence": F.when(winner.isNull() | conflict, 0).otherwise(confidence)})
    outcome = F.when(F.col("tenure").isin(*EXCLUDED), "REJECT").when(F.col("tenure") == "UNKNOWN", "DIGEST").otherwise("MATCH")
    return out.withColumn("outcome", outcome).drop("__win")


def landlord_profiles(listings: DataFrame, landlords: DataFrame) -> DataFrame:
    """Adds landlord: the longest known name (column name, folded) that the folded
    advertiser contains, null without one.

    Every stretch of an advertiser that is as long as some name is joined to the
    names, so no pair of rows is tried that doesn't match; of the names only their
    lengths, a few tens of numbers, come to the driver.
    """
    known = landlords.select("name").where("name <> ''").distinct()
    lengths = sorted(r["n"] for r in known.select(F.length("name").alias("n")).distinct().collect())
    if not lengths:
        return listings.withColumn("landlord", F.lit(None).cast("string"))
    who = fold(F.col("advertiser"))
    starts = lambda n: F.when(F.length("who") >= n, F.sequence(F.lit(1), F.length("who") - (n - 1)))
    parts = F.flatten(F.array_compact(F.array(*[F.transform(starts(n), lambda at, n=n: F.substring("who", at, F.lit(n))) for n in lengths])))
    cut_up = listings.select("id", who.alias("who")).select("id", F.explode(F.array_distinct(parts)).alias("name"))
    best = cut_up.join(known, "name").groupBy("id").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("landlord"))
    return listings.join(best, "id", "left")


#: Ranks of a default class: an excluded one is stricter than none, none than any other.
def _strictness(tenure: Column) -> Column:
    return F.when(tenure.isNull(), 1).when(tenure.isin(*EXCLUDED), 2).otherwise(0)


def effective_profiles(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds profile, family, default_tenure and mixed of each listing's source, made
    stricter by the profile of a known landlord who advertises there.

    listings has source, landlord (a name or null) and landlord_source (its own
    source, null if it has none); profiles has (source, family, default_tenure,
    mixed). A source or a landlord without a profile counts as institutional,
    mixed and without a default."""
    named = lambda side: profiles.select(*[F.col(c).alias(f"{side}_{c}") for c in ("source", "family", "default_tenure", "mixed")])
    rows = listings.join(named("s"), F.col("source") == F.col("s_source"), "left").join(named("l"), F.col("landlord_source") == F.col("l_source"), "left")

    def strict(side, column, otherwise):
        return F.when(F.col(f"{side}_source").isNull(), otherwise).otherwise(F.col(f"{side}_{column}"))

    other = F.col("landlord").isNotNull() & (F.col("landlord_source").isNull() | (F.col("landlord_source") != F.col("source")))
    alone = other & F.col("landlord_source").isNull()
    none = F.lit(None).cast("string")
    own, theirs = ([strict(side, "family", F.lit("institutional")), strict(side, "default_tenure", none), strict(side, "mixed", F.lit(True))] for side in ("s", "l"))
    out = rows.withColumns({
        "profile": F.when(other, F.coalesce("landlord_source", "landlord")).otherwise(F.col("source")),
        "family": F.when(alone, "institutional").when(other & ((own[0] == "institutional") | (theirs[0] == "institutional")), "institutional").when(other, "private").otherwise(own[0]),
        "default_tenure": F.when(alone, none).when(other & (_strictness(theirs[1]) >= _strictness(own[1])), theirs[1]).otherwise(own[1]),
        "mixed": F.when(alone, True).when(other, own[2] | theirs[2]).otherwise(own[2]),
    })
    return out.select(*listings.columns, "profile", "family", "default_tenure", "mixed")


#: What makes a vehicle unfit unless it is negated, and what is unfit as said.
UNFIT = {
    "accidenté": r"\baccident(?:e|ee|es|ees|s)?\b",
    "gagé": r"\bgage(?:e|ee|es|ees)?\b",
    "opposition": r"\bopposition\b",
    "épave": r"\bepaves?\b",
    "VEI": r"\bvei\b",
    "VGE": r"\bvge\b",
    "procédure VE": r"\bprocedure ve\b",
    "économiquement irréparable": r"\beconomiquement irreparable\b",
    "pour pièces": r"\bpour pieces?\b",
}
UNFIT_AS_SAID = {
    "sans carte grise": r"\bsans carte grise\b|\bpas de carte grise\b|\bcarte grise (?:absente|manquante)\b",
    "CT non fourni": r"\b(?:ct|controle technique) (?:non|pas) (?:fourni|fait|ok)\b|\bsans (?:ct|controle technique)\b|\bpas de (?:ct|controle technique)\b",
    "non roulant": r"\bnon roulant\b|\bne roule (?:pas|plus)\b|\bne demarre (?:pas|plus)\b",
}
#: A negation up to two words before a word, and right after it.
BEFORE_UNFIT = r"\b(?:jamais|non|pas|aucun|aucune|sans|ni|zero|0)\b\s*(?:\S+\s+){0,2}$"
AFTER_UNFIT = r"^\s*[:?]?\s*(?:non|jamais)\b"
#: Characters before and after a word in which a negation is looked for.
BEFORE_WORD, AFTER_WORD = 40, 12
UNREADABLE = "texte illisible"


def unfit(folded: Column) -> Column:
    """Labels of what makes a vehicle unfit by its folded text: phrases that hold as they are
    said, then words that no negation beside them takes back, if one place is left."""

    def stands(pattern: str) -> Column:
        places = occurrences(folded, pattern, BEFORE_WORD, AFTER_WORD)
        return folded.rlike(pattern) & F.exists(places, lambda o: ~o["before"].rlike(BEFORE_UNFIT) & ~o["after"].rlike(AFTER_UNFIT))

    said = [F.when(folded.rlike(p), F.lit(label)) for label, p in UNFIT_AS_SAID.items()]
    return F.array_compact(F.array(*said, *[F.when(stands(p), F.lit(label)) for label, p in UNFIT.items()]))


def vehicle(listings: DataFrame) -> DataFrame:
    """Adds reasons and outcome by the text; a null text is readable and empty. A text that
    still holds an undecoded entity can't be read and is rejected for that."""
    out = listings.withColumn("__text", readable_fold(F.coalesce("text", F.lit(""))))
    reasons = F.when(F.col("__text").isNull(), F.array(F.lit(UNREADABLE))).otherwise(let(F.col("__text"), unfit))
    out = out.withColumn("reasons", reasons).drop("__text")
    return out.withColumn("outcome", F.when(F.size("reasons") > 0, "REJECT").otherwise("MATCH"))


def urgent(closes: Column, now: Column, rollup: Column) -> Column:
    """An auction that closes after now and before the next rollup."""
    return F.coalesce((closes > now) & (closes < rollup), F.lit(False))


def next_rollup(now: Column, hour: int, zone: str) -> Column:
    """The first instant after ``now`` (a timestamp in UTC) at which it is ``hour`` in a zone."""
    local = F.from_utc_timestamp(now, zone)
    at = lambda day: F.to_utc_timestamp(F.date_trunc("day", local) + F.make_interval(days=F.lit(day), hours=F.lit(hour)), zone)
    return F.when(at(0) > now, at(0)).otherwise(at(1))


def closes_before_rollup(closes: Column, now: Column, hour: int, zone: str) -> Column:
    """An auction that can't wait for the next rollup, which comes at an hour of a zone."""
    return urgent(closes, now, next_rollup(now, hour, zone))


def suppress_twins(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """Adds suppressed: a private copy one of whose twins was pushed; a direct copy
    never is. rows has id, family, pushed; twins has (a, b)."""
    both = twins.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))))
    pushed = both.join(rows.where("pushed").select(F.col("id").alias("other")), "other").select("id").distinct().withColumn("twin_pushed", F.lit(True))
    return rows.join(pushed, "id", "left").withColumn("suppressed", (F.col("family") == "private") & F.coalesce("twin_pushed", F.lit(False))).drop("twin_pushed")


def add_commute(listings: DataFrame, cache: DataFrame, most: int) -> DataFrame:
    """Adds minutes (null if unresolved) and commute share in 0 .. 1 from resolved
    journeys (commune, postcode, minutes); an unknown journey is unscored."""
    best = cache.where("minutes > 0").groupBy("commune", "postcode").agg(F.min("minutes").alias("minutes"))
    out = listings.join(best, ["commune", "postcode"], "left")
    return out.withColumn("commute_share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 * most - F.col("minutes")) / most)))
