"""Disqualifiers and scores of listings. null is unknown: never zero, never false."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.prose import let
from sluice.functions.text import commune_key, fold


def known(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Reason of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(known(c), F.lit(reason)) for c, reason in rules])


def decay(value: Column, peak: float) -> Column:
    """1 up to the peak, linear to 0 at twice the peak."""
    return F.when(value <= peak, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (value - peak) / peak))


def stem_match(name: Column, stems: list[str]) -> Column:
    """True if the folded name is a stem or goes on with a non-letter after one."""
    return F.lit(False) if not stems else fold(name).rlike("^(" + "|".join(stems) + ")(?![a-z])")


@dataclass(frozen=True)
class VehicleCriteria:
    max_price: float
    peak_age: float
    peak_mileage: float
    weights: dict[str, float]
    postcode_prefixes: list[str] = field(default_factory=list)
    body_favour: list[str] = field(default_factory=list)
    brand_avoid: list[str] = field(default_factory=list)
    brand_favour: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    hail_penalty: float = 0.0
    high_priority: int = 73
    push_min: int = 73

    def __post_init__(self):
        if set(self.brand_avoid) & set(self.brand_favour):
            raise ValueError("a brand is on both lists")


def vehicle_verdict(cars: DataFrame, criteria: VehicleCriteria) -> DataFrame:
    """Adds disqualifier, score, high_priority and outcome. cars has price, age,
    mileage, gearbox, fuel, body, make, postcode, text and hail (boolean); an
    unknown fact is unscored and never disqualifies."""
    w = criteria.weights
    outside = ~F.greatest(*[F.col("postcode").startswith(p) for p in criteria.postcode_prefixes], F.lit(False)) if criteria.postcode_prefixes else F.lit(False)
    text = fold(F.col("text"))
    rules = [(F.col("price") > criteria.max_price, "price"), (F.col("postcode").isNotNull() & outside, "location")]
    rules += [(text.rlike(p), f"pattern:{p}") for p in criteria.exclude_patterns]
    fuel = F.when(F.col("fuel").isin("essence", "hybride", "electrique"), 1.0).when(F.col("fuel") == "gpl", 0.5).otherwise(0.0)
    body = F.greatest(*[fold(F.col("body")).contains(b) for b in criteria.body_favour], F.lit(False)) if criteria.body_favour else F.lit(False)
    if criteria.brand_avoid or criteria.brand_favour:
        brand = F.when(known(stem_match(F.col("make"), criteria.brand_avoid)), 0.0).when(known(stem_match(F.col("make"), criteria.brand_favour)), 1.0).otherwise(0.0)
    else:
        brand = F.lit(1.0)
    parts = [
        w["price"] * F.greatest(F.lit(0.0), 1 - F.col("price") / criteria.max_price),
        w["age"] * decay(F.col("age"), criteria.peak_age),
        w["mileage"] * decay(F.col("mileage"), criteria.peak_mileage),
        w["gearbox"] * F.when(F.col("gearbox") == "automatique", 1.0).otherwise(0.0),
        w["fuel"] * fuel,
        w["body"] * F.when(known(body), 1.0).otherwise(0.0),
        w["brand"] * brand,
        -criteria.hail_penalty * F.when(known(F.col("hail")), 1.0).otherwise(0.0),
    ]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.round(total, 0))).cast("int")
    out = cars.withColumn("disqualifier", first_reason(*rules))
    out = out.withColumn("score", F.when(F.col("disqualifier").isNull(), score))
    return out.withColumns({"high_priority": known(F.col("score") >= criteria.high_priority), "outcome": F.when(F.col("disqualifier").isNull(), "MATCH").otherwise("REJECT")})


@dataclass(frozen=True)
class RentCriteria:
    """communes (as keys) and prefixes of postcodes say where: with communes the name
    decides and a known postcode narrows it, without them the prefix alone does.
    ranks gives the place of preferred communes, 1 the best."""

    max_rent: float
    min_surface: float
    min_rooms: int
    min_price_m2: float
    communes: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    title_excludes: tuple[str, ...] = ()
    text_excludes: tuple[str, ...] = ()
    ranks: dict[str, int] = field(default_factory=dict)
    high_priority: int = 73

    def __post_init__(self):
        for pattern in (*self.title_excludes, *self.text_excludes):
            re.compile(pattern)
        if self.communes and not set(self.ranks) <= set(self.communes):
            raise ValueError("a commune has a rank and isn't listed")

    @classmethod
    def of(cls, given: dict) -> RentCriteria:
        """Criteria out of a loaded configuration; an unknown name or no place at all is an error."""
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown criteria: {', '.join(sorted(unknown))}")
        if not given.get("communes") and not given.get("prefixes"):
            raise ValueError("no commune and no prefix: every place would match")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def starts_with_any(text: Column, prefixes) -> Column:
    return F.greatest(*[text.startswith(p) for p in prefixes], F.lit(False), F.lit(False))


def in_place(commune: Column, postcode: Column, c: RentCriteria) -> Column:
    """Whether a listing is where one is looked for; without a commune and a postcode it
    is nowhere. An unknown postcode narrows nothing, and proves nothing on its own."""
    digits = F.regexp_replace(F.coalesce(postcode, F.lit("")), "[^0-9]", "")
    by_prefix = F.lit(not c.prefixes) | starts_with_any(digits, c.prefixes)
    evidence = commune.isNotNull() | postcode.isNotNull()
    if not c.communes:
        return evidence & F.when(commune.isNull(), by_prefix).otherwise(starts_with_any(digits, c.prefixes))
    listed = commune_key(commune).isin(*c.communes) & ((digits == "") | by_prefix)
    return evidence & F.when(commune.isNull(), by_prefix).otherwise(listed)


def excluded_kind(head: Column, both: Column, c: RentCriteria) -> Column:
    """The first pattern that tells another kind of property: in the folded title, then in
    folded title and description; null if none does."""
    return F.coalesce(*[F.when(head.rlike(p), F.lit(p)) for p in c.title_excludes], *[F.when(both.rlike(p), F.lit(p)) for p in c.text_excludes], F.lit(None).cast("string"))


def heating_penalty(individual: Column, electric: Column, of_individual: int, of_electric: int) -> Column:
    """Points off for heating of one's own, and more for electric heating."""
    return F.when(individual, of_individual + F.when(electric, of_electric).otherwise(0)).otherwise(0)


def is_high_priority(score: Column, confidence: Column, bar: int, sure: int = 80) -> Column:
    """A high score of a listing whose class is sure enough."""
    return known((score >= bar) & (confidence >= sure))


def rent_judge(flats: DataFrame, c: RentCriteria) -> DataFrame:
    """Adds reason and outcome in the order in which a listing is judged: an excluded
    class, no evidence of a place, another place, another kind, too few rooms, too
    small, too dear; then a class in doubt and an implausible price are for the
    digest. flats has class_outcome, tenure, commune, postcode, title, description
    and what rent_verdict() needs."""
    rows = rent_verdict(flats, c).withColumnRenamed("outcome", "__sized")
    rows = rows.withColumns({"__title": fold(F.col("title")), "__text": fold(F.concat_ws("\n", "title", "description"))})
    # Folded once: a value that is worked out in a step of its own is not put into its uses.
    rows = rows.withColumn("__kind", let(F.struct("__title", "__text"), lambda t: excluded_kind(t["__title"], t["__text"], c)))
    kind = F.col("__kind")
    reject = F.coalesce(
        F.when(F.col("class_outcome") == "REJECT", F.concat(F.lit("tenure: "), "tenure")),
        F.when(F.col("commune").isNull() & F.col("postcode").isNull(), "no location"),
        F.when(~in_place(F.col("commune"), F.col("postcode"), c), "commune"),
        F.when(kind.isNotNull(), F.concat(F.lit("kind: "), kind)),
        F.col("disqualifier"),
    )
    doubt = F.when(F.col("class_outcome") == "DIGEST", "class").when(F.col("__sized") == "DIGEST", "price")
    out = rows.withColumn("reason", F.coalesce(reject, doubt))
    return out.withColumn("outcome", F.when(reject.isNotNull(), "REJECT").when(doubt.isNotNull(), "DIGEST").otherwise("MATCH")).drop("__sized", "__title", "__text", "__kind")


def effective_rent(cc: Column, hc: Column, charges: Column) -> Column:
    """Rent with charges, else rent without plus charges, else unknown."""
    return F.coalesce(cc, hc + charges)


def rent_verdict(flats: DataFrame, c: RentCriteria) -> DataFrame:
    """Adds rent, disqualifier, price_m2 and outcome: REJECT for a known violation,
    DIGEST for an implausibly low price per square metre, else MATCH."""
    rent = effective_rent(F.col("rent_cc"), F.col("rent_hc"), F.col("charges"))
    flats = flats.withColumn("rent", rent)
    reason = first_reason(
        (F.col("rooms") < c.min_rooms, "rooms"),
        (F.col("surface") < c.min_surface, "surface"),
        (F.col("rent") > c.max_rent, "rent"),
        (F.col("rent").isNull() & (F.col("rent_hc") > c.max_rent), "rent_hc"),
    )
    price = F.when((F.col("surface") > 0) & (F.col("rooms") > 0), F.col("rent") / F.col("surface"))
    flats = flats.withColumns({"disqualifier": reason, "price_m2": price})
    return flats.withColumn("outcome", F.when(F.col("disqualifier").isNotNull(), "REJECT").when(known(F.col("price_m2") < c.min_price_m2), "DIGEST").otherwise("MATCH"))


def rent_score(flats: DataFrame, c: RentCriteria, weights: dict[str, float], ranks: DataFrame) -> DataFrame:
    """Adds score: components rounded one by one, summed, clamped and put on 0 .. 100.
    ranks has (commune, rank), rank 1 the best; an unranked commune ranks last.
    flats has commune, rent, surface, floor, elevator and fresh."""
    worst = ranks.agg(F.max("rank").alias("worst"))
    ranked = flats.join(ranks, "commune", "left").join(F.broadcast(worst))
    place = F.coalesce("rank", "worst")
    share = F.when(F.col("worst") <= 1, 1.0).otherwise((F.col("worst") - place) / (F.col("worst") - 1))
    lift = F.when((F.col("floor") <= 1) | (F.col("elevator") == F.lit(True)), 1.0)
    high = F.when((F.col("floor") > 1) & (F.col("elevator") == F.lit(False)), -1.0)
    parts = [
        weights["commune"] * share,
        weights["headroom"] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.max_rent - F.col("rent")) / c.max_rent),
        weights["surface"] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("surface") - c.min_surface) / (0.5 * c.min_surface))),
        weights["lift"] * lift,
        weights["high_floor"] * high,
        weights["fresh"] * F.when(F.col("fresh"), 1.0),
    ]
    total = sum(w for k, w in weights.items() if w > 0 and k != "high_floor")
    summed = sum((F.coalesce(F.round(p, 0), F.lit(0.0)) for p in parts), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(total)), summed)) * 100 / total, 0) if total else F.lit(100.0)
    return ranked.withColumn("score", score.cast("int")).drop("rank", "worst")


def pay_under_floor(pay: Column, floor_year: float) -> Column:
    """True only if there are lines of pay and every one is comparable and below the
    floor. pay is an array of structs (period, max); months count thirteen."""
    yearly = lambda p: F.when(p["period"] == "YEAR", p["max"]).when(p["period"] == "MONTH", p["max"] * 13)
    return (F.size(pay) > 0) & F.forall(pay, lambda p: known(yearly(p) < floor_year))


def all_rejected(contracts: Column, rejected: list[str]) -> Column:
    """True if there are contracts and all of them are rejected kinds."""
    return (F.size(contracts) > 0) & (F.size(F.array_except(contracts, F.array(*map(F.lit, rejected)))) == 0)


def red_flags(hits: Column, penalty: float, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.size(hits) * F.lit(float(penalty)))
