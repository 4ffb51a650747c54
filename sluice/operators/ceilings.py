"""Ceilings of income: which class of letting an amount belongs to, by zone and household."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Yearly ceilings in euros of 2026 for households of one to six, by zone.
INTERMEDIATE = {
    "A bis": (44344, 66276, 86878, 103727, 123415, 138874),
    "A": (44344, 66276, 79666, 95427, 112968, 127122),
    "B1": (36144, 48268, 58043, 70073, 82432, 92900),
}
SOCIAL = {
    "Paris": {
        "PLAI": (14811, 24140, 31643, 34637, 41203, 46369),
        "PLUS": (26920, 40233, 52740, 62968, 74919, 84304),
        "PLS": (34996, 52303, 68562, 81858, 97395, 109595),
    },
    "IdF hors Paris": {
        "PLAI": (14811, 24140, 29018, 31860, 37719, 42444),
        "PLUS": (26920, 40233, 48362, 57930, 68577, 77171),
        "PLS": (34996, 52303, 62871, 75309, 89150, 100322),
    },
}
LARGEST = 6
#: A quoted amount below the lowest ceiling of a zone can only be of social letting.
ANYWHERE = "IDF"


def bands() -> list[tuple[str, str, int, str, int, int]]:
    """(zone, place, household, class, above, up_to): the intervals that the ceilings cut
    incomes into, from the lowest class to the highest."""
    found = []
    for zone, highest in INTERMEDIATE.items():
        for place, classes in SOCIAL.items():
            for size in range(LARGEST):
                above = -1
                for tenure, up_to in [*((t, c[size]) for t, c in classes.items()), ("LLI", highest[size])]:
                    if up_to > above:
                        found.append((zone, place, size + 1, tenure, above, up_to))
                        above = up_to
    return found


def open_to(households: DataFrame) -> DataFrame:
    """Adds open_class: the lowest class that is open to each household of ``households``
    (zone, place, household, income), null above every ceiling, for what isn't known,
    and for a zone without ceilings. Households of more than six count as six."""
    rows = households.sparkSession.createDataFrame(bands(), "zone string, place string, household int, open_class string, above int, up_to int")
    asked = households.withColumn("__size", F.when(F.col("household") > LARGEST, LARGEST).otherwise(F.col("household")))
    band = F.broadcast(rows.select(F.col("zone").alias("__zone"), F.col("place").alias("__place"), F.col("household").alias("__of"), "open_class", "above", "up_to"))
    fits = (F.col("zone") == F.col("__zone")) & (F.col("place") == F.col("__place")) & (F.col("__size") == F.col("__of")) & (F.col("income") > F.col("above")) & (F.col("income") <= F.col("up_to"))
    return asked.join(band, fits, "left").drop("__size", "__zone", "__place", "__of", "above", "up_to")


def quoted_ceiling_class(amount, zone):
    """Column: SOCIAL for a quoted ceiling below the lowest one of its zone, which says
    something, and null for any other, which says nothing."""
    lowest = {**{z: min(c) for z, c in INTERMEDIATE.items()}, ANYWHERE: min(min(c) for c in INTERMEDIATE.values())}
    return F.coalesce(*[F.when((zone == z) & (amount < least), "SOCIAL") for z, least in lowest.items()])
