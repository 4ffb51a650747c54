"""Records to listings by a field map, and snapshots of listings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import first_present, normalise_url, number, plausible


def read_items(spark: SparkSession, path: str, items: str) -> DataFrame:
    """(item): JSON of each element of the list at a dotted path of each document.
    A document without that list is an error."""
    docs = spark.read.text(path, wholetext=True)
    found = F.from_json(F.get_json_object("value", "$." + items), "array<string>")
    return docs.select(F.explode(F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("no list of items")))).alias("item"))


def path_value(item: Column, path: str) -> Column:
    return F.get_json_object(item, "$." + path)


def fingerprint(field_map: dict[str, list[str]]) -> str:
    """16 hex digits that change with the map."""
    return hashlib.sha256(json.dumps(field_map, sort_keys=True).encode()).hexdigest()[:16]


def listings(items: DataFrame, field_map: dict[str, list[str]], base_url: str, charges_included: bool) -> DataFrame:
    """Maps (item) to ref, title, url, commune, postcode, rent_cc, rent_hc, charges,
    surface, rooms. Each field takes the first of its paths with a value; a record
    without ref is an error; rents and sizes outside of what is plausible are unknown."""
    get = lambda name: first_present(*[path_value(F.col("item"), p) for p in field_map.get(name, [])]) if field_map.get(name) else F.lit(None).cast("string")
    rent = plausible(number(get("rent")), 200, 20_000)
    url = get("url")
    none = F.lit(None).cast("double")
    return items.select(
        F.coalesce(get("ref"), F.raise_error(F.lit("a record without ref"))).alias("ref"),
        get("title").alias("title"),
        normalise_url(F.when(url.rlike("^[a-z]+://"), url).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), F.ltrim(url, F.lit("/"))))).alias("url"),
        get("commune").alias("commune"),
        get("postcode").alias("postcode"),
        (rent if charges_included else none).alias("rent_cc"),
        (none if charges_included else rent).alias("rent_hc"),
        number(get("charges")).alias("charges"),
        plausible(number(get("surface")), 5, 1000).alias("surface"),
        plausible(number(get("rooms")), 1, 12).cast("int").alias("rooms"),
    )


def snapshot(rows: DataFrame, name: str = "snapshot") -> DataFrame:
    """Adds the whole row as JSON, unknown values kept as null."""
    return rows.withColumn(name, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))


def restore(rows: DataFrame, schema: str, name: str = "snapshot") -> DataFrame:
    """Rows out of snapshots; readable is false where a snapshot can't be decoded."""
    decoded = F.from_json(name, schema)
    return rows.withColumn("row", decoded).withColumn("readable", F.coalesce(F.get_json_object(name, "$").isNotNull() & F.col("row").isNotNull(), F.lit(False))).select("readable", "row.*")


def restore_or_rebuild(rows: DataFrame, schema: str, stored: dict[str, str], name: str = "snapshot") -> DataFrame:
    """Rows out of snapshots; where one can't be read, a row of the columns that ``stored``
    names for its fields, the rest unknown. degraded tells which."""
    back = F.from_json(name, schema)
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    rebuilt = F.struct(*[(F.col(stored[f.name]) if f.name in stored else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    readable = F.coalesce(F.try_parse_json(name).isNotNull() & (F.trim(name) != "") & back.isNotNull(), F.lit(False))
    keep = [c for c in rows.columns if c != name and c not in {f.name for f in fields}]
    out = rows.withColumns({"degraded": ~readable, "__row": F.when(readable, back).otherwise(rebuilt)})
    return out.select(*keep, "degraded", "__row.*")


def merge_detail(cards: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Cards with what their detail page knows; identity and what it doesn't know stay."""
    fresh = details.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = cards.join(fresh, key, "left")
    for f in fields:
        value = F.col(f"__{f}")
        out = out.withColumn(f, F.coalesce(F.when(F.trim(value.cast("string")) != "", value), F.col(f)))
    return out.select(*cards.columns)


def to_hydrate(cards: DataFrame, cache: DataFrame, fingerprint_: str, now: int, budget: int, attempts: int = 3, backoff: int = 6 * 3600) -> DataFrame:
    """The ``budget`` cards to fetch next: without a cached page of this field map,
    fewer failures than ``attempts``, the last one ``backoff`` seconds ago."""
    state = cache.select("ref", "map_fingerprint", "failures", "last_attempt")
    open_ = cards.join(state, "ref", "left").where((F.col("map_fingerprint").isNull() | (F.col("map_fingerprint") != fingerprint_)) & (F.coalesce("failures", F.lit(0)) < attempts) & (F.col("last_attempt").isNull() | (F.lit(now) - F.col("last_attempt") >= backoff)))
    return open_.orderBy("priority", "ref").limit(budget).select(*cards.columns)
