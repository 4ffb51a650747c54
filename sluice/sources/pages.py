"""Scans over raw pages: cards, links, embedded JSON, JSON-LD and sitemaps."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r"<a\s[^>]*?href=[\"']([^\"']*)[\"']"
TAGS = r"<[^>]*>"
#: Entities that texts are decoded from, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    for entity, letter in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return text


def links(html: Column) -> Column:
    """Distinct targets of links in order of the page."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)))


def element_text(html: Column, tag: str) -> Column:
    """Text of the first element of a kind without its tags, null without one."""
    inner = F.regexp_extract(html, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.when(html.rlike(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.trim(decode_entities(F.regexp_replace(inner, TAGS, ""))))


def attribute(html: Column, tag: str, name: str) -> Column:
    """Attribute of the first element of a kind that has it, null without one."""
    found = F.regexp_extract(html, rf"<{tag}\s[^>]*?{name}=[\"']([^\"']*)[\"']", 1)
    return F.when(found != "", found)


def embedded_json(html: Column, marker: str) -> Column:
    """Text of the first script whose tag holds the marker."""
    found = F.regexp_extract(html, rf"(?s)<script[^>]*{marker}[^>]*>(.*?)</script>", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def json_ld(pages: DataFrame, kind: str) -> DataFrame:
    """(url, node): the first JSON-LD node of a page whose @type is ``kind``, on its own or in a list."""
    blocks = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))).alias("block", "text"))
    alone = blocks.select("url", "block", F.lit(0).alias("place"), F.trim("text").alias("node")).where(F.col("node").startswith("{"))
    listed = blocks.select("url", "block", F.posexplode(F.from_json(F.trim("text"), "array<string>")).alias("place", "node"))
    typed = alone.union(listed).where(F.get_json_object("node", "$['@type']") == kind)
    return typed.groupBy("url").agg(F.min_by("node", F.struct("block", "place")).alias("node"))


def sitemap(files: DataFrame, item: str) -> DataFrame:
    """(id, loc) of a sitemap's locations (column xml) whose address matches ``item``;
    the id is its first group. A file that names no item is an error."""
    found = files.select("xml", F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)).alias("locs"))
    found = found.withColumn("locs", F.filter("locs", lambda l: l.rlike(item)))
    checked = found.withColumn("locs", F.when(F.size("locs") > 0, F.col("locs")).otherwise(F.raise_error(F.lit("a sitemap without items"))))
    return checked.select(F.explode("locs").alias("loc")).select(F.regexp_extract("loc", item, 1).alias("id"), decode_entities(F.col("loc")).alias("loc"))


class _Cards(HTMLParser):
    """Collects elements with a class: text, attributes and data-* of everything inside."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, tag: str, css: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css, self.depth, self.cards = tag, css, 0, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if not self.depth:
            # What can't close can't hold anything either: it is a card of its own.
            if tag != self.tag or (self.css and self.css not in (given.get("class") or "").split()):
                return
            self.cards.append({"_text": []} | {f"attr.{k}": v or "" for k, v in given.items() if not k.startswith("data-")})
            self.depth = 1
        elif tag == self.tag:
            self.depth += 1
        card = self.cards[-1]
        for name, value in given.items():
            if name.startswith("data-"):
                card.setdefault(f"data.{name[5:]}", value or "")
            elif name == "href":
                card.setdefault("href", value or "")
        if self.tag in self.VOID:
            self.depth = 0

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.cards[-1]["_text"].append(data)


def cards(pages: DataFrame, tag: str, css: str | None = None) -> DataFrame:
    """(url, place, fields map): one row per element ``tag`` with class ``css`` of each page.
    A page without any is an error of the scan, told apart by scan_errors()."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                parser = _Cards(tag, css)
                parser.feed(html or "")
                out += [(url, i, {k: " ".join("".join(v).split()) if k == "_text" else v for k, v in c.items()}) for i, c in enumerate(parser.cards)]
            yield pd.DataFrame(out, columns=["url", "place", "fields"])

    return pages.select("url", "html").mapInPandas(parse, "url string, place int, fields map<string,string>")


def scan_errors(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(url): pages of which a scan made nothing: broken, not empty."""
    return pages.select("url").join(found.select("url").distinct(), "url", "left_anti")


def short_collect(found: DataFrame, declared: DataFrame, page_size: int) -> DataFrame:
    """(source, n, total): sources that collected fewer items than their page declares,
    by a page or more."""
    per = found.groupBy("source").agg(F.count("*").alias("n"))
    return declared.join(per, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < F.col("total") - (page_size - 1)).select("source", "n", "total")


def unseen(index: DataFrame, known: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` items of an index, by id, that are not known yet."""
    return index.join(known.select("id"), "id", "left_anti").orderBy("id").limit(budget)


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed): the longest rule that matches decides, allow wins ties, no
    rule allows. rules has (host, allow boolean, pattern) with * and a closing $."""
    escaped = F.regexp_replace("pattern", r"([.+?^(){}\[\]|\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")))
    rules = rules.where("pattern <> ''").select(F.col("host").alias("h"), "allow", "pattern", regex.alias("regex"))
    hits = paths.join(rules, (F.col("host") == F.col("h")) & F.rlike("path", F.col("regex")), "left")
    best = F.max_by("allow", F.struct(F.length("pattern"), F.col("allow").cast("int")))
    return hits.groupBy("host", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))


#: Types of answers that are no rules, and statuses that say there are none.
NO_RULES_TYPES = ("text/html", "application/xhtml+xml", "application/json", "application/xml", "text/xml")
NO_RULES_STATUS = (404, 410)
_RULES = "array<struct<allow:boolean,pattern:string>>"


def robots_rules(answers: DataFrame, agent: str) -> DataFrame:
    """(host, readable, rules) of answers (host, status, content_type, body) to the request
    for the rules of a host.

    A page or a document instead of rules, a status other than success and no status at
    all are unreadable; not found and gone mean that there are no rules. The groups of the
    agent count, or those for everyone if it has none; rules without a path say nothing.
    """
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    body = F.coalesce("body", F.lit(""))
    other = kind.isin(*NO_RULES_TYPES) | F.ltrim(F.regexp_replace(body, r"^\s+", "")).rlike(r"^[<{]")
    success = F.col("status").between(200, 299)
    readable = F.coalesce(F.when(success, ~other).otherwise(F.col("status").isin(*NO_RULES_STATUS)), F.lit(False))

    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), lambda l: F.trim(F.regexp_replace(l, "#.*$", ""))), lambda l: l.contains(":"))
    pairs = F.transform(lines, lambda l: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))).alias("field"), F.trim(F.regexp_replace(l, "^[^:]*:", "")).alias("value")))
    none = F.array().cast(_RULES)
    start = F.struct(F.lit(None).cast("string").alias("agent"), none.alias("own"), none.alias("any"), F.lit(False).alias("named"))
    needle = agent.lower()

    def step(now: Column, pair: Column) -> Column:
        named = lambda a: (a == needle) | ((a != "*") & F.lit(needle).contains(a))
        rule = F.array(F.struct((pair["field"] == "allow").alias("allow"), pair["value"].alias("pattern")))
        tells = pair["field"].isin("allow", "disallow") & (pair["value"] != "")
        opens = pair["field"] == "user-agent"
        who = F.lower(pair["value"])
        return F.struct(
            F.when(opens, who).otherwise(now["agent"]).alias("agent"),
            F.when(tells & named(now["agent"]), F.concat(now["own"], rule)).otherwise(now["own"]).alias("own"),
            F.when(tells & (now["agent"] == "*"), F.concat(now["any"], rule)).otherwise(now["any"]).alias("any"),
            (now["named"] | F.coalesce(opens & named(who), F.lit(False))).alias("named"),
        )

    read = F.aggregate(pairs, start, step, lambda now: F.when(now["named"], now["own"]).otherwise(now["any"]))
    return answers.select("host", readable.alias("readable"), F.when(readable & success, read).otherwise(none).alias("rules"))


def robots_verdicts(paths: DataFrame, answers: DataFrame, agent: str) -> DataFrame:
    """(host, path, allowed) for each distinct row of ``paths``: the longest rule decides,
    allow wins ties, no rule allows; a host without a readable answer allows nothing."""
    rules = robots_rules(answers, agent)

    def fits(pattern: Column, path: Column) -> Column:
        escaped = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^$(){}\[\]|\\])", r"\\$1")
        return F.rlike(path, F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise("")))

    rows = paths.select("host", "path").distinct().join(rules, "host", "left")
    asked = F.when(F.coalesce("path", F.lit("")) == "", "/").otherwise(F.col("path"))
    best = F.array_max(F.transform(F.filter("rules", lambda r: fits(r["pattern"], asked)), lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return rows.select("host", "path", F.when(F.coalesce("readable", F.lit(False)), F.coalesce(best["allow"], F.lit(True))).otherwise(False).alias("allowed"))
