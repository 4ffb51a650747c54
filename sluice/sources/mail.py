"""Alert mails: .eml files to messages, messages to cards."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import LINK, decode_entities

_HREF = re.compile(LINK, re.I)
_TAG = re.compile(r"<[^>]*>")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the mails of a folder, by any file system Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", "content")


def _body(message) -> tuple[str, list[str]]:
    part = message.get_body(preferencelist=("plain", "html"))
    html = message.get_body(preferencelist=("html",))
    links = _HREF.findall(html.get_content()) if html is not None else []
    if part is None:
        return "", links
    text = part.get_content()
    if part.get_content_subtype() == "html":
        text = _TAG.sub(" ", re.sub(r"(?i)<(br|/p|/div|/tr)[^>]*>", "\n", text))
    return text, links + re.findall(r"https?://[^\s<>\"]+", text)


def messages(files: DataFrame) -> DataFrame:
    """(path, sender, subject, sent, body, links): decoded mails; what can't be read has nulls."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    m = email.message_from_bytes(bytes(content), policy=email.policy.default)
                    body, links = _body(m)
                    sent = parsedate_to_datetime(m["date"]).timestamp() if m["date"] else None
                    out.append((path, str(m["from"] or ""), str(m["subject"] or ""), sent, body, list(dict.fromkeys(links))))
                except (ValueError, LookupError, TypeError):
                    out.append((path, None, None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "sender", "subject", "sent", "body", "links"])

    return files.mapInPandas(decode, "path string, sender string, subject string, sent double, body string, links array<string>")


def from_sender(mails: DataFrame, sender: str, subject: str | None = None) -> DataFrame:
    kept = mails.where(F.lower("sender").contains(sender.lower()))
    return kept if subject is None else kept.where(F.col("subject").rlike(subject))


def segments(mails: DataFrame, separator: str, key: str, text: str, item: str) -> DataFrame:
    """(key, place, id, text): pieces of a text between separators with an id in them;
    the first piece of an id counts."""
    pieces = mails.select(key, F.posexplode(F.split(text, separator)).alias("place", "text"))
    named = pieces.withColumn("id", F.regexp_extract("text", item, 1)).where("id <> ''")
    first = named.groupBy(key, "id").agg(F.min("place").alias("place"), F.min_by("text", "place").alias("text"))
    return first.select(key, "place", "id", "text")


def listing_links(links, host: str):
    """Distinct links of a host without those that unsubscribe or count views."""
    noise = "(?i)unsubscribe|desabonne|preferences|pixel|/open/"
    return F.array_distinct(F.filter(links, lambda l: l.contains(host) & ~l.rlike(noise)))


def last_match(text, pattern: str, group: int = 1):
    """The last match of a pattern, null without one."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def title_line(text):
    """The first line that is no address."""
    lines = F.filter(F.split(decode_entities(text), "\n"), lambda l: (F.trim(l) != "") & ~l.rlike("^ *https?://"))
    return F.when(F.size(lines) > 0, F.trim(lines[0]))
