"""Scrubbing of captured mail: mask what identifies the reader, then prove that nothing is left.

Everything is an expression over one row. Masking knows the usual tokens; the proof reads
every form that the result could be read back in (see functions.forms). A mail that still
reveals something fails as a row, with its reasons and without content; the job goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.forms import base64_runs, percent_decoded, quoted_printable_decoded, reveals, with_forms

#: Headers that name the reader or the message and are dropped whole.
DROPPED = (
    "to", "cc",
    "delivered-to", "received", "x-received", "return-path", "received-spf",
    "authentication-results", "arc-seal", "arc-message-signature",
    "arc-authentication-results", "dkim-signature", "reply-to", "feedback-id",
    "list-unsubscribe", "list-unsubscribe-post", "x-sfmc-stack", "x-delivery",
    "x-csa-complaints", "message-id",
    "x-mailin-eid", "x-sib-id", "x-mailin-client",
    "x-msfbl",
    "x-mailgun-sid",
    "x-mj-mid",
    "x-sg-eid",
    "x-entity-id",
)
#: Parameters of links that say who follows them.
LINK_PARAMETERS = ("trackingId", "refId", "lipi", "midToken", "midSig", "trkEmail", "trk", "eid", "otpToken", "savedSearchId")
#: What stands in for a reader.
READER, SOMEONE = "alertes@example.invalid", "abonne"
#: A local part as short as this isn't looked for on its own: noise would hold it.
DISTINCTIVE = 6

_SOFT = r"(?:=\r?\n)?"
_HEX = "[0-9a-fA-F]"
_BODY = r"(?<=\n)\r?\n"


def _where(text: Column, pattern: str, masked: Column) -> Column:
    """``masked`` where the pattern holds; other texts aren't taken apart for it."""
    return F.when(text.rlike(pattern), masked).otherwise(text)


def _woven(text: Column, pattern: str, masks: Column) -> Column:
    """The text with its matches replaced by as many masks, one for each."""
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(pieces, masks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def masked_in_turn(text: Column, pattern: str, mask) -> Column:
    """Each match replaced by ``mask`` of its number, from 1 (and of the match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _where(text, pattern, _woven(text, pattern, F.transform(found, lambda match, i: mask(i + 1, match))))


def masked_alike(text: Column, pattern: str, mask) -> Column:
    """Each distinct match, whatever the case, replaced by ``mask`` of its number and itself."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
    # The matches and, once for each text, their distinct names.
    masks = F.flatten(F.transform(F.array(F.array_distinct(found)), lambda names: F.transform(found, lambda match: mask(F.array_position(names, match), match))))
    return _where(text, pattern, _woven(text, pattern, masks))


def through_breaks(literal: Column) -> Column:
    """A pattern for a text in any case that soft line breaks may cut anywhere."""
    return F.concat(F.lit("(?i)"), F.regexp_replace(literal, r"([\s\S])", r"\\Q$1\\E" + _SOFT.replace("\\", "\\\\")))


def _masked_literals(text: Column, literals: Column, mask: str) -> Column:
    return F.aggregate(literals, text, lambda t, literal: F.regexp_replace(t, through_breaks(literal), F.lit(mask)))


def _masked_tokens(text: Column, secrets: Column, pattern: str, decode, name: str, sign: str) -> Column:
    """Tokens that decode to something with a secret in it, replaced whole. A text without
    the sign, a short part of any token, has none."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    telling = F.filter(tokens, lambda token: F.exists(secrets, lambda s: reveals(decode(token), s)))
    return _where(text, sign, F.aggregate(telling, text, lambda t, token: F.replace(t, token, F.lit(name))))


def without_headers(content: Column) -> Column:
    """Dropped headers out of the block before the first blank line, continuation lines with them."""
    end = F.regexp_instr(content, F.lit(_BODY))
    head = F.when(end > 0, F.substring(content, F.lit(1), end - 1)).otherwise(content)
    body = F.when(end > 0, F.substring(content, end, F.length(content))).otherwise("")
    names = "|".join(DROPPED)
    return F.concat(F.regexp_replace(head, rf"(?im)^(?:{names})[ \t]*:[^\n]*(?:\n[ \t][^\n]*)*\n?", ""), F.lit("To: <" + READER + ">\n"), body)


def scrubbed(mails: DataFrame) -> DataFrame:
    """(path, content, leaks) of mails (path, content, address, needles array<string>).

    content is the mail with its tokens, addresses and needles masked, and leaks is
    empty; or content is null and leaks says which of them can still be read. A null
    content stays null without leaks; a null address or needle hides nothing. Blank
    needles count as none.
    """
    empty = F.array().cast("array<string>")
    blank = lambda s: s.isNotNull() & (F.trim(s) != "")
    local = F.split("address", "@")[0]
    mails = mails.select("path", "content", F.filter(F.array("address"), blank).alias("__address"), F.filter(F.array(F.when(F.length(local) >= DISTINCTIVE, local)), blank).alias("__local"), F.filter(F.coalesce("needles", empty), blank).alias("__needles"))
    secrets = mails.withColumn("__secrets", F.concat("__address", "__local", "__needles"))
    now = secrets.withColumn("__text", without_headers(F.col("content")))

    number = lambda i, width: F.lpad(i.cast("string"), width, "0")
    text = F.col("__text")
    steps = [
        masked_in_turn(text, r"(?<![A-Za-z0-9_])qs=[A-Za-z0-9_\-]+", lambda i, _: F.concat(F.lit("qs=FIXTURE"), number(i, 3))),
        masked_in_turn(text, r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}", lambda i, _: F.concat(F.lit("SIGNED.FIXTURE"), number(i, 3))),
        masked_in_turn(text, rf"(?<=(?<![A-Za-z0-9_])(?:{'|'.join(LINK_PARAMETERS)})=)[^&\"'<>\s=]+", lambda i, _: F.concat(F.lit("FIXTURE"), number(i, 3))),
        masked_in_turn(text, rf"(?<![0-9a-fA-F-]){_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}(?![0-9a-fA-F-])", lambda i, _: F.concat(F.lit("ffffffff-0000-4000-8000-00000000"), number(i, 4))),
        masked_alike(text, rf"(?<!{_HEX}){_HEX}{{24,}}(?!{_HEX})", lambda i, token: F.rpad(F.concat(F.lit("f0f0f0f0"), i.cast("string")), F.length(token), "0")),
        _masked_literals(text, F.col("__address"), READER),
        _masked_literals(text, F.col("__local"), READER.split("@")[0]),
        _masked_literals(text, F.col("__needles"), SOMEONE),
        _masked_tokens(text, F.col("__secrets"), r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~-])*%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~-])*", lambda t: F.array(percent_decoded(t)), "FIXTURE", "%[0-9A-Fa-f]{2}"),
        _masked_tokens(text, F.col("__secrets"), r"(?:[A-Za-z0-9._~-]|=\r?\n)*(?:=[0-9A-F]{2}(?:[A-Za-z0-9._~-]|=\r?\n)*)+", lambda t: F.array(quoted_printable_decoded(t)), "FIXTURE", "=[0-9A-F]{2}"),
        _masked_tokens(text, F.col("__secrets"), r"[A-Za-z0-9_+/\-]{16,}={0,2}", base64_runs, "FIXTURE", r"[A-Za-z0-9_+/\-]{16}"),
    ]
    for step in steps:
        now = now.withColumn("__text", step)
    proven = with_forms(now, "__text", "__forms")
    leaks = F.filter("__secrets", lambda s: reveals(F.col("__forms"), s))
    proven = proven.withColumn("leaks", F.coalesce(leaks, empty))
    return proven.select("path", F.when(F.size("leaks") == 0, F.col("__text")).alias("content"), "leaks")
