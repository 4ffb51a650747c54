"""Texts with something planted in them: forms that they can be read back in, and scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import forms
from sluice.operators import scrub
from sluice.plans.registry import query
from sluice.plans.views import table

_MODES = 8


def _base64(text: Column) -> Column:
    return F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")


def _bytes_as(text: Column, mark: str) -> Column:
    return F.regexp_replace(F.hex(text.cast("binary")), "(..)", f"{mark}$1")


def planted(secret: Column, turn: Column) -> Column:
    """The secret in one of eight spellings: none, as it is, percent, base64, base64 of
    percent, base64 three times, quoted-printable, and base64 four times, which is
    deeper than anything is read."""
    thrice = _base64(_base64(_base64(secret)))
    spellings = ("", secret, _bytes_as(secret, "%"), _base64(secret), _base64(_bytes_as(secret, "%")), thrice, _bytes_as(secret, "="), _base64(thrice))
    choice = F.lit(None).cast("string")
    for i, spelling in enumerate(spellings):
        choice = F.when(turn == i, spelling).otherwise(choice)
    return choice


def _captured(spark, sf_dir):
    """(doc_id, turn, secret, content): whole documents with an address between marks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({"turn": F.col("doc_id") % _MODES, "secret": F.concat(F.lit("visitor."), F.col("doc_id").cast("string"), F.lit("@planted.example"))})
    return d.withColumn("content", F.concat("text", F.lit("\nid <"), planted(F.col("secret"), F.col("turn")), F.lit("> end")))


#: SQL of its own for what is planted and for how each spelling is read back.
_CAPTURED_SQL = f"""s AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % {_MODES} AS turn, 'visitor.' || doc_id || '@planted.example' AS secret FROM documents),
  e AS (SELECT *, regexp_replace(hex(encode(secret)), '(..)', '%\\1', 'g') AS percent, regexp_replace(hex(encode(secret)), '(..)', '=\\1', 'g') AS printable FROM s),
  p AS (SELECT *, CASE turn WHEN 0 THEN '' WHEN 1 THEN secret WHEN 2 THEN percent WHEN 3 THEN to_base64(encode(secret)) WHEN 4 THEN to_base64(encode(percent))
      WHEN 5 THEN to_base64(encode(to_base64(encode(to_base64(encode(secret)))))) WHEN 6 THEN printable ELSE to_base64(encode(to_base64(encode(to_base64(encode(to_base64(encode(secret)))))))) END AS token FROM e),
  m AS (SELECT *, text || chr(10) || 'id <' || token || '> end' AS content FROM p),
  b AS (SELECT *, regexp_extract(content, 'id <([^>]*)> end$', 1) AS found FROM m),
  c AS (SELECT *, CASE turn WHEN 3 THEN decode(from_base64(found)) WHEN 4 THEN url_decode(decode(from_base64(found))) WHEN 5 THEN decode(from_base64(decode(from_base64(decode(from_base64(found))))))
      WHEN 6 THEN url_decode(replace(found, '=', '%')) WHEN 7 THEN decode(from_base64(decode(from_base64(decode(from_base64(found))))) ) ELSE url_decode(found) END AS reading FROM b)"""


@query(f"WITH {_CAPTURED_SQL} SELECT doc_id, contains(reading, secret) AS revealed, url_decode(found) AS percent_decoded FROM c")
def recoverable_forms(spark, sf_dir):
    """Whether an address that a whole text holds in some spelling can be read back from it."""
    found = forms.with_forms(_captured(spark, sf_dir), "content")
    token = F.regexp_extract("content", "id <([^>]*)> end$", 1)
    return found.select("doc_id", forms.reveals(F.col("forms"), F.col("secret")).alias("revealed"), forms.percent_decoded(token).alias("percent_decoded"))


@query(f"""WITH {_CAPTURED_SQL} SELECT doc_id, turn NOT IN (4, 5) AS passed, CASE WHEN turn IN (4, 5) THEN 2 ELSE 0 END AS n_leaks,
  CASE WHEN turn NOT IN (4, 5) THEN CASE turn WHEN 0 THEN '' WHEN 1 THEN 'alertes@example.invalid' WHEN 7 THEN token ELSE 'FIXTURE' END END AS token FROM c""")
def scrubbed_mails(spark, sf_dir):
    """Documents as captured mails: what is masked, and what is refused because an address
    survives in a wrapping that masking doesn't know."""
    c = _captured(spark, sf_dir)
    content = F.concat(F.lit("From: sender@portal.example\nTo: Some Reader <"), F.col("secret"), F.lit(">\nSubject: s\n\n"), F.col("content"))
    mails = c.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), F.col("secret").alias("address"), F.array(F.col("secret")).alias("needles"))
    found = scrub.scrubbed(mails)
    token = F.when(F.col("content").isNotNull(), F.regexp_extract("content", "id <([^>]*)> end$", 1))
    return found.select(F.col("path").cast("long").alias("doc_id"), F.col("content").isNotNull().alias("passed"), F.size(F.array_distinct("leaks")).alias("n_leaks"), token.alias("token"))
