"""Licence scan by canonical digest.

A text is brought to a canonical form that ignores case, punctuation, spacing,
copyright lines and equivalent spellings; the digest of the whole form is joined
to the digests of known licences. Everything is native: no Python worker runs.
"""

from __future__ import annotations

from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line that only states a copyright: marks of a comment, the word or a sign, and a
#: year or a place for one; or that all rights are reserved.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[<\[{])[^\n]*|(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*|all rights reserved[. \t\r]*)$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Words that licence matching treats as equal, after punctuation has become one space.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("http", "https"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("licencing", "licensing"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("programmes", "programs"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("recognised", "recognized"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Where the terms of a licence end and advice on its use begins.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


@cache
def texts() -> dict[str, str]:
    """Whole texts of common licences by their usual short names: files of licence_texts."""
    files = (resources.files(__package__) / "licence_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(files, key=lambda f: f.name) if f.name.endswith(".txt")}


def forms(text: str) -> list[str]:
    """The ways in which a whole licence is given: with and without its title, and
    with and without the advice that follows its terms."""
    title, _, rest = text.partition("\n\n")
    out = [text, rest] if len(title.split()) <= 15 else [text]
    for form in list(out):
        terms, end, advice = form.partition(END_OF_TERMS)
        if advice.strip():
            out += [terms + end, terms]
    return out


def canonical(text: Column) -> Column:
    """The canonical form; a null text counts as empty. Spellings are replaced as
    whole words: each word gets a space of its own on both sides first."""
    form = F.lower(F.coalesce(text, F.lit("")))
    form = F.regexp_replace(form, COPYRIGHT_LINE, "")
    form = F.trim(F.regexp_replace(form, NOT_WORD, " "))
    form = F.concat(F.lit(" "), F.replace(form, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, usual in SPELLINGS:
        form = F.replace(form, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.trim(F.replace(form, F.lit("  "), F.lit(" ")))


def known(spark: SparkSession, licences: dict[str, str] | None = None) -> DataFrame:
    """(licence, digest) of every form of the given licences, or of texts()."""
    rows = [(name, form) for name, text in sorted((licences or texts()).items()) for form in forms(text)]
    found = spark.createDataFrame(rows, "licence string, text string")
    return found.select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, digest, licence) for each row of ``docs``; licence is null where the
    text is no known licence as a whole. ``licences`` has (licence, digest); of
    several with one digest the first by name counts. Empty texts share the digest
    of the empty form and match only a licence that is empty. Repeated rows stay;
    other columns of ``docs`` take no part."""
    names = licences.groupBy(F.col("digest").alias("__digest")).agg(F.min("licence").alias("licence"))
    marked = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return marked.join(names, F.col("digest") == F.col("__digest"), "left").select("doc_id", "digest", "licence")


def oracle() -> str:
    """The same scan as DuckDB SQL."""

    def form(text: str) -> str:
        sql = f"lower(coalesce({text}, ''))"
        sql = f"regexp_replace({sql}, '{COPYRIGHT_LINE}', '', 'g')"
        sql = f"trim(regexp_replace({sql}, '{NOT_WORD}', ' ', 'g'))"
        sql = f"' ' || replace({sql}, ' ', '  ') || ' '"
        for variant, usual in SPELLINGS:
            sql = f"replace({sql}, ' {variant.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
        return f"trim(replace({sql}, '  ', ' '))"

    rows = ", ".join("('{}', '{}')".format(name, f.replace("'", "''")) for name, text in sorted(texts().items()) for f in forms(text))
    return f"""WITH known AS (SELECT digest, min(name) AS licence FROM (SELECT name, sha256({form('body')}) AS digest FROM (VALUES {rows}) AS t(name, body)) GROUP BY digest),
marked AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents)
SELECT m.doc_id, m.digest, k.licence FROM marked m LEFT JOIN known k ON m.digest = k.digest"""
