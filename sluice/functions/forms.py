"""Forms that a text can be read back in: a bounded closure under five decoders.

Percent-encoding, quoted-printable, unfolded headers, base64 (whole blocks and single
runs of either alphabet, at every alignment) and entities. Runs are decoded up to three
deep. Each round only expands forms that weren't seen before; the set of a text's forms
stays in its row, so nothing is shuffled.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Rounds of runs, the shortest run, and the shortest block without its breaks.
ROUNDS, RUN, BLOCK = 3, 16, 40
BASE64_RUN = rf"[A-Za-z0-9_+/\-]{{{RUN},}}"
BASE64_LINES = r"(?m)(?:^[A-Za-z0-9+/]+={0,2}\r?\n?)+"


def valid_text(octets: Column) -> Column:
    """Bytes as text, with a replacement mark for what is no UTF-8."""
    return F.make_valid_utf8(octets.cast("string"))


def percent_decoded(text: Column) -> Column:
    """%XX decoded, a plus sign and a lone percent sign left as they are."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.make_valid_utf8(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))))


def quoted_printable_decoded(text: Column) -> Column:
    """=XX decoded and soft line breaks joined."""
    joined = F.regexp_replace(text, r"=[ \t]*\r?\n", "")
    marked = F.regexp_replace(F.replace(joined, F.lit("%"), F.lit("%25")), "=([0-9A-Fa-f]{2})", "%$1")
    return percent_decoded(marked)


def unfolded(text: Column) -> Column:
    """Continuation lines joined to the line before."""
    return F.regexp_replace(text, r"\r?\n[ \t]+", "")


def base64_decoded(run: Column) -> Column:
    """Bytes of base64 in either alphabet without padding, null if it is none."""
    plain = F.translate(F.rtrim(run, F.lit("=")), "-_", "+/")
    return F.try_to_binary(F.rpad(plain, ((F.length(plain) + 3) / 4).cast("int") * 4, "="), F.lit("base64"))


def _kept(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def base64_runs(text: Column) -> Column:
    """What the runs of a text decode to, each from its first four characters on."""
    runs = F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0))
    shifted = F.transform(runs, lambda run: F.transform(F.array(*map(F.lit, range(1, 5))), lambda at: F.substring(run, at, F.length(run))))
    return _kept(F.transform(F.filter(F.flatten(shifted), lambda run: F.length(run) >= RUN), lambda run: valid_text(base64_decoded(run))))


def base64_blocks(text: Column) -> Column:
    """What blocks of lines of nothing but base64 decode to; those with a zero byte also
    as UTF-16 of either order."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(BASE64_LINES), F.lit(0)), lambda b: F.regexp_replace(b, r"\s+", ""))
    octets = F.transform(F.filter(blocks, lambda b: F.length(b) >= BLOCK), base64_decoded)
    octets = F.filter(octets, lambda b: b.isNotNull())
    wide = F.filter(octets, lambda b: F.locate("00", F.regexp_replace(F.hex(b), "(..)", "$1 ")) > 0)
    return _kept(F.flatten(F.array(F.transform(octets, valid_text), F.transform(wide, _narrowed("$2$1")), F.transform(wide, _narrowed("$1$2")))))


def _narrowed(order: str) -> Callable[[Column], Column]:
    """UTF-16 of letters of one byte as text: its zero bytes are what is in the way."""
    return lambda octets: valid_text(F.unhex(F.regexp_replace(F.regexp_replace(F.hex(octets), "(..)(..)", order), "00(..)", "$1")))


def _entities(forms: pd.Series) -> pd.Series:
    return forms.map(lambda all_: [html.unescape(f) for f in all_ if "&" in f], na_action="ignore")


def _expanded(forms: Column, decode: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(forms, decode))


def with_forms(df: DataFrame, text: str, name: str = "forms") -> DataFrame:
    """``df`` with an array of the distinct forms of ``text``, the text itself first.

    A null text has null forms, an empty one only itself. What doesn't decode is left
    out; bytes that are no text appear as replacement marks. ``df`` must have no columns
    __near, __queue and ``name``.
    """
    t = F.col(text)
    df = df.withColumn("__near", F.array_distinct(F.array(t, quoted_printable_decoded(t), unfolded(t))))
    df = df.withColumn("__queue", F.array_union("__near", _expanded(F.col("__near"), base64_blocks)))
    df = df.withColumn(name, F.array_union("__queue", F.array(quoted_printable_decoded(unfolded(t)))))
    for _ in range(ROUNDS):
        df = df.withColumn("__queue", F.array_except(_expanded(F.col("__queue"), lambda f: base64_runs(percent_decoded(f))), name))
        df = df.withColumn(name, F.array_union(name, "__queue"))
    entities = pandas_udf(_entities, "array<string>")(F.col(name))
    last = F.array_union(F.array_union(name, F.transform(name, percent_decoded)), entities)
    return df.withColumn(name, F.when(t.isNotNull(), last)).drop("__near", "__queue")


def reveals(forms: Column, secret: Column) -> Column:
    """Whether any form holds the secret, whatever the case."""
    return F.exists(forms, lambda f: F.contains(F.lower(f), F.lower(secret)))
