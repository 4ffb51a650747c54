import base64
import html
import re
from urllib.parse import unquote_to_bytes

import pytest

from pyspark.sql import functions as F
from sluice.functions import forms
from sluice.operators import scrub

SECRET = "visitor.77@planted.example"


def text_of(octets):
    return octets.decode("utf-8", "replace")


def b64(s, times=1):
    for _ in range(times):
        s = base64.b64encode(s.encode()).decode()
    return s


def strict(run):
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except ValueError:
        return b""


def closure(text):
    """Every form by a list that only grows: three rounds of runs, then percent and entities."""
    percent = lambda t: text_of(unquote_to_bytes(t.encode()))
    joined = re.sub(r"\r?\n[ \t]+", "", text)
    # A lone = stays, which quopri leaves out.
    printable = lambda t: text_of(re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), re.sub(rb"=[ \t]*\r?\n", b"", t.encode())))
    near = [text, printable(text), joined]
    queue = list(near)
    for t in near:
        for block in re.findall(r"(?m)(?:^[A-Za-z0-9+/]+={0,2}\r?\n?)+", t):
            whole = re.sub(r"\s+", "", block)
            if len(whole) >= 40:
                octets = strict(whole)
                queue += [text_of(octets)]
                if b"\0" in octets:
                    queue += [octets.decode("utf-16-le", "replace"), octets.decode("utf-16-be", "replace")]
    found = queue + [printable(joined)]
    for _ in range(3):
        queue = [text_of(strict(run[at:])) for t in queue for run in re.findall(r"[A-Za-z0-9_+/\-]{16,}", percent(t)) for at in range(4) if len(run) - at >= 16]
        found += queue
    return {f for t in found for f in (t, percent(t), html.unescape(t)) if f}


PCT, QP = "".join(f"%{c:02X}" for c in SECRET.encode()), "".join(f"={c:02X}" for c in SECRET.encode())
WRAPPED = {
    "plain": (f"to {SECRET}!", True), "percent": (f"id={PCT} x", True), "base64": (f"id={b64(SECRET)};x", True), "of percent": (f"id={b64(PCT)} x", True),
    "thrice": (f"<{b64(SECRET, 3)}>", True), "four times": (f"<{b64(SECRET, 4)}>", False), "printable": (f"id {QP} 100% of + a", True), "shifted": (f"id=x{b64(SECRET)} ", True),
    "entities": ("&#118;isitor.77&#64;planted.example", True), "folded": (f"x-h: {b64(SECRET)[:10]}\r\n  {b64(SECRET)[10:]}", True), "block": (f"a b\n{b64('hello ' + SECRET + ' and more words here')}\nz y", True),
    "wide": ("a b\n" + base64.b64encode(f"hi {SECRET} more".encode("utf-16-le")).decode() + "\n", True), "wide, high byte first": ("a b\n" + base64.b64encode(f"hi {SECRET} more".encode("utf-16-be")).decode() + "\n", True),
    "other alphabet": ("k=" + base64.urlsafe_b64encode((">>>???" + SECRET).encode()).decode() + " ", True), "none": ("nothing", False), "empty": ("", False), "lone percent": ("100% %zz %4", False),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in WRAPPED.items()] + [("null", None)], "name string, text string")
    return {r["name"]: r for r in forms.with_forms(df, "text").withColumn("told", forms.reveals(F.col("forms"), F.lit(SECRET.upper()))).collect()}


@pytest.mark.parametrize("name", WRAPPED)
def test_forms_against_a_written_out_closure(found, name):
    text, told = WRAPPED[name]
    got = set(found[name]["forms"]) - {""}
    want = closure(text)
    assert found[name]["told"] is told and len(got) == len(found[name]["forms"]) - (text == "")
    # Noise isn't compared: either side has marks of its own for bytes that are no text, and
    # UTF-16 read the wrong way round is letters beyond Latin.
    legible = lambda fs: {f for f in fs if all(c != "\0" and c < "\u0250" for c in f)}
    assert legible(got) == legible(want)


def test_a_null_text_has_no_forms(found):
    assert found["null"]["forms"] is None


def mail(body, head="From: a@portal.example\r\nTo: Some One <x@y.z>\r\n folded\r\nX-MSFBL: q\n\tr\nSubject: s\n"):
    return f"{head}\n{body}"


def scrubbed(spark, rows):
    df = spark.createDataFrame(rows, "path string, content string, address string, needles array<string>")
    return {r["path"]: (r["content"], r["leaks"]) for r in scrub.scrubbed(df).collect()}


def test_addresses_in_four_encodings_leave_nothing(spark):
    bodies = {"plain": f"to {SECRET} and VISITOR.77@Planted.Example", "percent": f"?e={PCT}&x", "base64": f"id={b64(SECRET)};", "printable": f"e {QP} x", "cut": f"to {SECRET[:9]}=\r\n{SECRET[9:]}"}
    got = scrubbed(spark, [(k, mail(b), SECRET, []) for k, b in bodies.items()])
    for content, leaks in got.values():
        assert leaks == [] and not any(SECRET in f.lower() or "visitor.77" in f.lower() for f in closure(content))
        assert "Some One" not in content and "folded" not in content and "X-MSFBL" not in content and "Subject: s" in content and "alertes@example.invalid" in content


def test_what_masking_does_not_know_fails_the_row_alone(spark):
    got = scrubbed(spark, [("deep", mail(f"<{b64(PCT)}>"), SECRET, []), ("name", mail("hello &#74;ean &#78;eedle"), None, ["Jean Needle", " "]), ("fine", mail("hello"), SECRET, None), ("null", None, SECRET, [])])
    assert got["deep"] == (None, [SECRET, "visitor.77"]) and got["name"] == (None, ["Jean Needle"])
    assert got["fine"][1] == [] and "hello" in got["fine"][0] and got["null"] == (None, [])


def test_tokens_are_numbered_and_keep_their_shape(spark):
    body = f"qs=abc1 qs=zz trk=9&x {'f' * 8}{'a' * 18} {'F' * 8}{'A' * 18} 01234567-89ab-cdef-0123-456789abcdef eyJhbGciOi.eyJhbGciOi.abcdefgh Jean NEEDLE"
    content, leaks = scrubbed(spark, [("m", mail(body), SECRET, ["jean needle"])])["m"]
    assert leaks == []
    assert content.endswith(f"qs=FIXTURE001 qs=FIXTURE002 trk=FIXTURE001&x f0f0f0f01{'0' * 17} f0f0f0f01{'0' * 17} ffffffff-0000-4000-8000-000000000001 SIGNED.FIXTURE001 abonne")


def test_many_tokens_are_masked_in_one_walk(spark):
    import time

    body = "\n".join(f"qs=token{i} {i:024x} {i % 7:024X}" for i in range(4000))
    scrubbed(spark, [("first", mail("qs=a"), SECRET, [])])
    began = time.time()
    content, leaks = scrubbed(spark, [("m", mail(body), SECRET, [])])["m"]
    assert time.time() - began < 15  # each token alone walked through the whole text before
    assert leaks == [] and "qs=FIXTURE001 f0f0f0f01000" in content and "qs=FIXTURE400 f0f0f0f04000" in content and "token" not in content
