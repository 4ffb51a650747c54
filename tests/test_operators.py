"""Operators on literal rows: unknown values, order, late data, feeds that broke."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import prose, text
from sluice.operators import drains, health, history, jobs, judge, match
from sluice.sources import mail, mapping, pages

CARS = "key long, price double, age double, mileage double, gearbox string, fuel string, body string, make string, postcode string, text string, hail boolean"
CRITERIA = judge.VehicleCriteria(30_000, 5, 80_000, {"price": 10, "age": 15, "mileage": 10, "gearbox": 0, "fuel": 15, "body": 25, "brand": 25}, ["75"], ["suv"], ["ds"], ["toyota", "mercedes"], [r"\bepave\b"], 30)


def test_unknown_is_neither_zero_nor_a_reason(spark):
    rows = [
        (1, None, None, None, None, None, None, None, None, None, None),
        (2, 31_000.0, 1.0, 1.0, None, "essence", "SUV", "Toyota", "75001", "", False),
        (3, 15_000.0, 5.0, 80_000.0, None, "hybride", "4x4 - SUV", "Mercedes-Benz", None, "", False),
        (4, 15_000.0, 7.5, 120_000.0, None, "gpl", "berline", "DS Automobiles", "13001", "", False),
        (5, 15_000.0, 1.0, 1.0, None, "diesel", "suv", "dsx", "75001", "Une épave", True),
        (6, 0.0, 1.0, 1.0, None, "essence", "suv", "toyota", "75001", "", True),
    ]
    got = {r["key"]: r for r in judge.vehicle_verdict(spark.createDataFrame(rows, CARS), CRITERIA).collect()}
    assert got[1]["score"] == 0 and got[1]["disqualifier"] is None and got[1]["outcome"] == "MATCH"
    assert got[2]["disqualifier"] == "price" and got[2]["score"] is None
    assert got[3]["score"] == 95 and got[3]["high_priority"]
    assert got[4]["disqualifier"] == "location"
    assert got[5]["disqualifier"].startswith("pattern:")
    assert got[6]["score"] == 70
    with pytest.raises(ValueError):
        judge.VehicleCriteria(1, 1, 1, {}, brand_avoid=["a"], brand_favour=["a"])


def test_rent_reasons(spark):
    rows = [(1, None, 900.0, 100.0, 40.0, 3), (2, None, 1600.0, None, 40.0, 3), (3, None, None, None, None, None), (4, 300.0, None, None, 90.0, 3), (5, 800.0, None, None, 40.0, 1)]
    df = spark.createDataFrame(rows, "id long, rent_cc double, rent_hc double, charges double, surface double, rooms int")
    got = {r["id"]: (r["outcome"], r["disqualifier"]) for r in judge.rent_verdict(df, judge.RentCriteria(1500, 30, 2, 8)).collect()}
    assert got == {1: ("MATCH", None), 2: ("REJECT", "rent_hc"), 3: ("MATCH", None), 4: ("DIGEST", None), 5: ("REJECT", "rooms")}


RUNS = "source string, id long, at long, ok boolean, items int, feed_at long"
NOW = 100 * 86_400


def ladder(spark, rows, days=None):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], RUNS)
    return health.verdicts(df, NOW, days).first()["status"]


def test_every_rung_of_the_ladder(spark):
    day, hour = 86_400, 3_600
    ok = lambda ago, n=10, feed=None: (NOW - ago, True, n, feed)
    bad = lambda ago: (NOW - ago, False, 0, None)
    assert ladder(spark, [ok(hour)]) == "OK"
    assert ladder(spark, [ok(5 * hour), bad(4 * hour), bad(3 * hour), bad(hour)]) == "BROKEN"
    assert ladder(spark, [ok(5 * hour), bad(hour)]) == "OK"
    assert ladder(spark, [bad(hour)]) == "BROKEN"
    assert ladder(spark, [ok(5 * hour), ok(3 * hour, 0), ok(2 * hour, 0), ok(hour, 0)]) == "BROKEN"
    assert ladder(spark, [ok(30 * day, 5), ok(3 * hour, 0), ok(2 * hour, 0), ok(hour, 0)]) == "BROKEN"
    assert ladder(spark, [ok(9 * day), ok(8 * day)]) == "STALE"
    assert ladder(spark, [ok(-hour)]) == "STALE"
    assert ladder(spark, [ok(9 * day, 0), ok(3 * day, 0), ok(hour, 0)]) == "NEVER_PRODUCED"
    assert ladder(spark, [ok(4 * hour), bad(3 * hour), ok(2 * hour), bad(90 * 60), ok(hour)]) == "WARN_FLAKY"
    many = [ok(6 * day + i) for i in range(60, 0, -1)]
    short = [bad(20 * hour - i * hour) if i % 4 == 0 else ok(20 * hour - i * hour) for i in range(20)]
    assert ladder(spark, many + short) == "WARN_FLAKY"
    assert ladder(spark, [ok(hour, 10, NOW - 9 * day)], 7) == "FEED_SILENT"
    assert ladder(spark, [ok(hour, 10, NOW + 9 * day)], 7) == "FEED_SILENT"
    assert ladder(spark, [ok(hour, 10, NOW - day)], 7) == "OK"
    assert ladder(spark, [ok(3 * hour), ok(2 * hour), ok(hour, 1)]) == "WARN_DROP"


def test_fold_equals_one_arrival_after_the_other(spark):
    import datetime as dt
    import random

    import pandas as pd

    draw = random.Random(1)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randint(0, 9)), s, draw.choice([None, 1.0, 2.0]), draw.choice([None, "a", "b"])) for s, k in enumerate(draw.choices(range(30), k=400))]
    df = spark.createDataFrame(rows, "key long, ts timestamp, seq long, price double, title string")
    for late in ("fill", "ignore"):
        want = {}
        for k in range(30):
            mine = pd.DataFrame([r for r in rows if r[0] == k], columns=["key", "ts", "seq", "price", "title"]).astype({"price": "float64"})
            want[k] = history.fold_arrivals(mine, None, late)
        for r in history.fold(df, late).collect():
            seen, price, title, n_late = want[r["key"]]
            assert (r["price"], r["title"], r["n_late"]) == (price, title, n_late) and pd.Timestamp(r["seen"]) == seen


def test_clusters_follow_survivors_only(spark):
    rows = [(1, "x", 1000.0, 50.0, 2, None, "a", "f"), (2, "x", 1029.0, 50.0, 2, None, "b", "f"), (3, "x", 1058.0, 50.0, 2, None, "a", "f"), (4, None, 1000.0, 50.0, 2, None, "b", "f"), (5, "x", None, 50.0, None, None, "b", "f"), (6, "x", 1000.0, 50.0, 2, None, "b", "g")]
    df = spark.createDataFrame(rows, "id long, commune string, rent double, surface double, rooms int, floor int, source string, family string")
    assert {r["id"]: r["survivor"] for r in match.greedy_clusters(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert {(r["a"], r["b"]) for r in match.pairs(df, "duplicate").collect()} == {(1, 2), (2, 3)}
    assert {(r["a"], r["b"]) for r in match.pairs(df, "twin").collect()} == {(1, 6)}
    assert {r["node"]: r["label"] for r in match.components(match.pairs(df, "duplicate")).collect()} == {1: 1, 2: 1, 3: 1}


def test_numbers_and_keys(spark):
    cases = {"1 540,00 €": 1540.0, "1.234": 1234.0, "12,5": 12.5, "91,5 m²": 91.5, "1 234,56": 1234.56, "1,234.5": 1234.5, "rien": None, "": None, "-3": -3.0}
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.number(F.col("t")).alias("n")).collect()}
    assert got == cases
    row = spark.createDataFrame([("Œuvre d’ÉTÉ  à\nSaint-Ouen", "HTTP://Ex.COM/A?b#c", "2024-01-01T00:00:00.5-00:00", "n/a", "x")], "a string, b string, c string, d string, e string")
    r = row.select(text.fold(F.col("a")).alias("f"), text.commune_key(F.col("a")).alias("k"), text.normalise_url(F.col("b")).alias("u"), text.iso_epoch(F.col("c")).alias("t"), text.first_present(F.col("d"), F.col("e")).alias("p"), history.dedup_key(F.lit("s"), F.lit("a b/~*"), F.lit(""), F.lit("")).alias("i")).first()
    assert r["f"] == "oeuvre d'ete a\nsaint-ouen" and r["k"] == "oeuvre d ete a saint ouen"
    assert r["u"] == "http://ex.com/A?b" and r["t"] == 1704067200 and r["p"] == "x" and r["i"] == "s:id:a%20b%2F~%2A"


@pytest.mark.parametrize(
    ("words", "want"),
    [("chauffage individuel electrique", ("individuel", "electrique")), ("sans chauffage. chauffage collectif au gaz", ("collectif", "gaz")), ("rien", (None, None)), ("chauffage", (None, None))],
)
def test_heating(words, want):
    assert prose.heating(words) == want


def test_prose_readers():
    assert prose.lift("immeuble avec ascenseur") is True and prose.lift("sans ascenseur") is False and prose.lift("ascenseur : non") is False and prose.lift("calme") is None
    assert prose.floor("au 3eme etage") == 3 and prose.floor("rez-de-chaussee") == 0 and prose.floor("deuxieme etage") == 2 and prose.floor("maison") is None
    assert prose.amenities("balcon, cave et parking. en sus la terrasse") == ["terrasse", "balcon", "cave", "parking"]
    assert prose.amenities("stationnement attribue. 3, les jardins du lac") == ["parking inclus"]
    assert prose.hail("vehicule grele") and not prose.hail("non grele") and not prose.hail("sans grele") and not prose.hail("aucune trace de grele")


def values(spark, rows, schema, *columns):
    """What the columns make of each row."""
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *columns).orderBy("i").drop("i").collect()]


def test_mentions(spark):
    balcony, freelance = r"\bbalcon\b", r"\bfreelances?\b"
    cases = {
        "pas de vis a vis mais un grand et beau balcon": True, "pas de grand balcon": False, "sans cave. balcon": True, "pas de balcon\nun balcon": True,
        "pas de balcon, pas de balcon": False, "balcon exclu, ni cave": False, "balcons": False, "": False, None: False, f"sans {'x' * 37} balcon": True,
    }
    assert values(spark, [(t,) for t in cases], "t string", prose.mentions(F.col("t"), balcony)) == [(v,) for v in cases.values()]
    assert values(spark, [("freelance non accepte",), ("freelances s'abstenir",), ("freelance",)], "t string", prose.mentions(F.col("t"), freelance)) == [(False,), (False,), (True,)]
    found = values(spark, [("pas de balcon. cave",), ("rien",), (None,)], "t string", prose.hits_of(F.col("t"), {"balcon": balcony, "cave": r"\bcave\b"}))
    assert found == [(["cave"],), ([],), ([],)]


def test_occurrences_and_last_cue(spark):
    got = values(spark, [("ab12cd345 6",), ("none",), ("",)], "t string", prose.occurrences(F.col("t"), r"\d+", 3, 2))
    assert [[tuple(o) for o in r[0]] for r in got] == [[("ab", "12", "cd"), ("2cd", "345", " 6"), ("45 ", "6", "")], [], []]
    cues = {"pay": r"\bsalaire\b", "other": r"\bprimes?\b"}
    assert values(spark, [("salaire, prime",), ("prime ou salaire",), ("rien",)], "t string", prose.last_of(F.col("t"), cues)) == [("other",), ("pay",), (None,)]


#: What a text states as (kind, basis, period, low, high).
PAY = {
    "45 000 € - 55 000 € brut annuel": [("salary", "gross", "year", 45_000, 55_000)],
    "Rémunération : 3 500 € brut par mois": [("salary", "gross", "month", 3_500, 3_500)],
    "Salaire : 55-65k€": [("salary", "gross", "year", 55_000, 65_000)],
    "1.150 EUR par mois": [("salary", "gross", "month", 1_150, 1_150)],
    "entre 62,5 k€ et 70 k€ par an": [("salary", "gross", "year", 62_500, 70_000)],
    "TJM : 550 € HT": [("tjm", "ht", "day", 550, 550)],
    "Freelance 500-600 €/jour": [("tjm", "ht", "day", 500, 600)],
    "TJM 600 € TTC": [("tjm", "ht", "day", 500, 500)],
    "2 800 € net par mois": [("salary", "net", "month", 2_800, 2_800)],
    "Package de 70 k€ par an": [("salary", "package", "year", 70_000, 70_000)],
    "package 75k€": [("salary", "package", "year", 75_000, 75_000)],
    "Salaire : 60-70 k€ par an, bonus de 20 k€ par an": [("salary", "gross", "year", 60_000, 70_000)],
    "CDI 60-70 k€ par an ou freelance 550 €/jour": [("salary", "gross", "year", 60_000, 70_000), ("tjm", "ht", "day", 550, 550)],
    "ref 850\n1 450 € par mois": [("salary", "gross", "month", 1_450, 1_450)],
    "variable jusqu'à 10 k€. salaire fixe entre 60 et 70 k€": [("salary", "gross", "year", 60_000, 70_000)],
    "Entre 44 k € et 70 k € par an. Salaire entre 44 k € et 70 k € par an": [("salary", "gross", "year", 44_000, 70_000)],
    "salaire brut ou net 40 k€": [("salary", "net", "year", 40_000, 40_000)],
    "25 €/h": [], "TJM : 125 €/h": [], "BSPCE 20 k€": [], "variable jusqu'à 10 k€ par an": [], "prime de 1 500 € par an": [],
    "Salaire selon profil, primes jusqu'à 20 000 € par an": [], "levée de 15 M€": [], "55k utilisateurs": [], "3-5 ans d’expérience": [],
    "Navigo remboursé à 50 %": [], "Salaire 60000": [], "budget de 45 000 €": [], "5 € par an": [], "poste 45\n800 € par an": [], None: [], "": [],
}


def test_pay(spark):
    from sluice.functions.pay import pay

    got = values(spark, [(t,) for t in PAY], "t string", pay(text.fold(F.col("t"))))
    assert [[tuple(line) for line in r[0]] for r in got] == list(PAY.values())


def test_jobs(spark):
    from sluice.operators import jobs

    rows = [("stage developpeur", "nous accueillons des alternants et des stages, pas de cdd", None), ("", "portage ou freelance", ["Contractuel", None, " ", "CDI"])]
    assert values(spark, rows, "t string, d string, stated array<string>", jobs.contracts(F.col("t"), F.col("d"), F.col("stated"))) == [(["stage"],), (["cdi", "contractuel", "freelance", "portage"],)]
    modes = [
        ("dev", "3 jours sur site", "hybrid", "hybrid", 2.0), ("dev remote", "sur site uniquement", None, None, None), ("dev", "teletravail : 5 jours", None, "remote", 5.0),
        ("dev", "2 jours de teletravail par mois", None, None, None), ("dev", "remote teams", None, None, None), ("dev", "full remote, hybride, 3 jours en teletravail", None, "hybrid", 3.0),
        ("dev", "full remote ou hybride", None, None, None), ("dev", "cinq jours au bureau", None, "onsite", 0.0), ("dev", "hybride", None, "hybrid", None), ("dev", "deux jours par semaine de remote", "onsite", "onsite", 0.0),
        ("dev", "5 jours sur site", "hybrid", "hybrid", None), ("dev", "pas de full remote", None, None, None),
    ]
    whole = F.concat_ws("\n", "t", "d")
    found = values(spark, [m[:3] for m in modes], "t string, d string, m string", jobs.work_mode(F.col("t"), whole, F.col("m"), jobs.remote_days(whole)))
    assert [tuple(r[0]) for r in found] == [m[3:] for m in modes]
    with pytest.raises(ValueError):
        jobs.JobCriteria({"stack": 100}, 1, 2, 1, 2)


def test_criteria_are_checked():
    assert judge.RentCriteria.of({"max_rent": 1.0, "min_surface": 1.0, "min_rooms": 1, "min_price_m2": 1.0, "prefixes": ["78"]}).prefixes == ("78",)
    for wrong in ({"prefixes": ["78"], "colour": 1}, {}, {"communes": ["a"], "ranks": {"b": 1}}, {"prefixes": ["7"], "title_excludes": ["("]}):
        with pytest.raises((ValueError, judge.re.error)):
            judge.RentCriteria.of({"max_rent": 1.0, "min_surface": 1.0, "min_rooms": 1, "min_price_m2": 1.0} | wrong)


def test_inflected_phrases(spark):
    cases = [("logement social", "des logements sociaux", False, True), ("plai", "p.l-a i", True, True), ("plai", "plaisir", True, False), ("p.l.u.s", "plus", True, False), ("p.l.u.s", "p.l.u.s", True, True), ("lli", "llis", False, False), ("loyer libre", "loyer-libre", True, True), ("loyer libre", "loyer-libre", False, False)]
    for phrase, said, apart, want in cases:
        row = spark.createDataFrame([(said,)], "t string").select(F.col("t").rlike(text.inflected(phrase, apart)).alias("hit")).first()
        assert row["hit"] == want, (phrase, said)


def test_run_log_masks_secrets(spark, tmp_path):
    from sluice.operators import store

    for error in ("token=abcdef12345", None):
        store.append_runs(spark.createDataFrame([("s", error)], "source string, error string"), str(tmp_path / "log"))
    assert sorted(str(r["error"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["None", "token=[secret]"]


def test_last_facts_and_titles(spark):
    r = spark.createDataFrame([("https://h/a\n\n Clio 5 \nprix 100\nprix 200",)], "t string").select(mail.last_match(F.col("t"), "prix ([0-9]+)").alias("p"), mail.last_match(F.col("t"), "km").alias("k"), mail.title_line(F.col("t")).alias("l")).first()
    assert (r["p"], r["k"], r["l"]) == ("200", None, "Clio 5")


def test_pages(spark):
    html = """<ul><li class="card big" data-ref="7"><a href="/x">A &amp; B</a></li><li class="other">no</li></ul>
      <script type="application/ld+json">[{"@type": "Org"}, {"@type": "Vehicle", "name": "N"}]</script><script id="state">{"k": [1]}</script>"""
    df = spark.createDataFrame([("u", html), ("v", "<p>none</p>")], "url string, html string")
    cards = pages.cards(df, "li", "card")
    row = cards.collect()
    assert len(row) == 1 and row[0]["fields"]["data.ref"] == "7" and row[0]["fields"]["_text"] == "A & B" and row[0]["fields"]["href"] == "/x"
    assert [r["url"] for r in pages.scan_errors(df, cards).collect()] == ["v"]
    assert "N" in pages.json_ld(df, "Vehicle").first()["node"]
    assert [r["j"] for r in df.select(pages.embedded_json(F.col("html"), 'id="state"').alias("j")).collect()] == ['{"k": [1]}', None]
    xml = spark.createDataFrame([("<urlset><url><loc>https://h/lot-12</loc></url><url><loc>https://h/about</loc></url></urlset>",)], "xml string")
    assert [tuple(r) for r in pages.sitemap(xml, r"/lot-(\d+)$").collect()] == [("12", "https://h/lot-12")]
    with pytest.raises(Exception, match="without items"):
        pages.sitemap(xml, "/car-").collect()
    rules = spark.createDataFrame([("h", False, "/a"), ("h", True, "/a/b"), ("h", False, "/*.php$"), ("h", True, "/*.php$")], "host string, allow boolean, pattern string")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/c"), ("h", "/z.php"), ("h", "/z.phpx"), ("g", "/a")], "host string, path string")
    assert {r["path"] + r["host"]: r["allowed"] for r in pages.robots_allowed(paths, rules).collect()} == {"/a/xh": False, "/a/b/ch": True, "/z.phph": True, "/z.phpxh": True, "/ag": True}


def test_mails(spark, tmp_path):
    raw = b"From: Alerts <alerts@portal.example>\r\nSubject: =?utf-8?q?Deux_annonces_=C3=A9t=C3=A9?=\r\nDate: Mon, 01 Jan 2024 10:00:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=latin-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>Flat caf=E9 <a href=3D\"https://portal.example/ad/5\">go</a></p><a href=3D'https://portal.example/unsubscribe'>x</a>\r\n"
    (tmp_path / "a.eml").write_bytes(raw)
    (tmp_path / "b.eml").write_bytes(b"\x00\xff")
    mails = mail.messages(mail.read_folder(spark, str(tmp_path)))
    row = mail.from_sender(mails, "ALERTS@portal", "été").first()
    assert "café" in row["body"] and row["sent"] == 1704099600
    assert mails.where("sender like '%portal%'").select(mail.listing_links(F.col("links"), "portal.example").alias("l")).first()["l"] == ["https://portal.example/ad/5"]
    assert mails.count() == 2


def test_mapping(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"results": {"items": [{"id": 1, "city": "Paris", "rent": {"total": "1 540,00 €"}, "surface": "91,5", "url": "/a#x"}, {"id": "b", "address": {"city": "Lyon"}, "price": 15, "rooms": 20}]}}')
    fields = {"ref": ["id"], "title": ["title"], "url": ["url"], "commune": ["city", "address.city"], "rent": ["rent.total", "price"], "surface": ["surface"], "rooms": ["rooms"]}
    rows = mapping.listings(mapping.read_items(spark, str(tmp_path), "results.items"), fields, "https://h.example/", True)
    a, b = sorted(rows.collect(), key=lambda r: r["ref"])
    assert (a["rent_cc"], a["surface"], a["url"], a["commune"]) == (1540.0, 91.5, "https://h.example/a", "Paris")
    assert (b["rent_cc"], b["rooms"], b["commune"]) == (None, None, "Lyon")
    kept = mapping.snapshot(rows)
    back = mapping.restore(kept, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))
    assert sorted(r["ref"] for r in back.where("readable").collect()) == ["1", "b"]
    assert mapping.fingerprint(fields) != mapping.fingerprint({**fields, "rooms": []})
    with pytest.raises(Exception, match="without ref"):
        mapping.listings(spark.createDataFrame([("{}",)], "item string"), fields, "h", True).collect()
    cards = spark.createDataFrame([("1", 1), ("2", 0), ("3", 0), ("4", 0)], "ref string, priority int")
    cache = spark.createDataFrame([("2", "fp", 0, 0), ("3", None, 3, 0), ("4", None, 1, 990)], "ref string, map_fingerprint string, failures int, last_attempt long")
    assert [r["ref"] for r in mapping.to_hydrate(cards, cache, "fp", 1000, 5).collect()] == ["1"]


def test_queues(spark):
    df = spark.createDataFrame([("a", True, False), ("a", False, False), ("b", True, True), ("c", False, False)], "key string, reaches boolean, failed boolean")
    assert {r["key"]: r["delivered"] for r in drains.delivered(df).collect()} == {"a": True, "b": False, "c": False}
    r = spark.createDataFrame([("T", 12_345.0, 80)], "t string, p double, s int").select(drains.headline(F.col("t"), F.col("p"), F.col("s")).alias("h")).first()
    assert r["h"] == "T · 12 345 € · score 80"


def test_late_prices_are_compared_on_both_sides(spark):
    import datetime as dt
    import random

    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", at(5), 1, 900.0), ("a", at(9), 2, 800.0), ("a", at(7), 3, 800.0), ("a", at(6), 4, 900.0), ("a", at(7), 5, 850.0), ("a", at(1), 6, 900.0), ("a", at(8), 7, None), ("b", at(2), 8, 1.0), ("b", at(2), 9, 1.0), ("b", at(2), 10, 2.0), (None, at(1), 11, 1.0)]
    schema = "key string, ts timestamp, seq long, price double"
    assert sorted((r["key"], r["seq"]) for r in history.recorded(spark.createDataFrame(rows, schema)).collect()) == [("a", 1), ("a", 2), ("a", 5), ("b", 8), ("b", 10)]
    draw, rows = random.Random(8), []
    for seq in range(400):
        rows.append((draw.choice("xyz"), at(draw.randint(0, 23)), seq, float(draw.randint(1, 3))))
    written = []
    for key, ts, seq, price in rows:
        before = max(((t, s, p) for k, t, s, p in written if k == key and t <= ts), default=None)
        after = min(((t, s, p) for k, t, s, p in written if k == key and t > ts), default=None)
        if (before is None or before[2] != price) and (after is None or after[2] != price):
            written.append((key, ts, seq, price))
    got = history.recorded(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["seq"] for r in got) == sorted(w[2] for w in written)
    assert history.recorded(spark.createDataFrame([], schema)).count() == 0


def test_places_over_many_partitions(spark):
    from sluice.operators import rank

    df = spark.range(5000).selectExpr("id", "pmod(xxhash64(id), 97) v").repartition(7)
    got = rank.place(df, [F.desc("v"), F.col("id")], "place").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [r["id"] for r in sorted(got, key=lambda r: (-r["v"], r["id"]))]
    assert sorted(r["place"] for r in got) == list(range(1, 5001)) and rank.place(df.where("false"), [F.col("id")], "p").count() == 0


def test_answers_for_robots(spark):
    body = "User-agent: *\r\nDisallow: /a\nAllow: /a/b # yes\nDisallow: /*.pdf$\nno colon\nUser-Agent: SCO\nDisallow: /x?y\nDisallow:\n"
    answers = [("rules", 200, "text/plain", body), ("gone", 410, None, None), ("none", 404, "text/html", "<html>"), ("html", 200, "text/html; q", "User-agent: *"), ("page", 200, None, "\n <!doctype"), ("json", 200, "text/plain", "{}"), ("error", 500, "text/plain", body), ("lost", None, None, None), ("empty", 204, "text/plain", "")]
    df = spark.createDataFrame(answers, "host string, status int, content_type string, body string")
    readable = {r["host"]: r["readable"] for r in pages.robots_rules(df, "scout").collect()}
    assert readable == {"rules": True, "gone": True, "none": True, "html": False, "page": False, "json": False, "error": False, "lost": False, "empty": True}
    cases = [("rules", "/a"), ("rules", "/a/b"), ("rules", "/d.pdf"), ("rules", "/d.pdf?x"), ("rules", "/x?y=1"), ("rules", ""), ("none", "/a"), ("error", "/z"), ("absent", "/")]
    paths = spark.createDataFrame(cases, "host string, path string")
    verdict = lambda agent: {(r["host"], r["path"]): r["allowed"] for r in pages.robots_verdicts(paths, df, agent).collect()}
    assert [verdict("other")[c] for c in cases] == [False, True, False, True, True, True, True, False, False]
    assert [verdict("scout")[c] for c in cases] == [True, True, True, True, False, True, True, False, False]


def test_rollups_duplicates_and_rebuilt_rows(spark):
    from sluice.operators import classify, store

    rows = [("2024-06-01 05:00:00", "2024-06-01 06:00:00"), ("2024-06-01 06:00:00", "2024-06-02 06:00:00"), ("2024-12-01 06:30:00", "2024-12-01 07:00:00"), ("2024-10-26 07:00:00", "2024-10-27 07:00:00")]
    df = spark.createDataFrame(rows, "now string, want string")
    assert df.where(classify.next_rollup(F.to_timestamp("now"), 8, "Europe/Paris") != F.to_timestamp("want")).count() == 0
    listings = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id int, source string")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, survivor int")
    assert sorted(tuple(r) for r in store.duplicate_counts(listings, clusters, "source").collect()) == [("a", 3, 2), ("b", 1, 0)]
    kept = spark.createDataFrame([(1, '{"rent": 9.5, "title": "t"}', 1.0, "u"), (2, "{oops", 2.0, "v"), (3, None, None, "w"), (4, "", 4.0, None)], "id int, snapshot string, rent double, url string")
    got = [tuple(r) for r in mapping.restore_or_rebuild(kept, "rent double, title string", {"rent": "rent"}).orderBy("id").select("id", "url", "degraded", "rent", "title").collect()]
    assert got == [(1, "u", False, 9.5, "t"), (2, "v", True, 2.0, None), (3, "w", True, None, None), (4, None, True, 4.0, None)]


def records_dealt_out(spark):
    """Rows that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


FLAT = "id long, commune string, rent double, surface double, rooms int, floor int, source string, family string"


def some_flats(spark, gaps):
    import random

    draw = random.Random(7)
    gap = lambda share, value: None if draw.random() < share else value
    near = lambda base: base * (1 + draw.choice([-0.06, -0.03, -0.0299, 0.0, 0.03, 0.031]))
    rows = [(i, draw.choice(["x", "x", "y", "", None]), gap(gaps, near(draw.choice([0.0, 300.0, 1000.0, 1000.0]))), gap(gaps, near(draw.choice([-1.0, 0.0, 20.0, 66.0, 68.0]))), gap(gaps, draw.choice([1, 2])), gap(0.6, draw.choice([0, 1])), draw.choice("ab"), draw.choice("fg")) for i in range(400)]
    return rows, spark.createDataFrame(rows, FLAT).repartition(3)


def is_one_flat(p, q):
    close = lambda a, b, absolute, ratio: a is None or b is None or abs(a - b) <= absolute or abs(a - b) / max(abs(a), abs(b)) <= ratio
    both = sum(p[i] is not None and q[i] is not None for i in (2, 3, 4))
    alike = all(p[i] is None or q[i] is None or p[i] == q[i] for i in (4, 5))
    return bool(p[1]) and p[1] == q[1] and both >= 2 and alike and close(p[2], q[2], 30, 0.03) and close(p[3], q[3], 2.0, 0.03)


def test_pairs_with_and_without_gaps(spark):
    for gaps in (0.0, 0.01, 0.4):
        rows, df = some_flats(spark, gaps)
        want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and is_one_flat(p, q))
        assert len(want) > 100 and sorted((r["a"], r["b"]) for r in match.pairs(df).collect()) == want
        marked = {p[0] for p in rows if p[6] == "a"}
        seen = {}
        for p, q in [(a, b) for p, q in want for a, b in ((p, q), (q, p)) if b in marked]:
            seen[p] = min(q, seen.get(p, q))
        assert {r["id"]: r["witness"] for r in match.excluded_witness(df, df.where("source = 'a'")).collect()} == seen


#: So many times the rows of flats may be dealt out by each query.
DEALT = {"twin_pairs": 2, "duplicate_pairs": 2, "connected_groups": 2, "twin_fixed_point": 4, "collapsed_twins": 4, "twin_suppression": 3, "gate_four_routes": 5, "greedy_cluster": 3}


@pytest.mark.parametrize("name", sorted(DEALT))
def test_flats_are_dealt_out_a_few_times(spark, sf, name):
    from sluice.plans import catalogue
    from sluice.plans.views import flats

    most, before = DEALT[name] * flats(spark, sf).count(), records_dealt_out(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert records_dealt_out(spark) - before < most


def some_offers(spark):
    kinds = [("Lead developer Java", "CDI, 2 jours de teletravail. Salaire 45-55 k€ brut par an.", None, ["CDD"], None), (None, None, None, None, None), ("", None, None, [], "onsite"), ("Lead developer Java", "CDI, 2 jours de teletravail. Salaire 45-55 k€ brut par an.", None, None, None)]
    rows = [(i, *kinds[i % 4], 52_000 if i % 3 else None, None, None, None, [None, "Lyon"][i % 2], None, i % 5 == 0) for i in range(60)]
    return spark.createDataFrame(rows, "key long, title string, description string, pay_text string, stated array<string>, stated_mode string, salary_low int, salary_high int, tjm_low int, tjm_high int, location string, published long, unreadable boolean").repartition(3)


def test_offers_that_say_the_same_are_read_once(spark):
    offers = some_offers(spark)
    read = jobs._read_once(offers, jobs.SAID, lambda texts: texts.withColumn("reading", F.monotonically_increasing_id())).collect()
    assert sorted(r["key"] for r in read) == list(range(60)) and len({r["reading"] for r in read}) == 4
    assert {(r["key"] % 4, r["reading"]) for r in read} == {(i, next(r["reading"] for r in read if r["key"] == i)) for i in range(4)}
    stated = {r["key"]: r for r in jobs.facts(offers).collect()}
    assert len(stated) == 60 and all((stated[i]["contracts"], stated[i]["level"], stated[i]["days"], len(stated[i]["pay"])) == ((["cdd", "cdi"], "lead", 2.0, 2) if i % 3 else (["cdd", "cdi"], "lead", 2.0, 1)) for i in range(0, 60, 4))


def test_terms_found_with_the_facts_judge_alike(spark):
    from sluice.plans.job_queries import CRITERIA as C

    offers = some_offers(spark)
    columns = ["key", "disqualifier", "red", "score", "outcome"]
    once = jobs.judge(jobs.facts(offers, C), C, F.lit(0)).select(columns)
    assert sorted(once.collect()) == sorted(jobs.judge(jobs.facts(offers), C, F.lit(0)).select(columns).collect()) and once.count() == 60
