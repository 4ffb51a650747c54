import pytest
from pyspark.sql import functions as F

from sluice.operators import classify

TEXTS = [
    ("Logement intermédiaire", {}, None, False, ("LLI", 90, "MATCH")),
    ("Appartement HLM", {}, "LLI", False, ("SOCIAL", 90, "REJECT")),
    ("Logement intermédiaire, résidence HLM", {}, None, False, ("UNKNOWN", 0, "DIGEST")),
    ("Rien à signaler", {}, "LLI", False, ("LLI", 50, "MATCH")),
    ("Rien à signaler", {}, "LLI", True, ("UNKNOWN", 50, "DIGEST")),
    ("Rien à signaler", {}, None, False, ("UNKNOWN", 0, "DIGEST")),
    ("Appartement", {"Type de financement": "PLS"}, "LLI", False, ("PLS", 97, "REJECT")),
    ("Logement intermédiaire", {"Financement": "LLI"}, None, False, ("LLI", 99, "MATCH")),
    ("LLI conventionné", {}, None, False, ("LLI", 90, "MATCH")),
    ("Plafond de ressources 25 000 €", {}, None, False, ("SOCIAL", 70, "REJECT")),
    ("Plafond de ressources 45 000 €", {}, "LLI", False, ("LLI", 50, "MATCH")),
    ("Attribution directe, sans commission d'attribution", {}, None, False, ("LLI", 80, "MATCH")),
    ("Passage en commission d'attribution", {}, "LLI", False, ("SOCIAL", 80, "REJECT")),
    ("Loyer maîtrisé", {}, "LLI", False, ("UNKNOWN", 0, "DIGEST")),
    ("Financement PLUS", {}, "LLI", False, ("PLUS", 90, "REJECT")),
    ("Logement\nintermédiaire", {}, None, False, ("UNKNOWN", 0, "DIGEST")),
]


def test_tenure(spark):
    rows = [(i, t, f, d, m, False) for i, (t, f, d, m, _) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, text string, fields map<string,string>, default_tenure string, mixed boolean, detail_read boolean")
    got = {r["id"]: (r["tenure"], r["confidence"], r["outcome"]) for r in classify.tenure(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(TEXTS)}


#: (url, commune, postcode, id, fields, doubts, class) of a listing that is free by its text.
DOUBTED = [
    ("https://h/location/appartement-12", "Avon", "77210", "a-12", {}, [], "LIBRE"),
    ("https://h/logement-social/12", "Avon", None, "12", {}, ["logement-social"], "UNKNOWN"),
    ("https://h/12", "Résidence HLM", "77210", "12", {}, ["hlm"], "UNKNOWN"),
    (None, None, None, "PLAI_77", {}, ["plai"], "UNKNOWN"),
    (None, None, None, None, {"typeHLM": "non"}, ["hlm"], "UNKNOWN"),
    (None, None, None, None, {"note": "financementLogementSocial"}, ["logement social"], "UNKNOWN"),
    (None, None, None, None, {"note": "LELOGEMENTSOCIALICI"}, ["logementsocial"], "UNKNOWN"),
    (None, None, None, None, {"note": "logement&nbsp;social"}, ["logement social"], "UNKNOWN"),
    (None, None, None, None, {"note": "caf&bogus; x"}, ["?"], "UNKNOWN"),
    (None, None, None, None, {"note": "sans commission d'attribution"}, [], "LIBRE"),
    (None, None, None, None, {"note": "PLUS"}, ["plus"], "UNKNOWN"),
    (None, None, None, None, {"note": "surplus 12", "n": "77", "e": "", "z": None}, [], "LIBRE"),
    (None, None, None, None, {"_text": "hlm", "title": "loyer", "description": "hlm"}, ["hlm"], "UNKNOWN"),
    (None, None, None, None, {"financement": "PLUS/LLI"}, [], "PLUS"),
    (None, None, None, None, {"Type de produit": "pls"}, [], "PLS"),
    (None, None, None, None, {"Type de produit": "plus de choix"}, [], "LIBRE"),
]


def test_words_beside_the_text(spark):
    rows = [(i, "Loyer libre", *r[:5], None, False, False) for i, r in enumerate(DOUBTED)]
    schema = "id int, text string, url string, commune string, postcode string, external_id string, fields map<string,string>, default_tenure string, mixed boolean, detail_read boolean"
    got = {r["id"]: (r["doubts"], r["tenure"]) for r in classify.tenure(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: r[5:] for i, r in enumerate(DOUBTED)}


def test_ceilings(spark):
    from sluice.operators import ceilings

    rows = [
        ("A bis", "Paris", 1, 0, "PLAI"), ("A bis", "Paris", 1, 14811, "PLAI"), ("A bis", "Paris", 1, 14812, "PLUS"), ("A bis", "Paris", 1, 26921, "PLS"), ("A bis", "Paris", 1, 44344, "LLI"), ("A bis", "Paris", 1, 44345, None),
        ("B1", "IdF hors Paris", 6, 92900, "PLS"), ("B1", "IdF hors Paris", 9, 100322, "PLS"), ("B1", "IdF hors Paris", 6, 100323, None), ("A", "IdF hors Paris", 3, 62872, "LLI"), ("C", "Paris", 1, 1, None), ("A", "Paris", None, 1, None), ("A", "Paris", 2, None, None),
    ]
    df = spark.createDataFrame(rows, "zone string, place string, household int, income int, want string")
    assert df.count() == ceilings.open_to(df).where("open_class <=> want").count() == len(rows)
    quoted = spark.createDataFrame([("IDF", 36143, "SOCIAL"), ("IDF", 36144, None), ("A", 44343, "SOCIAL"), ("A", 44344, None), ("Z", 1, None)], "zone string, amount int, want string")
    assert quoted.where(~ceilings.quoted_ceiling_class(F.col("amount"), F.col("zone")).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("word", ["hlm", "logement social", "pls", "plai", "anru", "conventionne", "pret locatif social", "caleol"])
@pytest.mark.parametrize("frame", ["Bel appartement {}", "{}, proche métro", "LLI ({})", "Résidence « {} »"])
def test_an_excluded_word_never_matches(word, frame):
    from sluice.functions.text import fold  # noqa: F401

    found = classify.signals(frame.format(word).lower().replace("é", "e"))
    tenures = {t for _, t, _, _ in found}
    assert tenures & set(classify.EXCLUDED) or "UNKNOWN" in tenures


def test_vehicles(spark):
    cases = {"Jamais accidenté": "MATCH", "véhicule accidenté": "REJECT", "Accident : non": "MATCH", "sans carte grise": "REJECT", "non roulant": "REJECT", "aucun gage ni opposition": "MATCH", "Pour pièces": "REJECT", "CT non fourni": "REJECT", "": "MATCH"}
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert [(r["text"]) for r in classify.vehicle(df).where("outcome <> want").collect()] == []


def test_unfit_words_are_taken_back(spark):
    cases = {
        "jamais accidente. tres bon etat. procedure ve": ["procédure VE"], "accidente : non. malgre son age une epave": ["épave"], "0 accident en dix ans puis accidente": ["accidenté"], "": [],
        "sans carte grise. tres vieille voiture accidente": ["sans carte grise", "accidenté"], "accidente ? non, accidente : jamais": [], "aucun choc, epave": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r["u"] for r in df.orderBy("i").select(classify.unfit(F.col("t")).alias("u")).collect()] == list(cases.values())
    rows = spark.createDataFrame([("tr&egrave;s bon &bogus; etat",), (None,)], "text string")
    assert [(r["reasons"], r["outcome"]) for r in classify.vehicle(rows).collect()] == [(["texte illisible"], "REJECT"), ([], "MATCH")]


def test_auctions(spark):
    df = spark.createDataFrame([(5, 1, 9, True), (1, 1, 9, False), (9, 1, 9, False), (None, 1, 9, False)], "c int, n int, r int, want boolean")
    assert df.where(classify.urgent(F.col("c"), F.col("n"), F.col("r")) != F.col("want")).count() == 0
