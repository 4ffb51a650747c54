import textwrap

from sluice.llm import licences


TEXTS = licences.texts()


def test_variants_of_a_licence_are_found(spark):
    mit = TEXTS["MIT"]
    rows = [
        (1, mit.replace("<year> <copyright holders>", "2021 Some One")),
        (2, mit.upper().replace("\n", "\r\n  ")),
        (3, "// " + mit.replace("\n\n", "\n//\n// ").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS").replace("Copyright (c)", "© 1999,").replace("sublicense", "sub-license")),
        (4, mit + " and one more condition"),
        (5, mit[:-200]),
        (6, TEXTS["ISC"].replace('"', "“")),
        (7, mit.partition("\n\n")[2].replace("<copyright holders>", "Them\nAll rights reserved.")),
        (8, " ".join(TEXTS["Apache-2.0"].partition(licences.END_OF_TERMS)[0].split())),
        (9, TEXTS["GPL-3.0"].partition(licences.END_OF_TERMS)[0].replace(" program ", " programme ")),
        (10, mit.replace("licence", "license").replace("permission", "wipermission")),
        (11, "\n".join(textwrap.wrap(TEXTS["MPL-2.0"], 50))),
        (12, TEXTS["BSD-3-Clause"].replace("COPYRIGHT HOLDER ", "copyright owner ")),
    ]
    got = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: "ISC", 7: "MIT", 8: "Apache-2.0", 9: "GPL-3.0", 10: None, 11: "MPL-2.0", 12: "BSD-3-Clause"}


def test_spellings_are_whole_words(spark):
    rows = spark.createDataFrame([("Licence licence, licences; biolicence per cents centres",)], "t string")
    assert rows.select(licences.canonical(rows["t"]).alias("t")).first()["t"] == "license license licenses biolicence per cents centres"


def test_known_digests_differ(spark):
    rows = licences.known(spark).collect()
    assert len({r["digest"] for r in rows}) == len(rows) >= len(TEXTS) and {r["licence"] for r in rows} == set(TEXTS)


def test_odd_rows(spark, odd, none):
    rows = licences.scan(odd, licences.known(spark)).collect()
    assert len(rows) == odd.count() and all(r["licence"] is None for r in rows)
    digest = {r["doc_id"]: r["digest"] for r in rows}
    assert digest[1] == digest[2] == digest[7] and digest[3] == digest[4]
    assert licences.scan(none, licences.known(spark)).count() == 0
    twice = licences.known(spark).union(licences.known(spark).selectExpr("'ZZ'", "digest"))
    assert licences.scan(odd, twice).count() == odd.count()
