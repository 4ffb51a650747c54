"""Fields as feeds spell them, made of the given tables in turn; the SQL holds what each
spelling means, written by hand, or a rule of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import coerce, text
from sluice.operators import ceilings, classify, judge, store
from sluice.plans.registry import query, sql_fold, sql_list
from sluice.plans.views import table


def turn(values, key: str):
    """The values one after the other, by a key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_turn(values, key: str) -> str:
    return f"{sql_list(values)}[CAST({key} % {len(values)} AS BIGINT) + 1]"


#: (raw value, whole number, yes or no, floor)
_RAW = (
    ("1 450 €", 1450, None, None), ("1450,60", 1451, None, None), ("oui", None, True, None), ("Sans", None, False, None), ("RDC", None, None, 0),
    ("3 pièces - 4ème étage - 82m²", 3, None, 4), ("au 3? étage d'un immeuble de 4 étages", 3, None, None), ("-1", -1, None, -1), ("1", 1, True, 1), ("rez-de-chaussée", None, None, 0), (" ascenseur ", None, True, None), ("0", 0, False, 0),
)


@query(f"SELECT o_orderkey AS id, {sql_turn([r[1] for r in _RAW], 'o_orderkey')} AS whole, {sql_turn([None if r[2] is None else str(r[2]) for r in _RAW], 'o_orderkey')}::BOOLEAN AS yes, {sql_turn([r[3] for r in _RAW], 'o_orderkey')} AS floor FROM orders")
def coerced_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), turn([r[0] for r in _RAW], "o_orderkey").alias("raw"))
    return o.select("id", coerce.int_of(F.col("raw")).cast("int").alias("whole"), coerce.bool_of(F.col("raw")).alias("yes"), coerce.floor_field(F.col("raw")).alias("floor"))


_BOXED = (('["AVON"]', "AVON"), ('["", "n/a", "Lyon"]', "Lyon"), ('{"name": "AVON"}', None), ("[[1], 2]", "2"), ("[0]", "0"), ("[]", None), ("plain", "plain"), ("[false]", "false"))


@query(f"SELECT o_orderkey AS id, {sql_turn([r[1] for r in _BOXED], 'o_orderkey')} AS value FROM orders")
def boxed_scalars(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), coerce.scalar_of(turn([r[0] for r in _BOXED], "o_orderkey")).alias("value"))


_NESTED = """'{"a":{"b":[' || json_extract_string(props, '$.k') || ',true,null,"x"],"c":{"d":"' || event_type || '"}},"e":false}'"""


@query(f"""SELECT event_id, replace(replace(replace(fullkey, '$.', ''), '[', '.'), ']', '') AS path, trim(CAST(atom AS VARCHAR), '"') AS value
  FROM (SELECT event_id, {_NESTED} AS j FROM events), json_tree(j) WHERE atom IS NOT NULL""")
def flat_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    j = F.concat(F.lit('{"a":{"b":['), F.get_json_object("props", "$.k"), F.lit(',true,null,"x"],"c":{"d":"'), F.col("event_type"), F.lit('"}},"e":false}'))
    return e.select("event_id", F.explode(coerce.flatten(j)).alias("path", "value"))


_FUELS = (("Essence sans plomb", "essence"), ("DIESEL", "diesel"), ("Hybride essence", "hybride"), ("Électrique", "electrique"), ("GPL", "gpl"), ("Hydrogène", "autre"), ("", None), (None, None), ("gazole", "diesel"))
_GEARS = (("Boîte de vitesse automatique", "automatique"), ("BVM6", None), ("bvm", "manuelle"), ("Clio EDC", "automatique"), ("auto manuelle", "manuelle"), ("S-Tronic", "automatique"), (None, None), ("EAT8", "automatique"))
_DATES = (("2015-09", 2015, 9), ("2015", 2015, None), (" 2019-13", 2019, None), ("09/2015", None, None), (None, None, None), ("2024-2", 2024, 2))
_DIGITS = (("136 278 KMT", 136278), ("26 000 km", 26000), ("21 000€", 21000), ("km", None), (None, None))


@query(f"""WITH r AS (SELECT p_partkey AS id, {sql_turn([x[1] for x in _FUELS], 'p_partkey')} AS fuel, {sql_turn([x[1] for x in _GEARS], 'p_partkey')} AS gearbox,
  {sql_turn([x[1] for x in _DIGITS], 'p_partkey')} AS mileage, {sql_turn([x[1] for x in _DATES], 'p_partkey')} AS year, {sql_turn([x[2] for x in _DATES], 'p_partkey')} AS month FROM part)
  SELECT *, greatest(0.0, round(((2024 - year) * 12 + 3 - coalesce(month, 6)) / 12.0, 2)) * CASE WHEN year IS NOT NULL THEN 1 END AS age FROM r""")
def vehicle_facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    when = coerce.registered(turn([x[0] for x in _DATES], "p_partkey"))
    rows = p.select(F.col("p_partkey").alias("id"), coerce.fuel(turn([x[0] for x in _FUELS], "p_partkey")).alias("fuel"), coerce.gearbox(turn([x[0] for x in _GEARS], "p_partkey")).alias("gearbox"), coerce.digits_of(turn([x[0] for x in _DIGITS], "p_partkey")).alias("mileage"), when.alias("w"))
    age = coerce.vehicle_age(F.col("w.year"), F.col("w.month"), 2024, 3)
    return rows.select("id", "fuel", "gearbox", "mileage", F.col("w.year").alias("year"), F.col("w.month").alias("month"), age.alias("age"))


_POSTCODES = ("78600", "95-100", "69001", None, "abc", "786", "75013")
_COMMUNES = ("Maisons-Laffitte", "MAISONS  LAFFITTE", "Le Vésinet", None, "Levesinet")
_REGION = judge.RentCriteria(60_000.0, 10.0, 2, 1000.0, prefixes=("78", "95"))
_LISTED = judge.RentCriteria(60_000.0, 10.0, 2, 1000.0, communes=("maisons laffitte", "le vesinet"), prefixes=("78", "95"))
_PLACES = f"SELECT c_custkey AS id, {sql_turn(_COMMUNES, 'c_custkey')} AS commune, {sql_turn(_POSTCODES, 'c_custkey')} AS postcode, regexp_replace(coalesce({sql_turn(_POSTCODES, 'c_custkey')}, ''), '[^0-9]', '', 'g') AS digits FROM customer"


@query(f"""WITH p AS ({_PLACES}), q AS (SELECT *, digits LIKE '78%' OR digits LIKE '95%' AS near, commune IS NOT NULL OR postcode IS NOT NULL AS known,
  commune IN ('Maisons-Laffitte', 'MAISONS  LAFFITTE', 'Le Vésinet') AS listed FROM p)
  SELECT id, known AND near AS in_region, known AND CASE WHEN commune IS NULL THEN near ELSE listed AND (digits = '' OR near) END AS in_list FROM q""")
def location_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), turn(_COMMUNES, "c_custkey").alias("commune"), turn(_POSTCODES, "c_custkey").alias("postcode"))
    return c.select("id", judge.in_place(F.col("commune"), F.col("postcode"), _REGION).alias("in_region"), judge.in_place(F.col("commune"), F.col("postcode"), _LISTED).alias("in_list"))


_TITLES = ("T3 avec parking", "Parking en sous-sol", "Studio meublé", "Bureau à louer", "Appartement")
_ABOUT = ("Bel immeuble", "En colocation, parking", "Proche gare")
_RENT = judge.RentCriteria(60_000.0, 10.0, 2, 1000.0, prefixes=("78", "95"), title_excludes=("^parking", "^bureau"), text_excludes=(r"\bcolocation\b",))


@query(f"""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 'REJECT' WHEN 'N' THEN 'DIGEST' ELSE 'MATCH' END AS class_outcome, l_orderkey % 5 AS t, l_partkey % 3 AS a,
  {sql_turn(_COMMUNES, 'l_suppkey')} AS commune, {sql_turn(_POSTCODES, 'l_suppkey')} AS postcode, regexp_replace(coalesce({sql_turn(_POSTCODES, 'l_suppkey')}, ''), '[^0-9]', '', 'g') AS digits,
  l_linenumber AS rooms, l_quantity AS surface, l_extendedprice AS rent FROM lineitem),
  d AS (SELECT *, CASE WHEN class_outcome = 'REJECT' THEN 'tenure: PLS' WHEN commune IS NULL AND postcode IS NULL THEN 'no location' WHEN NOT (digits LIKE '78%' OR digits LIKE '95%') THEN 'commune'
    WHEN t = 1 THEN 'kind: ^parking' WHEN t = 3 THEN 'kind: ^bureau' WHEN a = 1 THEN 'kind: \\bcolocation\\b' WHEN rooms < 2 THEN 'rooms' WHEN surface < 10 THEN 'surface' WHEN rent > 60000 THEN 'rent' END AS reject,
    CASE WHEN class_outcome = 'DIGEST' THEN 'class' WHEN rent / surface < 1000 THEN 'price' END AS doubt FROM r)
  SELECT coalesce(reject, doubt, '-') AS reason, CASE WHEN reject IS NOT NULL THEN 'REJECT' WHEN doubt IS NOT NULL THEN 'DIGEST' ELSE 'MATCH' END AS outcome, count(*) AS n FROM d GROUP BY 1, 2""")
def rent_judge(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("double")
    rows = i.select(
        F.when(F.col("l_returnflag") == "R", "REJECT").when(F.col("l_returnflag") == "N", "DIGEST").otherwise("MATCH").alias("class_outcome"),
        F.lit("PLS").alias("tenure"),
        turn(_TITLES, "l_orderkey").alias("title"),
        turn(_ABOUT, "l_partkey").alias("description"),
        turn(_COMMUNES, "l_suppkey").alias("commune"),
        turn(_POSTCODES, "l_suppkey").alias("postcode"),
        F.col("l_extendedprice").alias("rent_cc"),
        none.alias("rent_hc"),
        none.alias("charges"),
        F.col("l_quantity").alias("surface"),
        F.col("l_linenumber").alias("rooms"),
    )
    out = judge.rent_judge(rows, _RENT)
    return out.groupBy(F.coalesce("reason", F.lit("-")).alias("reason"), "outcome").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_quantity * 2 AS INTEGER) AS score, CAST(l_linenumber * 14 AS INTEGER) AS confidence, l_returnflag AS f, l_linestatus AS s FROM lineitem),
  p AS (SELECT *, CASE WHEN f = 'R' THEN 0 WHEN s = 'O' THEN -35 ELSE -20 END AS penalty FROM r)
  SELECT o, n, penalty, score + penalty >= 60 AND confidence >= 80 AS high FROM p""")
def heating_priority(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    penalty = judge.heating_penalty(F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", -20, -15)
    rows = i.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 2).cast("int").alias("score"), (F.col("l_linenumber") * 14).cast("int").alias("sure"), penalty.alias("penalty"))
    return rows.select("o", "n", "penalty", judge.is_high_priority(F.col("score") + F.col("penalty"), F.col("sure"), 60).alias("high"))


_FLOORS = (None, -1, 0, 1, 2, 12)


@query(f"""SELECT c_custkey AS id, {sql_turn(("Yvelines (78)", "Val-d'Oise (95)", None, None, None, None, "Paris (75)"), 'c_custkey')} AS department,
  {sql_turn((None, "sous-sol", "rez-de-chaussée", "1er étage", "2e étage", "12e étage"), 'c_custkey')} AS floor, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, 'x y' AS trimmed FROM customer""")
def labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    floor = F.element_at(F.array(*[F.lit(f).cast("int") for f in _FLOORS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), coerce.department(turn(_POSTCODES, "c_custkey")).alias("department"), coerce.floor_label(floor).alias("floor"), coerce.without_sentinel(F.col("c_mktsegment"), "^BUILD").alias("segment"), text.unicode_trim(F.lit(" ​ x y\t \n")).alias("trimmed"))


@query("""SELECT o_orderkey AS id, 200 + o_orderkey % 3000 AS rent, 20 + o_orderkey % 80 + 0.25 AS surface, 1 + o_orderkey % 7 AS rooms, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(78000 + o_orderkey % 900 AS VARCHAR) END AS postcode FROM orders""")
def card_facts(spark, sf_dir):
    k = F.col("o_orderkey")
    rooms = F.when(k % 2 == 0, F.concat(F.lit("T"), (k % 7 + 1).cast("string"))).otherwise(F.concat((k % 7 + 1).cast("string"), F.lit(" pièces")))
    rent = F.translate(F.format_number(k % 3000 + 200, 0), ",", " ")
    card = F.concat(
        F.lit("https://h.example/90F8-739278F557C5.jpg?qs=zaw7m29jtx#95240\n"), rooms, F.lit(" lumineux, "), (k % 80 + 20).cast("string"), F.lit(",25 m² "),
        F.when(k % 4 != 0, (k % 900 + 78_000).cast("string")).otherwise(F.lit("69001")), F.lit("\nbaissé de 100 €\n"), F.when(k % 3 == 0, F.concat(F.lit("loyer : "), rent, F.lit(" €"))).when(k % 3 == 1, F.concat(rent, F.lit(" €/mois CC"))).otherwise(F.concat(rent, F.lit(" € par mois"))),
    )
    out = table(spark, sf_dir, "orders").select(k.alias("id"), coerce.card_facts(card).alias("f"))
    return out.select("id", "f.rent", "f.surface", "f.rooms", "f.postcode")


_CODES = (("PLUS/PLAI", True), ("A1", False), ("PLS - 2 B", True), ("plus de choix", False), ("LLI", True), ("", False), ("ABCD PLS", False))
_VALUES = (("financementLogementSocial", "logement social"), ("typeHLM", "hlm"), ("hlmx", None), ("LOGEMENT_SOCIAL", "logement social"), ("lelogementsocialici", "logement social"), ("libre", None))


@query(f"SELECT p_partkey AS id, CAST({sql_turn([str(x[1]) for x in _CODES], 'p_partkey')} AS BOOLEAN) AS codes, {sql_turn([x[1] for x in _VALUES], 'p_partkey')} AS phrase FROM part")
def code_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), coerce.code_list(turn([x[0] for x in _CODES], "p_partkey")).alias("codes"), coerce.vocabulary_hit(turn([x[0] for x in _VALUES], "p_partkey"), ["logement social", "hlm"]).alias("phrase"))


_ENTITIES = (("caf&eacute; &amp;amp;amp; th&#233;", "cafe & the"), ("&bogus; x", None), ("A&nbsp;B", "a b"), ("pl­us", "plus"), ("d’été", "d'ete"))


@query(f"SELECT p_partkey AS id, {sql_turn([x[1] for x in _ENTITIES], 'p_partkey')} AS folded FROM part")
def tolerant_fold(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.tolerant_fold(turn([x[0] for x in _ENTITIES], "p_partkey")).alias("folded"))


_PHRASES = ("option", "vi", "le")


@query("SELECT conv_id, turn, " + ", ".join(f"regexp_matches(folded, '(^|[^a-z0-9]){p}(es|e|s|x)?($|[^a-z0-9])') AS {p}" for p in _PHRASES) + f" FROM (SELECT conv_id, turn, {sql_fold('text')} AS folded FROM conversations)")
def inflected_tokens(spark, sf_dir):
    folded = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fold(F.col("text")).alias("folded"))
    return folded.select("conv_id", "turn", *[F.col("folded").rlike(text.inflected(p)).alias(p) for p in _PHRASES])


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') || chr(10) || coalesce(regexp_extract(html, 'lang="([^"]*)"', 1), '') || chr(10) || 'card' AS surface FROM pages""")
def text_surface(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.text_surface(F.col("url"), F.regexp_extract("html", 'lang="([^"]*)"', 1), F.lit("card")).alias("surface"))


@query("""WITH s AS (SELECT s_suppkey AS id, 'src' || s_suppkey % 7 AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'landlord' || s_suppkey % 5 END AS landlord, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 4 THEN 'src' || s_suppkey % 5 END AS theirs FROM supplier),
  p AS (SELECT 'src' || i AS source, CASE WHEN i % 2 = 0 THEN 'institutional' ELSE 'private' END AS family, ['LLI', NULL, 'PLS', 'LIBRE', NULL][i + 1] AS dt, i = 3 AS mixed FROM range(5) t(i)),
  j AS (SELECT s.*, coalesce(a.family, 'institutional') AS fa, a.dt AS da, coalesce(a.mixed, true) AS ma, coalesce(b.family, 'institutional') AS fb, b.dt AS db, coalesce(b.mixed, true) AS mb,
    landlord IS NOT NULL AND theirs IS DISTINCT FROM s.source AS other FROM s LEFT JOIN p a ON a.source = s.source LEFT JOIN p b ON b.source = s.theirs),
  r AS (SELECT *, CASE WHEN da IS NULL THEN 1 WHEN da = 'PLS' THEN 2 ELSE 0 END AS ra, CASE WHEN db IS NULL THEN 1 WHEN db = 'PLS' THEN 2 ELSE 0 END AS rb FROM j)
  SELECT id, CASE WHEN other THEN coalesce(theirs, landlord) ELSE source END AS profile, CASE WHEN NOT other THEN fa WHEN theirs IS NULL OR fa = 'institutional' OR fb = 'institutional' THEN 'institutional' ELSE 'private' END AS family,
    CASE WHEN NOT other THEN da WHEN theirs IS NULL THEN NULL WHEN rb >= ra THEN db ELSE da END AS default_tenure, CASE WHEN NOT other THEN ma WHEN theirs IS NULL THEN true ELSE ma OR mb END AS mixed FROM r""")
def source_profiles(spark, sf_dir):
    k = F.col("s_suppkey")
    named = lambda n: F.concat(F.lit("src"), (k % n).cast("string"))
    listings = table(spark, sf_dir, "supplier").select(k.alias("id"), named(7).alias("source"), F.when(k % 3 == 0, F.concat(F.lit("landlord"), (k % 5).cast("string"))).alias("landlord"), F.when((k % 3 == 0) & (k % 5 != 4), named(5)).alias("landlord_source"))
    defaults = ("LLI", None, "PLS", "LIBRE", None)
    first = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("i"))
    profiles = first.select(F.concat(F.lit("src"), F.col("i").cast("string")).alias("source"), F.when(F.col("i") % 2 == 0, "institutional").otherwise("private").alias("family"), turn(defaults, "i").alias("default_tenure"), (F.col("i") == 3).alias("mixed"))
    return classify.effective_profiles(listings, profiles).select("id", "profile", "family", "default_tenure", "mixed")


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+)\s+([a-z]+)\.', 1)) AS head, unnest(regexp_extract_all(text, '([A-Z][a-z]+)\s+([a-z]+)\.', 2)) AS tail, generate_subscripts(regexp_extract_all(text, '([A-Z][a-z]+)\s+([a-z]+)\.', 1), 1) - 1 AS place FROM documents)
  SELECT doc_id, min(place) AS place, head, arg_min(tail, place) AS tail FROM m GROUP BY doc_id, head""")
def digest_cards(spark, sf_dir):
    return store.digest_cards(table(spark, sf_dir, "documents"), r"([A-Z][a-z]+)\s+([a-z]+)\.", ("head", "tail"), "doc_id", "text").withColumn("place", F.col("place").cast("long"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 4 THEN 'Dev ' || o_orderkey END AS title, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'Acme' END AS company, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'Paris' END AS location,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Hybride' END AS mode_word, CASE WHEN o_orderkey % 5 IN (0, 2) THEN '45 k€ par an' END AS pay_text,
  CASE o_orderkey % 5 WHEN 0 THEN 'Candidature simplifiée | 50 k€' WHEN 1 THEN '' WHEN 2 THEN 'Acme | Urgent' WHEN 3 THEN '' ELSE '' END AS labels FROM orders""")
def card_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    head = F.concat(F.lit("  Dev "), k.cast("string"))
    card = (
        F.when(k % 5 == 0, F.concat(head, F.lit("\n\nAcme · Paris (Hybride)\n45 k€ par an\nCandidature simplifiée\n50 k€")))
        .when(k % 5 == 1, F.concat(head, F.lit("\nAcme · Paris")))
        .when(k % 5 == 2, F.concat(head, F.lit("\nAcme\n45 k€ par an\nUrgent")))
        .when(k % 5 == 3, head)
        .otherwise(F.lit(" \n"))
    )
    cards = table(spark, sf_dir, "orders").select(k.alias("id"), card.alias("text"))
    return store.card_lines(cards, "text", r"^(.+?) · ([^(]+?)(?: \((.+)\))?$", "k€").select("id", "title", "company", "location", "mode_word", "pay_text", F.coalesce("labels", F.lit("")).alias("labels"))


#: (url, name of a field, its value, doubt, class, outcome) of a listing whose text is a whole document after the words for free letting.
_TIER1 = (
    ("https://h/appartement-12", "etage", "3", None, "LIBRE", "MATCH"), ("https://h/logement-social/12", "etage", "3", "logement-social", "UNKNOWN", "DIGEST"), ("https://h/12", "typeHLM", "non", "hlm", "UNKNOWN", "DIGEST"),
    ("https://h/12", "note", "financementLogementSocial", "logement social", "UNKNOWN", "DIGEST"), ("https://h/12", "note", "commission", None, "LIBRE", "MATCH"), ("https://h/12", "note", "caf&bogus; x", "?", "UNKNOWN", "DIGEST"),
    ("https://h/12", "Financement", "PLUS/LLI", None, "PLUS", "REJECT"), ("https://h/12", "Type de produit", "pls", None, "PLS", "REJECT"), ("https://h/12", "Financement", "LLI", None, "LLI", "MATCH"),
)


@query(f"""SELECT doc_id, {sql_turn([r[3] for r in _TIER1], 'doc_id')} AS doubt, {sql_turn([r[4] for r in _TIER1], 'doc_id')} AS tenure, {sql_turn([r[5] for r in _TIER1], 'doc_id')} AS outcome FROM documents""")
def tenure_fields(spark, sf_dir):
    """Classes of listings out of fields and addresses beside whole texts. A document that has
    something like a word for a class in it is the value of the card's own text instead."""
    d = table(spark, sf_dir, "documents").withColumn("own", F.coalesce(F.lower("text").rlike("(hlm|pls|plai|p.l.u.s|anru|anah|sne|plus|lli|convention|social|interm|loyer|libre|caleol|attribution|numero|numéro|plafond|avantage|avec)"), F.lit(True)))
    of = lambda i: turn([r[i] for r in _TIER1], "doc_id")
    listings = d.select("doc_id", F.concat(F.lit("Loyer libre\n\n"), F.when(F.col("own"), "").otherwise(F.col("text"))).alias("text"), of(0).alias("url"), F.create_map(of(1), of(2), F.lit("_text"), F.when(F.col("own"), F.col("text")).otherwise("hlm")).alias("fields"), F.lit(None).cast("string").alias("default_tenure"), F.lit(False).alias("mixed"), F.lit(False).alias("detail_read"))
    return classify.tenure(listings).select("doc_id", F.get("doubts", F.lit(0)).alias("doubt"), "tenure", "outcome")


_BANDS_SQL = ", ".join(f"('{z}', '{p}', {n}, '{t}', {a}, {u})" for z, p, n, t, a, u in ceilings.bands())


@query(f"""WITH b(zone, place, household, open_class, above, up_to) AS (VALUES {_BANDS_SQL}),
  h AS (SELECT c_custkey AS id, {sql_turn(("A bis", "A", "B1", "C"), 'c_custkey')} AS zone, {sql_turn(("Paris", "IdF hors Paris"), '(c_custkey // 4)')} AS place, CAST(c_custkey % 7 + 1 AS INTEGER) AS household,
    CAST({sql_turn((14811, 14812, 26920, 34996, 44344, 44345, 36144, 92900, 92901, 138874, 138875, 31860, 0, 62871, 62872), 'c_custkey')} + abs(floor(c_acctbal)) * (c_custkey % 5) AS INTEGER) AS income FROM customer)
  SELECT id, (SELECT open_class FROM b WHERE b.zone = h.zone AND b.place = h.place AND b.household = least(h.household, 6) AND income > above AND income <= up_to) AS open_class FROM h""")
def income_bands(spark, sf_dir):
    """Incomes at both ends of the bands and in between."""
    k = F.col("c_custkey")
    income = turn((14811, 14812, 26920, 34996, 44344, 44345, 36144, 92900, 92901, 138874, 138875, 31860, 0, 62871, 62872), "c_custkey") + F.abs(F.floor("c_acctbal")) * (k % 5)
    place = F.element_at(F.array(F.lit("Paris"), F.lit("IdF hors Paris")), (F.floor(k / 4) % 2 + 1).cast("int"))
    h = table(spark, sf_dir, "customer").select(k.alias("id"), turn(("A bis", "A", "B1", "C"), "c_custkey").alias("zone"), place.alias("place"), (k % 7 + 1).cast("int").alias("household"), income.cast("int").alias("income"))
    return ceilings.open_to(h).select("id", "open_class")
