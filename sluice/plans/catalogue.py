"""The registered queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import prose, text
from sluice.operators import classify, drains, health, history, judge, match
from sluice.plans.registry import QUERIES, SQL, query, sql_fold, sql_list
from sluice.plans.views import CARS_SQL, FLATS_SQL, PRICES_SQL, QUEUE_SQL, RUNS_SQL, cars, flats, prices, queue, runs, table
from sluice.sources import mail, pages, selectors



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- judging and scoring -------------------------------------------------------------

CRITERIA = judge.VehicleCriteria(
    max_price=1900.0,
    peak_age=5.0,
    peak_mileage=80_000.0,
    weights={"price": 10, "age": 15, "mileage": 10, "gearbox": 0, "fuel": 15, "body": 25, "brand": 25},
    postcode_prefixes=["0", "1", "2", "3", "4", "5", "6", "7", "8"],
    body_favour=["small", "promo"],
    brand_avoid=["brand#1(?![0-9])", "brand#2(?![0-9])"],
    brand_favour=["brand#1[0-9]"],
    exclude_patterns=[],
    hail_penalty=30,
)
_VERDICT_SQL = f"""WITH {CARS_SQL}, verdict AS (SELECT *,
  CASE WHEN price > 1900 THEN 'price' WHEN postcode IS NOT NULL AND left(postcode, 1) = '9' THEN 'location' END AS disqualifier,
  CAST(greatest(0, least(100, round(
    10 * coalesce(greatest(0, 1 - price / 1900), 0)
    + 15 * coalesce(CASE WHEN age <= 5 THEN 1 ELSE greatest(0, 1 - (age - 5) / 5) END * CASE WHEN age IS NULL THEN NULL ELSE 1 END, 0)
    + 10 * CASE WHEN mileage <= 80000 THEN 1 ELSE greatest(0, 1 - (mileage - 80000) / 80000) END
    + 15 * CASE fuel WHEN 'essence' THEN 1 WHEN 'hybride' THEN 1 WHEN 'electrique' THEN 1 WHEN 'gpl' THEN 0.5 ELSE 0 END
    + 25 * CASE WHEN body IN ('small', 'promo') THEN 1 ELSE 0 END
    + 25 * CASE WHEN make IN ('brand#1', 'brand#2') THEN 0 WHEN regexp_matches(make, '^brand#1[0-9]$') THEN 1 ELSE 0 END
    - 30 * CASE WHEN hail THEN 1 ELSE 0 END))) AS INTEGER) AS full_score FROM cars)"""


def _verdict(spark, sf_dir):
    return judge.vehicle_verdict(cars(spark, sf_dir), CRITERIA)


@query(_VERDICT_SQL + " SELECT coalesce(disqualifier, 'none') AS reason, count(*) AS n FROM verdict GROUP BY 1")
def judge_first_disqualifier(spark, sf_dir):
    return _verdict(spark, sf_dir).groupBy(F.coalesce("disqualifier", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(_VERDICT_SQL + """ SELECT key, disqualifier, CASE WHEN disqualifier IS NULL THEN full_score END AS score,
  disqualifier IS NULL AND full_score >= 73 AS high_priority, CASE WHEN disqualifier IS NULL THEN 'MATCH' ELSE 'REJECT' END AS outcome FROM verdict""")
def score_listings(spark, sf_dir):
    return _verdict(spark, sf_dir).select("key", "disqualifier", "score", "high_priority", "outcome")


@query(_VERDICT_SQL + " SELECT key, full_score AS score FROM verdict WHERE disqualifier IS NULL ORDER BY full_score DESC, key LIMIT 50")
def score_top_k(spark, sf_dir):
    return _verdict(spark, sf_dir).where("disqualifier is null").orderBy(F.desc("score"), "key").limit(50).select("key", "score")


RENT = judge.RentCriteria(max_rent=60_000.0, min_surface=10.0, min_rooms=2, min_price_m2=1000.0)
_RENT_VIEW = """flats AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_discount > 0 THEN l_extendedprice END AS rent_cc,
  CASE WHEN l_tax > 0.02 THEN l_extendedprice * 0.9 END AS rent_hc, CASE WHEN l_tax > 0.05 THEN l_tax * 1000 END AS charges,
  CASE WHEN l_quantity <> 20 THEN l_quantity END AS surface, CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS rooms FROM lineitem)"""


def _rents(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("n"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("rent_cc"),
        F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice") * 0.9).alias("rent_hc"),
        F.when(F.col("l_tax") > 0.05, F.col("l_tax") * 1000).alias("charges"),
        F.when(F.col("l_quantity") != 20, F.col("l_quantity")).alias("surface"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("rooms"),
    )


@query(f"""WITH {_RENT_VIEW}, v AS (SELECT *, coalesce(rent_cc, rent_hc + charges) AS rent FROM flats), d AS (SELECT *,
  CASE WHEN rooms < 2 THEN 'rooms' WHEN surface < 10 THEN 'surface' WHEN rent > 60000 THEN 'rent' WHEN rent IS NULL AND rent_hc > 60000 THEN 'rent_hc' END AS disqualifier,
  CASE WHEN surface > 0 AND rooms > 0 THEN rent / surface END AS price_m2 FROM v)
  SELECT coalesce(disqualifier, '-') AS disqualifier, CASE WHEN disqualifier IS NOT NULL THEN 'REJECT' WHEN price_m2 < 1000 THEN 'DIGEST' ELSE 'MATCH' END AS outcome,
  count(*) AS n, count(rent) AS known FROM d GROUP BY 1, 2""")
def null_is_unknown_filter(spark, sf_dir):
    out = judge.rent_verdict(_rents(spark, sf_dir), RENT)
    return out.groupBy(F.coalesce("disqualifier", F.lit("-")).alias("disqualifier"), "outcome").agg(F.count("*").alias("n"), F.count("rent").alias("known"))


@query(f"WITH {_RENT_VIEW} SELECT o, n, coalesce(rent_cc, rent_hc + charges) AS rent FROM flats")
def rent_cc_derive(spark, sf_dir):
    return _rents(spark, sf_dir).select("o", "n", judge.effective_rent(F.col("rent_cc"), F.col("rent_hc"), F.col("charges")).alias("rent"))


@query("""WITH f AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_suppkey AS VARCHAR) AS commune, l_extendedprice AS rent, l_quantity AS surface,
  CAST(round(l_tax * 100) AS INTEGER) AS floor, CASE WHEN l_discount > 0.05 THEN true WHEN l_discount > 0.02 THEN false END AS elevator, l_linestatus = 'O' AS fresh FROM lineitem),
  r AS (SELECT CAST(s_suppkey AS VARCHAR) AS commune, s_nationkey + 1 AS rank FROM supplier WHERE s_suppkey % 2 = 0),
  j AS (SELECT f.*, r.rank, (SELECT max(rank) FROM r) AS worst FROM f LEFT JOIN r USING (commune)),
  p AS (SELECT *, round(20 * CASE WHEN worst <= 1 THEN 1.0 ELSE (worst - coalesce(rank, worst)) / CAST(worst - 1 AS DOUBLE) END)
    + round(30 * least(1.0, greatest(0.0, 60000 - rent) / 60000)) + round(25 * least(1.0, greatest(0.0, (surface - 10) / 5.0)))
    + coalesce(round(10 * CASE WHEN floor <= 1 OR elevator THEN 1.0 END), 0) + coalesce(round(15 * CASE WHEN floor > 1 AND NOT elevator THEN -1.0 END), 0)
    + coalesce(round(15 * CASE WHEN fresh THEN 1.0 END), 0) AS total FROM j)
  SELECT o, n, CAST(round(greatest(0, least(100, total)) * 100 / 100) AS INTEGER) AS score FROM p""")
def rent_score(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("n"),
        F.col("l_suppkey").cast("string").alias("commune"),
        F.col("l_extendedprice").alias("rent"),
        F.col("l_quantity").alias("surface"),
        F.round(F.col("l_tax") * 100, 0).cast("int").alias("floor"),
        F.when(F.col("l_discount") > 0.05, True).when(F.col("l_discount") > 0.02, False).alias("elevator"),
        (F.col("l_linestatus") == "O").alias("fresh"),
    )
    ranks = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("commune"), (F.col("s_nationkey") + 1).alias("rank"))
    weights = {"commune": 20, "headroom": 30, "surface": 25, "lift": 10, "high_floor": 15, "fresh": 15}
    return judge.rent_score(item, RENT, weights, ranks).select("o", "n", "score")


@query("""WITH j AS (SELECT c_custkey AS key, list(o_totalprice ORDER BY o_orderkey) AS pays, list(DISTINCT o_orderstatus) AS contracts, count(*) AS n
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
  SELECT key, len(list_filter(pays, lambda x: x * 13 < 100000)) = len(pays) AS under_floor, len(list_filter(contracts, lambda x: x NOT IN ('F', 'O'))) = 0 AS rejected, least(25.0, len(contracts) * 10.0) AS penalty FROM j""")
def job_filters(spark, sf_dir):
    pay = F.collect_list(F.struct(F.lit("MONTH").alias("period"), F.col("o_totalprice").alias("max"))).alias("pay")
    jobs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").groupBy(F.col("o_custkey").alias("key")).agg(pay, F.collect_set("o_orderstatus").alias("contracts"))
    return jobs.select("key", judge.pay_under_floor(F.col("pay"), 100_000).alias("under_floor"), judge.all_rejected(F.col("contracts"), ["F", "O"]).alias("rejected"), judge.red_flags(F.col("contracts"), 10, 25).alias("penalty"))


# --- matching ------------------------------------------------------------------------


@query(f"WITH {FLATS_SQL} SELECT a, b FROM same")
def band_self_join(spark, sf_dir):
    return match.pairs(flats(spark, sf_dir))


@query(f"WITH {FLATS_SQL} SELECT a, b FROM same WHERE sa <> sb AND fa = fb")
def duplicate_pairs(spark, sf_dir):
    return match.pairs(flats(spark, sf_dir), "duplicate")


@query(f"WITH {FLATS_SQL} SELECT a, b FROM same WHERE sa <> sb AND fa <> fb")
def twin_pairs(spark, sf_dir):
    return match.pairs(flats(spark, sf_dir), "twin")


@query(f"""WITH {FLATS_SQL}, linked AS (SELECT a AS id, b AS other FROM same UNION ALL SELECT b, a FROM same)
  SELECT linked.id, min(other) AS witness FROM linked JOIN flats f ON f.id = other WHERE f.source = 'R' GROUP BY 1""")
def excluded_semi(spark, sf_dir):
    rows = flats(spark, sf_dir)
    return match.excluded_witness(rows, rows.where("source = 'R'"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ORDER BY 1 LIMIT 200")
def known_anti(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return pages.unseen(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), known, 200)


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS grp, o_orderstatus = 'F' AS excluded, CAST(floor(o_totalprice / 10000) AS INTEGER) AS confidence FROM orders),
  b AS (SELECT grp, arg_max(id, (confidence, -id)) AS veto FROM r WHERE excluded GROUP BY grp)
  SELECT r.id, CASE WHEN b.veto <> r.id THEN b.veto END AS veto FROM r LEFT JOIN b USING (grp)""")
def group_veto(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), (F.col("o_orderstatus") == "F").alias("excluded"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("confidence"))
    return match.group_veto(o).select("id", "veto")


_COMPONENTS = f"""WITH RECURSIVE {FLATS_SQL}, linked AS (SELECT a, b FROM same UNION SELECT b, a FROM same),
  walk AS (SELECT a AS node, a AS label FROM linked UNION SELECT linked.b, walk.label FROM walk JOIN linked ON linked.a = walk.node)"""


@query(_COMPONENTS + " SELECT node, min(label) AS label FROM walk GROUP BY node")
def connected_groups(spark, sf_dir):
    return match.components(match.pairs(flats(spark, sf_dir)))


@query(f"""WITH RECURSIVE {FLATS_SQL}, linked AS (SELECT a, b FROM same WHERE sa <> sb AND fa <> fb UNION SELECT b, a FROM same WHERE sa <> sb AND fa <> fb),
  walk AS (SELECT id AS node, id AS label FROM flats UNION SELECT linked.b, walk.label FROM walk JOIN linked ON linked.a = walk.node),
  ranked AS (SELECT id, CASE source WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS rank FROM flats)
  SELECT node AS id, max(rank) AS rank FROM walk JOIN ranked ON ranked.id = walk.label GROUP BY node""")
def twin_fixed_point(spark, sf_dir):
    rows = flats(spark, sf_dir)
    ranked = rows.select("id", F.when(F.col("source") == "R", 2).when(F.col("source") == "A", 1).otherwise(0).alias("rank"))
    return match.spread_rank(ranked, match.pairs(rows, "twin"))


@query(f"""WITH RECURSIVE {FLATS_SQL}, dup AS (SELECT b AS id, a AS before FROM same WHERE sa <> sb AND fa = fb),
  walk AS (SELECT 0 AS round, id, CAST(NULL AS BOOLEAN) AS survives FROM (SELECT id FROM dup UNION SELECT before FROM dup)
    UNION ALL SELECT w.round + 1, w.id, any_value(coalesce(w.survives, CASE WHEN e.joins THEN false WHEN coalesce(e.open_, 0) = 0 THEN true END))
      FROM walk w LEFT JOIN (SELECT d.id, bool_or(coalesce(x.survives, false)) AS joins, sum(CAST(x.survives IS NULL AS INTEGER)) AS open_ FROM dup d JOIN walk x ON x.id = d.before GROUP BY d.id) e ON e.id = w.id
      WHERE w.round < 12 GROUP BY w.round, w.id),
  done AS (SELECT id, survives FROM walk WHERE round = 12)
  SELECT f.id, coalesce((SELECT min(d.before) FROM dup d JOIN done s ON s.id = d.before AND s.survives JOIN done o ON o.id = d.id AND NOT o.survives WHERE d.id = f.id), f.id) AS survivor FROM flats f""")
def greedy_cluster(spark, sf_dir):
    return match.greedy_clusters(flats(spark, sf_dir))


@query(f"""WITH {FLATS_SQL}, linked AS (SELECT a AS id, b AS other, sa AS s, sb AS t, fa AS f, fb AS g FROM same UNION ALL SELECT b, a, sb, sa, fb, fa FROM same),
  own AS (SELECT id FROM flats WHERE source = 'R'), grp AS (SELECT f.id FROM flats f WHERE EXISTS (SELECT 1 FROM flats x WHERE x.source = 'R' AND x.rooms = 7 AND x.commune = f.commune)),
  twin AS (SELECT DISTINCT id FROM linked WHERE t = 'R' AND s <> t AND f <> g), dwell AS (SELECT DISTINCT id FROM linked WHERE t = 'R')
  SELECT id, CASE WHEN id IN (SELECT id FROM own) THEN 'own' WHEN id IN (SELECT id FROM grp) THEN 'group' WHEN id IN (SELECT id FROM twin) THEN 'twin' WHEN id IN (SELECT id FROM dwell) THEN 'dwelling' END AS route FROM flats""")
def gate_four_routes(spark, sf_dir):
    from sluice.plans.session import cut

    rows = flats(spark, sf_dir)
    refused = rows.where("source = 'R'").select("id")
    group = rows.join(rows.where("source = 'R' and rooms = 7").select("commune").distinct(), "commune", "left_semi")
    links = cut(match.related(rows))  # found once; twins and dwellings both come from it
    near = links.withColumn("twin", F.expr("other_source and other_family"))
    near = near.select(F.col("a").alias("id"), F.col("b").alias("other"), "twin").union(near.select("b", "a", "twin"))
    bad = near.join(refused.withColumnRenamed("id", "other"), "other")
    return match.gate(rows.select("id"), refused, group.select("id"), bad.where("twin").select("id"), bad.select("id"))


# --- price history and state ---------------------------------------------------------


@query(f"WITH {PRICES_SQL} SELECT key, seq, price, previous FROM points")
def price_change_points(spark, sf_dir):
    return history.change_points(prices(spark, sf_dir)).select("key", "seq", "price", "previous")


@query(f"""WITH RECURSIVE {PRICES_SQL.split(",\nknown AS")[0]}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM obs WHERE price IS NOT NULL),
  w(key, i, seq, price, written, history) AS (SELECT key, i, seq, price, true, [{{'ts': ts, 'seq': seq, 'price': price}}] FROM n WHERE i = 1
    UNION ALL SELECT n.key, n.i, n.seq, n.price,
      coalesce(list_sort(list_filter(w.history, lambda h: h.ts <= n.ts))[-1].price <> n.price, true) AND coalesce(list_sort(list_filter(w.history, lambda h: h.ts > n.ts))[1].price <> n.price, true),
      CASE WHEN coalesce(list_sort(list_filter(w.history, lambda h: h.ts <= n.ts))[-1].price <> n.price, true) AND coalesce(list_sort(list_filter(w.history, lambda h: h.ts > n.ts))[1].price <> n.price, true)
        THEN list_append(w.history, {{'ts': n.ts, 'seq': n.seq, 'price': n.price}}) ELSE w.history END
    FROM w JOIN n ON n.key = w.key AND n.i = w.i + 1)
  SELECT key, seq, price FROM w WHERE written""")
def price_history_arrivals(spark, sf_dir):
    """Prices that are written down as events arrive, some of them late, some in whole tens."""
    return history.recorded(prices(spark, sf_dir)).select("key", "seq", "price")


@query(f"WITH {PRICES_SQL} SELECT key, seq, price - previous AS delta FROM points WHERE price < previous")
def price_drops(spark, sf_dir):
    return history.drops(history.change_points(prices(spark, sf_dir))).select("key", "seq", "delta")


@query(f"WITH {PRICES_SQL} SELECT key, count(*) AS n, sum(CAST(previous > 200 AND price <= 200 AS BIGINT)) AS crossed FROM points WHERE price < previous AND (previous - price >= 100 OR (previous > 0 AND (previous - price) * 100 / previous >= 50)) GROUP BY key")
def notable_drops(spark, sf_dir):
    found = history.drops(history.change_points(prices(spark, sf_dir))).where(history.notable(F.col("delta"), F.col("previous"), 100, 50))
    return found.groupBy("key").agg(F.count("*").alias("n"), F.sum(history.crossed(F.col("previous"), F.col("price"), 200).cast("long")).alias("crossed"))


@query(f"WITH {PRICES_SQL} SELECT key, arg_max(price, (ts, seq)) AS price FROM obs WHERE price IS NOT NULL GROUP BY key")
def last_price(spark, sf_dir):
    return history.last_price(prices(spark, sf_dir))


@query(f"WITH {PRICES_SQL} SELECT key, c_mktsegment AS segment, list(price ORDER BY ts, seq) AS prices FROM points JOIN customer ON c_custkey = key GROUP BY ALL")
def price_history_join(spark, sf_dir):
    listings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return history.series(history.change_points(prices(spark, sf_dir))).join(listings, "key").select("key", "segment", "prices")


#: An arrival order that brings some observations late.
_ARRIVAL = "CASE WHEN seq % 7 = 0 THEN (seq + 500) * 2 + 1 ELSE seq * 2 END"


@query(f"""WITH {PRICES_SQL}, arrived AS (SELECT key, ts, {_ARRIVAL} AS seq, price, title FROM obs),
  marked AS (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM arrived)
  SELECT key, max(ts) AS seen, coalesce(arg_max(price, seq) FILTER (NOT late AND price IS NOT NULL), arg_min(price, seq) FILTER (late AND price IS NOT NULL)) AS price,
  coalesce(arg_max(title, seq) FILTER (NOT late AND title IS NOT NULL), arg_min(title, seq) FILTER (late AND title IS NOT NULL)) AS title, CAST(sum(CAST(late AS BIGINT)) AS BIGINT) AS n_late FROM marked GROUP BY key""")
def late_fold(spark, sf_dir):
    return history.fold(prices(spark, sf_dir).withColumn("seq", F.expr(_ARRIVAL)))


@query("""SELECT o_custkey AS key, max(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 3 END) AS rank, max(o_orderdate) AS "at" FROM orders GROUP BY 1""")
def announce_lattice(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "DIGEST").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "ROLLUP").when(F.col("o_orderpriority") == "3-MEDIUM", "MATCH")
    return history.announced(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), kind.alias("kind"), F.col("o_orderdate").alias("at")))


@query("""WITH r AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderpriority AS tenure, o_orderstatus = 'P' AS excluded FROM orders)
  SELECT key, coalesce(arg_max(tenure, seq) FILTER (excluded), arg_max(tenure, seq)) AS tenure FROM r GROUP BY key""")
def durable_reading(spark, sf_dir):
    return history.durable(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("tenure"), (F.col("o_orderstatus") == "P").alias("excluded")))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'web:id:' || url_encode(url) ELSE 'web:h:' || sha256(regexp_replace(url, '#.*$', '') || chr(10) || page_id) END AS key FROM pages""")
def dedup_key(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", history.dedup_key(F.lit("web"), F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("url"), F.col("page_id").cast("string")).alias("key"))


@query("SELECT l_orderkey AS o, l_linenumber AS n, sha1(l_returnflag || '|' || l_partkey || '|' || l_linenumber || '|' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS id FROM lineitem")
def content_id(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), history.content_id(F.col("l_returnflag"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("id"))


# --- health --------------------------------------------------------------------------

_OBSERVED = f"""WITH {RUNS_SQL}, isl AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY source ORDER BY id) AS island, max(CAST(ok AS INTEGER)) OVER (PARTITION BY source) AS ever FROM runs),
  fails AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY source, island) AS failures FROM isl),
  observed AS (SELECT source, id, "at", ok, items FROM fails WHERE ok OR failures >= 3 OR ever = 0)"""
_MEAN = '(SELECT CASE WHEN count(*) > 0 THEN sum(p.items) / CAST(count(*) AS DOUBLE) END FROM {0} p WHERE p.source = r.source AND p.ok AND p.id < r.id AND p."at" >= r."at" - 604800)'


@query(f"""WITH {RUNS_SQL}, m AS (SELECT *, coalesce(max(CASE WHEN ok THEN id END) OVER (PARTITION BY source), -1) AS a, coalesce(max(CASE WHEN NOT (ok AND items = 0) THEN id END) OVER (PARTITION BY source), -1) AS b FROM runs)
  SELECT source, CAST(sum(CAST(id > a AS INTEGER)) AS BIGINT) AS failed, CAST(sum(CAST(id > b AS INTEGER)) AS BIGINT) AS empty FROM m GROUP BY source""")
def run_streaks(spark, sf_dir):
    return health.streaks(runs(spark, sf_dir))


@query(_OBSERVED + " SELECT source, id FROM observed")
def observed_runs(spark, sf_dir):
    return health.observed(runs(spark, sf_dir)).select("source", "id")


@query(f"WITH {RUNS_SQL} SELECT r.source, r.id, round({_MEAN.format('runs')}, 6) AS mean FROM runs r")
def rolling_mean(spark, sf_dir):
    return health.rolling_mean(runs(spark, sf_dir)).select("source", "id", F.round("mean", 6).alias("mean"))


@query(f"WITH {RUNS_SQL} SELECT source, id, last_value(CASE WHEN ok AND items > 0 THEN items END IGNORE NULLS) OVER (PARTITION BY source ORDER BY id) AS productive FROM runs")
def last_productive(spark, sf_dir):
    return health.last_productive(runs(spark, sf_dir)).select("source", "id", "productive")


def _now(rows):
    """The time of the last run, as a scalar subquery: nothing runs while a query is built."""
    return rows.select(F.coalesce(F.max("at"), F.lit(0))).scalar()


@query(f"""WITH {RUNS_SQL}, n AS (SELECT max("at") AS now FROM runs) SELECT source, CAST(sum(CAST("at" >= now - 604800 AS INTEGER)) AS BIGINT) AS runs_7d, CAST(sum(CAST("at" >= now - 604800 AND NOT ok AS INTEGER)) AS BIGINT) AS failed_7d,
  CAST(sum(CAST("at" >= now - 86400 AS INTEGER)) AS BIGINT) AS runs_1d, CAST(sum(CAST("at" >= now - 86400 AND NOT ok AS INTEGER)) AS BIGINT) AS failed_1d FROM runs, n GROUP BY source""")
def window_counts(spark, sf_dir):
    rows = runs(spark, sf_dir)
    now = _now(rows)
    return rows.groupBy("source").agg(*health.window_counts(rows, now, 7), *health.window_counts(rows, now, 1))


_LADDER = _OBSERVED + f""", n AS (SELECT max("at") AS now FROM runs),
  seen AS (SELECT r.*, {_MEAN.format('observed')} AS mean, last_value(CASE WHEN ok AND items > 0 THEN items END IGNORE NULLS) OVER (PARTITION BY source ORDER BY id) AS productive,
    coalesce(max(CASE WHEN NOT (ok AND items = 0) THEN id END) OVER (PARTITION BY source), -1) AS other FROM observed r),
  tail AS (SELECT source, arg_max(ok, id) AS last_ok, arg_max(items, id) AS last_items, sum(CAST(id > other AS INTEGER)) AS empty, max(id) AS last_id, min(CASE WHEN id > other THEN id END) AS first_empty FROM seen GROUP BY source),
  full_tail AS (SELECT t.*, l.mean AS last_mean, coalesce(f.mean, f.productive) AS baseline FROM tail t JOIN seen l ON l.source = t.source AND l.id = t.last_id LEFT JOIN seen f ON f.source = t.source AND f.id = t.first_empty),
  whole AS (SELECT source, max("at") AS credible, max("at") - min("at") AS span, sum(CAST(ok AS INTEGER)) AS good, max(CAST(ok AND items > 0 AS INTEGER)) AS produced,
    sum(CAST("at" >= now - 604800 AS INTEGER)) AS r7, sum(CAST("at" >= now - 604800 AND NOT ok AS INTEGER)) AS f7, sum(CAST("at" >= now - 86400 AS INTEGER)) AS r1, sum(CAST("at" >= now - 86400 AND NOT ok AS INTEGER)) AS f1, max(now) AS now FROM runs, n GROUP BY source),
  ladder AS (SELECT source, CASE WHEN NOT last_ok THEN 'BROKEN' WHEN empty >= 3 AND baseline > 0 THEN 'BROKEN' WHEN now - credible > 604800 THEN 'STALE'
    WHEN produced = 0 AND good >= 3 AND span >= 604800 THEN 'NEVER_PRODUCED' WHEN r7 >= 3 AND f7 / CAST(r7 AS DOUBLE) > 0.3 THEN 'WARN_FLAKY' WHEN r1 >= 20 AND f1 / CAST(r1 AS DOUBLE) > 0.2 THEN 'WARN_FLAKY'
    WHEN last_mean > 0 AND last_items < last_mean * 0.3 THEN 'WARN_DROP' ELSE 'OK' END AS status FROM whole JOIN full_tail USING (source))"""


@query(_LADDER + " SELECT source, status FROM ladder")
def health_ladder(spark, sf_dir):
    rows = runs(spark, sf_dir)
    return health.verdicts(rows, _now(rows))


@query(_LADDER + f""", alerts AS (SELECT source, CASE WHEN id % 2 = 0 THEN 'BROKEN' ELSE 'WARN_FLAKY' END AS status, max("at") AS "at" FROM runs WHERE NOT ok GROUP BY ALL)
  SELECT l.source, l.status FROM ladder l LEFT JOIN alerts a ON a.source = l.source AND a.status = l.status, n WHERE l.status <> 'OK' AND (a."at" IS NULL OR a."at" > now OR now - a."at" >= 12 * 3600)""")
def alert_cooldown(spark, sf_dir):
    rows = runs(spark, sf_dir)
    now = _now(rows)
    alerts = rows.where("not ok").select("source", F.when(F.col("id") % 2 == 0, "BROKEN").otherwise("WARN_FLAKY").alias("status"), "at")
    return health.due_alerts(health.verdicts(rows, now), alerts, now, 12)


@query(f"WITH {RUNS_SQL}, s AS (SELECT source, id, ok, lag(ok) OVER (PARTITION BY source ORDER BY id) AS before FROM runs) SELECT source, id FROM s WHERE ok AND NOT before")
def recovery_edges(spark, sf_dir):
    return health.recoveries(runs(spark, sf_dir).select("source", "id", F.when(F.col("ok"), "OK").otherwise("BROKEN").alias("status")))


@query("""WITH j AS (SELECT l_suppkey AS source, CASE l_suppkey % 4 WHEN 0 THEN 'Rent ' || l_quantity || ' € above' WHEN 1 THEN 'tenure: PLS' WHEN 2 THEN CASE WHEN l_quantity > 3 THEN 'rooms: 1' END ELSE CASE WHEN l_quantity > 3 THEN 'rooms: 1' ELSE 'surface: 2' END END AS reason FROM lineitem),
  k AS (SELECT source, CASE WHEN reason NOT LIKE 'tenure:%' THEN regexp_replace(lower(reason), '[0-9]+(\\.[0-9]+)?', 'N', 'g') END AS reason FROM j)
  SELECT source, min(reason) AS reason, count(*) AS n FROM k GROUP BY source HAVING count(*) >= 3 AND count(reason) = count(*) AND count(DISTINCT reason) = 1""")
def same_filter_warning(spark, sf_dir):
    many = F.col("l_quantity") > 3
    kinds = (F.concat(F.lit("Rent "), F.col("l_quantity").cast("string"), F.lit(" € above")), F.lit("tenure: PLS"), F.when(many, "rooms: 1"), F.when(many, "rooms: 1").otherwise("surface: 2"))
    reason = kinds[3]
    for i in range(3):
        reason = F.when(F.col("l_suppkey") % 4 == i, kinds[i]).otherwise(reason)
    return health.same_filter(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), reason.alias("reason")))


@query("SELECT l_suppkey AS source, l_returnflag || l_linenumber AS pattern, count(*) AS calls FROM lineitem GROUP BY ALL HAVING count(*) >= 3 AND sum(CAST(l_discount > 0.08 AS INTEGER)) = 0")
def pattern_miss(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return health.pattern_misses(i.select(F.col("l_suppkey").alias("source"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("pattern"), (F.col("l_discount") > 0.08).alias("hit")))


# --- queues --------------------------------------------------------------------------


@query(f"WITH {QUEUE_SQL} SELECT outcome, count(*) AS n, count(notified_at) AS notified, CAST(sum(CAST(notified_at IS NULL AS INTEGER)) AS BIGINT) AS waiting FROM queue GROUP BY outcome")
def store_counts(spark, sf_dir):
    return drains.counts(queue(spark, sf_dir))


@query(f"WITH {QUEUE_SQL} SELECT CASE WHEN score >= 73 THEN 'retry' ELSE 'batch' END AS route, count(*) AS n FROM queue WHERE outcome = 'F' AND notified_at IS NULL GROUP BY 1")
def queue_counts(spark, sf_dir):
    return drains.split_queue(queue(spark, sf_dir).where("outcome = 'F' and notified_at is null"), 73).groupBy("route").agg(F.count("*").alias("n"))


@query(f"WITH {QUEUE_SQL} SELECT key, seen, score FROM queue WHERE outcome = 'O' AND notified_at IS NULL ORDER BY seen, key LIMIT 50")
def pending_drain(spark, sf_dir):
    return drains.pending(queue(spark, sf_dir), "O").select("key", "seen", "score")


@query(f"WITH {QUEUE_SQL}, r AS (SELECT source, key, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS rank FROM queue) SELECT * FROM r WHERE rank <= 3")
def budget_top_k(spark, sf_dir):
    return drains.budgeted(queue(spark, sf_dir), "source", F.desc("score"), 3).select("source", "key", "rank")


@query(f"WITH {FLATS_SQL} SELECT id, row_number() OVER (PARTITION BY commune ORDER BY family <> 'institutional', id) AS place FROM flats")
def institutional_first(spark, sf_dir):
    return match.institutional_first(flats(spark, sf_dir)).select("id", "place")


@query("""WITH e AS (SELECT user_id AS key, event_type IN ('click', 'view') AS reaches, CAST(json_extract_string(props, '$.k') AS INTEGER) < 60 AS failed FROM events)
  SELECT key, coalesce(bool_or(reaches AND NOT failed), false) AS delivered FROM e GROUP BY key""")
def delivered(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return drains.delivered(e.select(F.col("user_id").alias("key"), F.col("event_type").isin("click", "view").alias("reaches"), (F.get_json_object("props", "$.k").cast("int") < 60).alias("failed")))


# --- text ----------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query(f"SELECT conv_id, turn, md5(trim(regexp_replace({sql_fold('text')}, '[^a-z0-9]+', ' ', 'g'))) AS key FROM conversations")
def commune_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.commune_key(F.col("text"))).alias("key"))


#: Names of fields with the words that a key leaves out, between others and inside of them.
_NAMES = ("", " de la rue", " d'achat", " du bail", " des lieux", " description designation duree", " DU D'Été des")
_KEYED = sql_fold(f"p_name || {sql_list(_NAMES)}[p_partkey % 7 + 1]")


@query(f"""SELECT p_partkey AS id, regexp_replace(replace(replace(replace(replace({_KEYED}, ' de ', ' '), ' d''', ' '), ' du ', ' '), ' des ', ' '), '[^a-z0-9]', '', 'g') AS key FROM part""")
def field_key(spark, sf_dir):
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.field_key(name).alias("key"))


TERMS = {"licence": "licen[cs]ed? ", "secret": "(password|token|secret)", "mail": "[a-z0-9.]+@[a-z0-9.]+", "version": "version [0-9]"}


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(folded, '{p}') THEN '{k}' END" for k, p in TERMS.items()) + f"], lambda x: x IS NOT NULL) AS hits FROM (SELECT doc_id, {sql_fold('text')} AS folded FROM documents)")
def term_hits(spark, sf_dir):
    folded = table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))
    return folded.select("doc_id", text.term_hits(F.col("folded"), TERMS).alias("hits"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches({sql_fold('text')}, 'licensed under') THEN 'licensed under' WHEN regexp_matches({sql_fold('text')}, 'http[s]?://') THEN 'http[s]?://' END AS pattern FROM documents")
def kind_exclusion(spark, sf_dir):
    folded = table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))
    return folded.select("doc_id", text.first_pattern(F.col("folded"), ["licensed under", "http[s]?://"]).alias("pattern"))


def _sql_redact(x: str) -> str:
    for pattern, mask in text.SECRETS:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern, mask.replace("$", "\\"))
    return x


#: Secrets of several kinds behind every text, so that each pattern has something to mask.
_LEAKS = (" me@host.example", " api.telegram.org/bot123:abc/send", " 1234567890:abcdefghijklmnopqrstuvwxyzABCDEF", " ntfy.sh/topic?x", " AUTH PLAIN AGFiY2RlZmdoaWprbA==", " RFR : 1234,5", " Basic dXNlcjpwYXNz", " token=abcdefgh", " https://u:p@h/x", " QWxhZGRpbjpvcGVuIHNlc2FtZQ==", " a%40b.org")


@query(f"SELECT doc_id, md5({_sql_redact(f'(text || {sql_list(_LEAKS)}[doc_id % 11 + 1])')}) AS masked FROM documents")
def redact_text(spark, sf_dir):
    leak = F.element_at(F.array(*map(F.lit, _LEAKS)), (F.col("doc_id") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.concat("text", leak))).alias("masked"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.none'), CASE WHEN lower(trim(event_type)) NOT IN ('', 'nd') THEN event_type END) AS first FROM events")
def json_first(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.first_present(F.get_json_object("props", "$.none"), F.col("event_type")).alias("first"))


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS french, CAST(o_orderkey AS DOUBLE) * 1000 AS thousands FROM orders")
def number_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    french = F.concat(F.lit("loyer : "), F.translate(F.format_number("o_totalprice", 2), ",.", " ,"), F.lit(" € cc"))
    grouped = F.concat(F.translate(F.format_number(F.col("o_orderkey") * 1000, 0), ",", "."), F.lit(" €"))
    return o.select(F.col("o_orderkey").alias("id"), F.round(text.number(french), 2).alias("french"), text.number(grouped).alias("thousands"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^[^?#]*', 0) AS stable FROM pages")
def url_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.normalise_url(F.col("url")).alias("url"), text.stable_url_id(F.col("url")).alias("stable"))


def sql_mentioned(x: str, pattern: str) -> str:
    """mentioned() as DuckDB SQL: each occurrence with the 40 characters beside it."""
    before, after = prose.BEFORE.replace("'", "''"), prose.AFTER.replace("'", "''")
    words, parts = f"regexp_extract_all({x}, '{pattern}')", f"string_split_regex({x}, '{pattern}')"
    total = lambda items: f"coalesce(list_sum(list_transform({items}, lambda w: length(w))), 0)"
    at = f"CAST({total(f'{parts}[1:i]')} + {total(f'{words}[1:i-1]')} AS BIGINT)"
    left = f"regexp_replace(substr({x}, greatest(1, {at} - 39), least(40, {at})), '(?s)^.*(\\n|\\. )', '')"
    right = f"substr({x}, {at} + 1 + length({words}[i]), 40)"
    return f"len(list_filter(range(1, len({words}) + 1), lambda i: NOT regexp_matches({left}, '{before}') AND NOT regexp_matches({right}, '{after}'))) > 0"


_WORDS = r"\b(?:of|de|der)\b"


@query(f"SELECT conv_id, turn, {sql_mentioned('folded', _WORDS)} AS mentioned FROM (SELECT conv_id, turn, {sql_fold('text')} AS folded FROM conversations)")
def negated_mentions(spark, sf_dir):
    read = prose.mention(_WORDS)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", read(text.fold(F.col("text"))).alias("mentioned"))


#: Prose about a flat and what it states: heating, lift, floor, amenities, damage by hail.
_PROSE = (
    ("Chauffage individuel électrique. Sans ascenseur, 3ème étage. Balcon et cave.", "individuel", "electrique", False, 3, ("balcon", "cave"), False),
    ("Immeuble avec ascenseur. Chauffage collectif au gaz. Parking inclus.", "collectif", "gaz", True, None, ("parking inclus",), False),
    ("Ascenseur : non. Rez-de-chaussée, rez de jardin. 12, les terrasses de la mare. Garage en sus.", None, None, False, 0, ("parking",), False),
    ("Véhicule grêlé. Chauffage urbain. Loggia, jardin, terrasse.", None, "urbain", None, None, ("terrasse", "loggia", "jardin"), True),
    ("Aucune trace de grêle. Sans chauffage. Premier étage.", None, None, None, 1, (), False),
)


def _prose_case(place: int) -> str:
    return "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN {sql_list([row[place]])[1:-1] if not isinstance(row[place], tuple) else sql_list(row[place]) + '::VARCHAR[]'}" for i, row in enumerate(_PROSE)) + " END"


@query(f"SELECT o_orderkey AS id, {_prose_case(1)} AS mode, {_prose_case(2)} AS energy, CAST({_prose_case(3)} AS BOOLEAN) AS lift, {_prose_case(4)} AS floor, {_prose_case(5)} AS amenities, CAST({_prose_case(6)} AS BOOLEAN) AS hail FROM orders")
def prose_facts(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(row[0]) for row in _PROSE]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.fold(words).alias("folded"))
    out = d.select("id", prose.heating_of("folded").alias("heating"), prose.lift_of("folded").alias("lift"), prose.floor_of("folded").alias("floor"), prose.amenities_of("folded").alias("amenities"), prose.hail_of("folded").alias("hail"))
    return out.select("id", F.col("heating.mode").alias("mode"), F.col("heating.energy").alias("energy"), "lift", "floor", "amenities", "hail")


# --- pages and mails -----------------------------------------------------------------


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1))) AS n,
  (regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1))[1] AS first FROM pages""")
def html_links(spark, sf_dir):
    found = pages.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.try_element_at(found, F.lit(1)).alias("first"))


@query(r"""SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<title(?:\s[^>]*)?>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title FROM pages""")
def html_fields(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.element_text(F.col("html"), "title").alias("title"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<html\s[^>]*?lang=["'']([^"'']*)["'']', 1), '') AS lang FROM pages""")
def html_attrs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.attribute(F.col("html"), "html", "lang").alias("lang"))


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS card, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), 1) - 1 AS place FROM pages)
  SELECT page_id, CAST(place AS INTEGER) AS place, nullif(regexp_extract(card, 'href="([^"]*)"', 1), '') AS href, nullif(trim(regexp_extract(card, '>([^<]*)</a>', 1)), '') AS words,
    nullif(regexp_extract(card, '>[^<]*?([a-z]{3})[^<]*</a>', 1), '') AS letters, CASE WHEN place = 0 THEN nullif(trim(regexp_extract(card, '>([^<]*)</a>', 1)), '') END AS first, NULL AS missing FROM c""")
def html_cards(spark, sf_dir):
    """The items of the menu of every page, by selectors; the id stands for the page's address."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    found = selectors.select(p, "nav > ul > li", {"href": "a[href]@href", "words": "", "letters": "li a => ([a-z]{3})", "first": "li:first-child > a", "missing": ".none@title"})
    return found.select(F.col("url").cast("long").alias("page_id"), "place", *[F.col("fields")[n].alias(n) for n in ("href", "words", "letters", "first", "missing")])


#: Rules of every host: whether a path is allowed, and its pattern.
_ROBOTS = ((False, "/en/"), (True, "/en/1*"), (True, "/*/0$"), (False, ""))


@query(r"""WITH p AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages)
  SELECT host, path, CASE WHEN path LIKE '/en/1%' THEN true WHEN regexp_matches(path, '^/.*/0$') THEN true WHEN path LIKE '/en/%' THEN false ELSE true END AS allowed FROM p GROUP BY ALL""")
def robots_longest_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("path"))
    each = F.array(*[F.struct(F.lit(allow).alias("allow"), F.lit(pattern).alias("pattern")) for allow, pattern in _ROBOTS])
    return pages.robots_allowed(p, p.select("host").distinct().select("host", F.inline(each)))


_ROBOTS_TEXT = "User-agent: *\nDisallow: /en/ # of everyone\n\nUSER-AGENT: Scout\nDisallow:\nDisallow: /de\nAllow: /de*9$\nCrawl-delay: 2"


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages), k AS (SELECT *, length(host) % 9 AS k FROM p)
  SELECT host, path, CASE WHEN k IN (3, 4, 5, 6, 8) THEN false WHEN k IN (1, 2) THEN true WHEN k = 0 THEN NOT regexp_matches(path, '^/de') OR regexp_matches(path, '^/de.*9$') ELSE NOT regexp_matches(path, '^/en/') END AS allowed FROM k""")
def robots_answers(spark, sf_dir):
    """Hosts that answer with rules, nothing, an error or a whole page instead."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("path"), "html")
    k = F.length("host") % 9
    hosts = p.groupBy("host").agg(F.min("html").alias("html"))
    answers = hosts.select(
        "host",
        F.when(k == 1, 404).when(k == 2, 410).when(k == 3, 503).when(k == 8, None).otherwise(200).cast("int").alias("status"),
        F.when(k == 4, "Text/HTML; charset=utf-8").when(k == 5, None).otherwise("text/plain").alias("content_type"),
        F.when(k.isin(5), F.col("html")).when(k == 6, '  {"error": 1}').when(k == 7, _ROBOTS_TEXT.split("\n\n")[0]).otherwise(_ROBOTS_TEXT).alias("body"),
    )
    return pages.robots_verdicts(p, answers, "scout")


@query(r"""WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\.\s')) AS seg, generate_subscripts(string_split_regex(text, '\.\s'), 1) - 1 AS place FROM conversations),
  n AS (SELECT *, conv_id * 1000 + turn AS msg, regexp_extract(seg, '^([A-Z][a-z]{2})', 1) AS id FROM s) SELECT msg, id, min(place) AS place FROM n WHERE id <> '' GROUP BY msg, id""")
def card_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("msg", F.col("conv_id") * 1000 + F.col("turn"))
    return mail.segments(c, r"\.\s", "msg", "text", "^([A-Z][a-z]{2})").select("msg", "id", F.col("place").cast("long").alias("place"))


@query("SELECT event_type AS source, count(*) AS n, 2500 AS total FROM events GROUP BY 1 HAVING count(*) < 2500 - 99")
def declared_total(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"))
    return pages.short_collect(e, e.select("source").distinct().withColumn("total", F.lit(2500)), 100)


@query(f"WITH {FLATS_SQL} SELECT count(*) AS n, sum(CAST(id AS HUGEINT) % 1000)::BIGINT AS checksum FROM flats")
def union_of_sources(spark, sf_dir):
    rows = flats(spark, sf_dir)
    parts = [rows.where(F.col("source") == s) for s in ("A", "N", "R")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.agg(F.count("*").alias("n"), F.sum(F.col("id") % 1000).alias("checksum"))



# --- classes -------------------------------------------------------------------------


@query()
def tenure_classify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fields = F.create_map(F.lit("Type de financement"), F.when(F.col("doc_id") % 9 == 0, "PLS").otherwise("logement intermediaire"), F.lit("lang"), F.col("lang"))
    listings = d.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, fields).otherwise(F.create_map(F.lit("lang"), F.col("lang"))).alias("fields"), F.when(F.col("source") != "src0", "LLI").alias("default_tenure"), (F.col("source") == "src1").alias("mixed"), F.lit(False).alias("detail_read"))
    return classify.tenure(listings).select("doc_id", "tenure", "confidence", "outcome", F.size("signals").alias("n_signals"))


@query()
def vehicle_classify(spark, sf_dir):
    return classify.vehicle(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "reasons", "outcome")


@query("""WITH n AS (SELECT s_suppkey AS id, s_name || ' ' || n_name AS advertiser FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  l AS (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(left(n_name, 5)) FROM nation)
  SELECT n.id, (SELECT name FROM l WHERE contains(lower(n.advertiser), name) ORDER BY length(name) DESC, name DESC LIMIT 1) AS landlord FROM n""")
def landlord_profile(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.lower("n_name").alias("name")).union(nation.select(F.lower(F.substring("n_name", 1, 5)))).distinct()
    listings = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", "s_name", "n_name").alias("advertiser"))
    return classify.landlord_profiles(listings, names).select("id", "landlord")


@query(f"""WITH {FLATS_SQL}, linked AS (SELECT a AS id, b AS other FROM same WHERE sa <> sb AND fa <> fb UNION ALL SELECT b, a FROM same WHERE sa <> sb AND fa <> fb),
  pushed AS (SELECT id FROM flats WHERE id % 3 = 0)
  SELECT id, family = 'private' AND EXISTS (SELECT 1 FROM linked l JOIN pushed p ON p.id = l.other WHERE l.id = flats.id) AS suppressed FROM flats""")
def twin_suppression(spark, sf_dir):
    rows = flats(spark, sf_dir)
    return classify.suppress_twins(rows.select("id", "family", (F.col("id") % 3 == 0).alias("pushed")), match.pairs(rows, "twin")).select("id", "suppressed")


@query("""WITH cache AS (SELECT s_nationkey AS commune, min(CAST(floor(s_acctbal / 100) AS INTEGER)) AS minutes FROM supplier WHERE floor(s_acctbal / 100) > 0 GROUP BY 1)
  SELECT c_custkey AS id, minutes, greatest(0.0, least(1.0, (120 - minutes) / 60.0)) * CASE WHEN minutes IS NULL THEN NULL ELSE 1 END AS share FROM customer LEFT JOIN cache ON commune = c_nationkey""")
def commute_enrich(spark, sf_dir):
    cache = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("commune"), F.lit("x").alias("postcode"), F.floor(F.col("s_acctbal") / 100).cast("int").alias("minutes"))
    listings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("commune"), F.lit("x").alias("postcode"))
    return classify.add_commute(listings, cache, 60).select("id", "minutes", F.when(F.col("minutes").isNotNull(), F.col("commute_share")).alias("share"))


# Queries of jobs, fields and stored state register themselves when they are imported.
from sluice.plans import field_queries, job_queries, state_queries, text_queries  # noqa: E402, F401
