"""Stored state, drains and passes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import classify, drains, health, history, match, store, walk
from sluice.plans.field_queries import sql_turn, turn
from sluice.plans.registry import query
from sluice.plans.views import FLATS_SQL, PRICES_SQL, QUEUE_SQL, RUNS_SQL, flats, prices, queue, runs, table
from sluice.sources import mapping
from sluice.streaming import hydration

_TENURES = ("LLI", "UNKNOWN", "LIBRE", "UNKNOWN", "LLI", "LLI", "LIBRE")
_READINGS = f"r AS (SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'PLS' ELSE {sql_turn(_TENURES, 'o_orderkey')} END AS tenure, o_orderpriority AS source, CAST(floor(o_totalprice / 3000) AS INTEGER) % 100 AS confidence FROM orders)"


def _readings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tenure = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "PLS").otherwise(turn(_TENURES, "o_orderkey"))
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), tenure.alias("tenure"), F.col("o_orderpriority").alias("source"), (F.floor(F.col("o_totalprice") / 3000) % 100).cast("int").alias("confidence"))


@query(f"""WITH {_READINGS}, l AS (SELECT key, list({{'t': tenure, 's': source, 'c': confidence}} ORDER BY seq) AS all_ FROM r GROUP BY key),
  f AS (SELECT key, list_reduce(all_, lambda a, x: CASE WHEN a.t = 'PLS' THEN a WHEN a.t = 'UNKNOWN' AND x.t NOT IN ('PLS', 'UNKNOWN') AND x.c < 60 THEN a ELSE x END) AS a FROM l)
  SELECT key, a.t AS tenure, a.s AS source FROM f""")
def twin_tenure(spark, sf_dir):
    return store.twin_tenure(_readings(spark, sf_dir))


@query(f"WITH {_READINGS} SELECT key, arg_max(tenure, seq) AS tenure, arg_max(confidence, seq) AS confidence FROM r GROUP BY key")
def latest_verdict(spark, sf_dir):
    return store.latest(_readings(spark, sf_dir), "key", "seq", "tenure", "confidence")


@query(f"""WITH {_READINGS}, e AS (SELECT *, seq % 6 = 0 AS reopens FROM r), c AS (SELECT key, coalesce(max(seq) FILTER (reopens), -1) AS cutoff FROM e GROUP BY key)
  SELECT key, arg_max(tenure, seq) FILTER (NOT reopens AND seq > cutoff) AS tenure, count(*) FILTER (NOT reopens AND seq <= cutoff) AS dropped FROM e JOIN c USING (key) GROUP BY key""")
def reopened(spark, sf_dir):
    return store.reopened(_readings(spark, sf_dir).withColumn("kind", F.when(F.col("seq") % 6 == 0, "reopen").otherwise("reading")))


_ATTEMPTS = "a AS (SELECT user_id AS key, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 75 AS ok FROM events)"
_CACHE = f"{_ATTEMPTS}, c AS (SELECT key, count(*) AS attempts, arg_max(event_type, seq) FILTER (ok) AS fields, arg_max('fp' || k % 3, seq) FILTER (ok) AS fingerprint, CASE WHEN NOT arg_max(ok, seq) THEN arg_max('error ' || k, seq) END AS last_error, max(seq) AS last_at FROM a GROUP BY key)"


def _cache(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), (k >= 75).alias("ok"), F.col("event_type").alias("fields"), F.concat(F.lit("fp"), (k % 3).cast("string")).alias("fingerprint"), F.concat(F.lit("error "), k.cast("string")).alias("error"))
    return store.detail_cache(e)


@query(f"WITH {_CACHE} SELECT * FROM c")
def detail_cache(spark, sf_dir):
    return _cache(spark, sf_dir)


@query(f"WITH {_ATTEMPTS}, p AS (SELECT key, CAST(seq // 400 AS BIGINT) AS part, count(*) AS attempts, bool_or(ok) AS read FROM a GROUP BY ALL) SELECT part AS source, count(*) AS n FROM p WHERE NOT read AND attempts >= 2 GROUP BY part")
def detail_failures(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    part = F.floor(F.col("event_id") / 400)
    e = table(spark, sf_dir, "events").select(F.struct(F.col("user_id").alias("id"), part.alias("part")).alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), (k >= 75).alias("ok"), F.col("event_type").alias("fields"), F.lit("fp").alias("fingerprint"), F.lit("e").alias("error"))
    return store.detail_failures(store.detail_cache(e), F.col("key.part"), 2)


@query(f"""WITH {RUNS_SQL}, s AS (SELECT source, id, "at", CASE WHEN ok AND id % 3 = 0 THEN 'OK' WHEN id % 2 = 0 THEN 'BROKEN' ELSE 'STALE' END AS status FROM runs), w AS (SELECT *, coalesce(max(CASE WHEN status = 'OK' THEN id END) OVER (PARTITION BY source), -1) AS well FROM s)
  SELECT source, status, arg_max("at", id) AS "at" FROM w WHERE status <> 'OK' AND id > well GROUP BY source, status""")
def open_alerts(spark, sf_dir):
    status = F.when(F.col("ok") & (F.col("id") % 3 == 0), "OK").when(F.col("id") % 2 == 0, "BROKEN").otherwise("STALE")
    return store.open_alerts(runs(spark, sf_dir).select("source", "id", "at", status.alias("status")))


@query(f"""WITH {RUNS_SQL} SELECT source AS key, greatest(0, 1704200000 - min("at")) AS age FROM runs GROUP BY source""")
def listing_age(spark, sf_dir):
    return runs(spark, sf_dir).groupBy(F.col("source").alias("key")).agg(F.min("at").alias("first")).select("key", store.age(F.col("first"), F.lit(1_704_200_000)).alias("age"))


@query(f"""WITH {PRICES_SQL}, asked AS (SELECT key, min(ts) + (max(ts) - min(ts)) * 0 + INTERVAL 40 HOUR AS "at" FROM obs GROUP BY key)
  SELECT a.key, arg_max(price, (ts, seq)) FILTER (ts <= "at") AS "before", arg_min(price, (ts, seq)) FILTER (ts > "at") AS "after" FROM asked a LEFT JOIN points p ON p.key = a.key GROUP BY a.key""".replace("(max(ts) - min(ts)) * 0 + ", ""))
def price_around(spark, sf_dir):
    seen = prices(spark, sf_dir)
    asked = seen.groupBy("key").agg((F.min("ts") + F.expr("INTERVAL 40 HOUR")).alias("at"))
    return store.around(history.change_points(seen), asked).select("key", "before", "after")


@query(f"""WITH {RUNS_SQL}, j AS (SELECT id // 500 AS run, source, ok, CASE items % 3 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'DIGEST' ELSE 'REJECT' END AS outcome FROM runs)
  SELECT run, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (NOT ok) AS failed, count(*) FILTER (ok) AS items, count(*) FILTER (ok AND outcome = 'MATCH') AS matches, count(*) FILTER (ok AND outcome = 'DIGEST') AS digested, count(*) FILTER (ok AND outcome = 'REJECT') AS rejected FROM j GROUP BY run""")
def run_totals(spark, sf_dir):
    outcome = F.when(F.col("items") % 3 == 0, "MATCH").when(F.col("items") % 3 == 1, "DIGEST").otherwise("REJECT")
    return store.run_totals(runs(spark, sf_dir).select(F.floor(F.col("id") / 500).alias("run"), "source", "ok", outcome.alias("outcome")))


@query("""WITH c AS (SELECT l_orderkey AS card, l_returnflag || l_linenumber AS pattern, l_discount > 0.05 AS hit, l_quantity > 45 AS yields FROM lineitem), k AS (SELECT *, bool_or(yields) OVER (PARTITION BY card) AS kept FROM c)
  SELECT pattern, count(*) AS calls, count(*) FILTER (hit) AS hits FROM k WHERE kept GROUP BY pattern""")
def kept_tally(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return store.kept_tally(i.select(F.col("l_orderkey").alias("card"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("pattern"), (F.col("l_discount") > 0.05).alias("hit"), (F.col("l_quantity") > 45).alias("yields")))


@query("""WITH m AS (SELECT l_suppkey AS source FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag HAVING count(*) >= 3 AND count(*) FILTER (l_discount > 0.08) = 0)
  SELECT s_suppkey AS source, CASE WHEN s_acctbal < 0 THEN 'BROKEN' WHEN s_suppkey IN (SELECT source FROM m) THEN 'WARN_DROP' ELSE 'OK' END AS status FROM supplier""")
def escalated(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    misses = health.pattern_misses(i.select(F.col("l_suppkey").alias("source"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("pattern"), (F.col("l_discount") > 0.08).alias("hit")))
    verdicts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.when(F.col("s_acctbal") < 0, "BROKEN").otherwise("OK").alias("status"))
    return store.escalated(verdicts, misses)


_BROKEN = "CASE event_id % 5 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN '' WHEN 2 THEN NULL ELSE props END"


@query(f"SELECT event_type AS type, count(*) AS n FROM (SELECT event_type, {_BROKEN} AS j FROM events) WHERE j IS NULL OR j = '' OR NOT json_valid(j) GROUP BY 1")
def unreadable_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.expr(_BROKEN).alias("j"))
    return store.unreadable(e, "j").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, 1700000000 AS notified_at FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08)")
def seeded_index(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.08").select(F.col("l_partkey").alias("id"))
    return store.seeded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), known, F.lit(1_700_000_000))


@query("""WITH p AS (SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CAST(floor(o_totalprice / 50000) AS BIGINT) AS n FROM orders),
  t AS (SELECT source, sum(n) AS n, arg_max(n, page) AS last, max(CASE WHEN page = 1 THEN n END) AS first FROM p GROUP BY source), d AS (SELECT c_custkey AS source, CAST(c_custkey % 900 AS BIGINT) AS total FROM customer)
  SELECT d.source, CASE WHEN ceil(total / 10.0) > 60 THEN 'too many pages' WHEN coalesce(first, 0) = 0 AND total > 0 THEN 'no cards' WHEN coalesce(n, 0) + CASE WHEN last < 10 THEN 9 ELSE 0 END < total THEN 'lost pages' END AS problem FROM d LEFT JOIN t USING (source)""")
def walk_checks(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    pages = o.select(F.col("o_custkey").alias("source"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), F.floor(F.col("o_totalprice") / 50_000).alias("n"))
    declared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") % 900).alias("total"))
    return store.walk_checks(pages, declared, 10)


@query("""WITH l AS (SELECT o_orderkey AS lot, o_custkey AS sale, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + 36000 END AS opens, o_orderkey % 3 <> 0 AS live, CASE WHEN o_orderkey % 4 <> 1 THEN CAST(epoch(o_orderdate) AS BIGINT) + 36000 + (o_orderkey % 7 - 1) * 3600 END AS countdown FROM orders),
  s AS (SELECT o_custkey AS sale, strftime(min(o_orderdate), '%Y-%m-%d') AS day, CAST(epoch(min(o_orderdate)) AS BIGINT) + 50000 AS closes FROM orders GROUP BY 1 HAVING o_custkey % 9 <> 0),
  j AS (SELECT l.*, s.day, CASE WHEN live THEN s.closes ELSE countdown END AS closes FROM l LEFT JOIN s USING (sale))
  SELECT coalesce(CASE WHEN opens IS NULL THEN 'no opening' WHEN closes IS NULL THEN 'no closing' WHEN live AND day <> strftime(make_timestamp(opens * 1000000), '%Y-%m-%d') THEN 'other day' WHEN closes <= opens THEN 'closes first' WHEN closes <= 900000000 THEN 'closed' END, '-') AS problem, count(*) AS n FROM j GROUP BY 1""")
def lot_windows(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    opens = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 36_000
    lots = o.select(k.alias("lot"), F.col("o_custkey").alias("sale"), F.when(k % 10 != 0, opens).alias("opens"), (k % 3 != 0).alias("live"), F.when(k % 4 != 1, opens + (k % 7 - 1) * 3600).alias("countdown"))
    sales = o.where("o_custkey % 9 <> 0").groupBy(F.col("o_custkey").alias("sale")).agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("d")).select("sale", F.date_format("d", "yyyy-MM-dd").alias("day"), (F.unix_timestamp("d") + 50_000).alias("closes"))
    return store.lot_windows(lots, sales, F.lit(900_000_000)).groupBy(F.coalesce("problem", F.lit("-")).alias("problem")).agg(F.count("*").alias("n"))


_KINDS = f"{QUEUE_SQL}, q AS (SELECT key, CASE outcome WHEN 'O' THEN 'DIGEST' ELSE 'MATCH' END AS outcome, seen, score, notified_at, key % 40 = 0 AS no FROM queue)"


def _kinds(spark, sf_dir):
    return queue(spark, sf_dir).withColumn("outcome", F.when(F.col("outcome") == "O", "DIGEST").otherwise("MATCH"))


def _refused(spark, sf_dir):
    return queue(spark, sf_dir).select("key", F.when(F.col("key") % 40 == 0, "own").alias("route"))


@query(f"""WITH {_KINDS}, a AS (SELECT key, seen, CASE WHEN no THEN 'refused' WHEN outcome = 'MATCH' AND score >= 73 THEN 'retry' WHEN outcome = 'MATCH' THEN 'rollup' ELSE 'digest' END AS queue FROM q WHERE notified_at IS NULL),
  p AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seen, key) AS place FROM a)
  SELECT key, CASE WHEN queue IN ('rollup', 'digest') AND place > 50 THEN 'overflow' ELSE queue END AS action, CASE WHEN queue = 'retry' THEN 'MATCH' WHEN queue IN ('rollup', 'digest') AND place <= 50 THEN upper(queue) END AS kind FROM p""")
def daily_drain(spark, sf_dir):
    return drains.daily_drain(_kinds(spark, sf_dir), _refused(spark, sf_dir), 73)


@query(f"WITH {_KINDS} SELECT key, outcome FROM q WHERE NOT no AND notified_at IS NULL")
def send_refusal(spark, sf_dir):
    return drains.sendable(_kinds(spark, sf_dir).where("notified_at is null"), _refused(spark, sf_dir)).select("key", "outcome")


@query(f"""WITH {QUEUE_SQL}, w AS (SELECT source, count(*) FILTER (outcome = 'O' AND notified_at IS NULL) AS d, count(*) FILTER (outcome = 'F' AND notified_at IS NULL) AS m FROM queue GROUP BY source)
  SELECT source, greatest(0, d - 3) + greatest(0, m - 2) AS left_over FROM w""")
def digest_overflow(spark, sf_dir):
    waiting = lambda kind: F.count_if((F.col("outcome") == kind) & F.col("notified_at").isNull())
    per = queue(spark, sf_dir).groupBy("source").agg(waiting("O").alias("d"), waiting("F").alias("m"))
    return per.select("source", drains.overflow(F.col("d"), F.lit(3), F.col("m"), F.lit(2)).alias("left_over"))


@query(f"""WITH {QUEUE_SQL}, t AS (SELECT key, seen, {sql_turn(("LLI", "UNKNOWN", None, "PLS"), 'key')} AS tenure FROM queue)
  SELECT key, tenure, row_number() OVER (ORDER BY seen DESC, key) AS place FROM t WHERE tenure IS NULL OR tenure = 'UNKNOWN'""")
def stale_verdicts(spark, sf_dir):
    rows = queue(spark, sf_dir).withColumn("tenure", turn(("LLI", "UNKNOWN", None, "PLS"), "key"))
    return drains.stale(rows).select("key", "tenure", "place")


@query(f"""WITH RECURSIVE {FLATS_SQL}, own AS (SELECT id, family FROM flats WHERE rooms > 2), linked AS (SELECT a, b FROM same JOIN own x ON x.id = a JOIN own y ON y.id = b WHERE sa <> sb AND fa <> fb),
  both_ AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked), walk AS (SELECT id AS node, id AS label FROM own UNION SELECT both_.b, walk.label FROM walk JOIN both_ ON both_.a = walk.node),
  lab AS (SELECT node, min(label) AS label FROM walk GROUP BY node)
  SELECT arg_min(o.id, (CAST(family <> 'institutional' AS INTEGER), o.id)) AS id, list_sort(list(o.id)) AS keys FROM lab JOIN own o ON o.id = node GROUP BY label""")
def collapsed_twins(spark, sf_dir):
    rows = flats(spark, sf_dir).where("rooms > 2")
    return match.collapse_twins(rows.select("id", "family"), match.pairs(rows, "twin"))


@query(f"""WITH {PRICES_SQL} SELECT key, seq, 'x : ' || CAST(previous AS BIGINT) || ' € → ' || CAST(price AS BIGINT) || ' € (−' || CAST(previous - price AS BIGINT) || ' €, −' || CAST(round((previous - price) * 100 / previous) AS INTEGER) || ' %)' AS line FROM points WHERE price < previous AND previous > 0 AND previous < 1000""")
def drop_lines(spark, sf_dir):
    found = history.drops(history.change_points(prices(spark, sf_dir))).where("previous > 0 and previous < 1000")
    return found.select("key", "seq", drains.drop_line(F.lit("x"), F.col("previous"), F.col("price")).alias("line"))


@query(f"""WITH {_KINDS}, p AS (SELECT key % 50 AS batch, CASE outcome WHEN 'MATCH' THEN 'rollup' ELSE 'digest' END AS queue, key AS place, 'n' || key AS line FROM q),
  s AS (SELECT batch, queue, CASE queue WHEN 'digest' THEN 'À vérifier' ELSE 'Sous le seuil' END || ' (' || count(*) || ')' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY place) AS section FROM p GROUP BY batch, queue)
  SELECT batch, string_agg(section, chr(10) || chr(10) ORDER BY queue) AS text FROM s GROUP BY batch""")
def digest_message(spark, sf_dir):
    rows = _kinds(spark, sf_dir).select((F.col("key") % 50).alias("batch"), F.when(F.col("outcome") == "MATCH", "rollup").otherwise("digest").alias("queue"), F.col("key").alias("place"), F.concat(F.lit("n"), F.col("key").cast("string")).alias("line"))
    return drains.message(rows, {"digest": "À vérifier", "rollup": "Sous le seuil"})


@query("""WITH e AS (SELECT user_id AS key, event_id AS seq, ts AS "at", CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'read' ELSE 'seen' END AS event FROM events),
  f AS (SELECT *, min(CASE WHEN event = 'seen' THEN ("at", seq) END) OVER (PARTITION BY key) AS first, min(CASE WHEN event = 'read' THEN ("at", seq) END) OVER (PARTITION BY key) AS read FROM e),
  m AS (SELECT *, sum(CASE WHEN event = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY "at", seq) AS n FROM f WHERE ("at", seq) >= first AND (read IS NULL OR ("at", seq) < read)), x AS (SELECT max("at") AS last FROM e)
  SELECT key, 1 AS attempt, "at" AS due FROM m WHERE event = 'seen' AND ("at", seq) = first
  UNION ALL SELECT key, CAST(n + 1 AS INTEGER), "at" + INTERVAL 6 HOUR FROM m, x WHERE event = 'failed' AND n < 3 AND (read IS NULL OR read[1] >= "at" + INTERVAL 6 HOUR) AND "at" + INTERVAL 6 HOUR < last""")
def hydration_due(spark, sf_dir):
    """Events as a log of pages that are seen, fail and are read."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "read").otherwise("seen")
    return hydration.due_log(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("event")))


@query("""WITH p AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS source, page_id AS page, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN '' ELSE html END AS html FROM pages),
  c AS (SELECT source, count(*) AS pages, count(html) AS arrived, count(*) FILTER (WHERE len(regexp_extract_all(html, '<li><a ')) > 0) AS held, coalesce(sum(len(regexp_extract_all(html, '<li><a '))), 0) AS n FROM p GROUP BY source)
  SELECT source, pages - arrived AS lost, arrived - held AS empty, CAST(greatest(0, 7 * pages - 6 - n) AS BIGINT) AS missing FROM c WHERE arrived < pages OR held < arrived OR n < 7 * pages - 6""")
def walk_faults(spark, sf_dir):
    """Hosts as sources of pages that declare seven cards a page: some pages are lost, some are empty."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("source"), F.col("page_id").alias("page"), "url", F.when(F.col("page_id") % 11 == 0, None).when(F.col("page_id") % 13 == 0, "").otherwise(F.col("html")).alias("html"))
    declared = p.groupBy("source").agg(F.count("*").alias("pages"), (F.count("*") * 7).alias("total"))
    return walk.faults(p, walk.cards(p, "nav li", {"href": "a@href"}), declared, 7)


@query("SELECT c_custkey AS source, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS first FROM customer")
def first_passes(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("source"))
    return store.first_passes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source")), seen)


@query(f"""WITH j AS (SELECT event_id AS id, user_id, event_type, {_BROKEN} AS j FROM events), r AS (SELECT *, j IS NULL OR j = '' OR NOT json_valid(j) AS degraded FROM j)
  SELECT id, degraded, CASE WHEN degraded THEN CAST(user_id AS INTEGER) ELSE CAST(json_extract_string(j, '$.k') AS INTEGER) END AS k, CASE WHEN degraded THEN event_type ELSE json_extract_string(j, '$.title') END AS title FROM r""")
def degraded_rows(spark, sf_dir):
    """Snapshots of which some can't be read: their rows come from stored columns."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.expr(_BROKEN).alias("snapshot"))
    return mapping.restore_or_rebuild(e, "k int, title string", {"k": "user_id", "title": "event_type"}).select("id", "degraded", "k", "title")


@query("""SELECT event_id AS id, ts + CAST(floor(value) AS INTEGER) * INTERVAL 1 MINUTE > ts AND ts + CAST(floor(value) AS INTEGER) * INTERVAL 1 MINUTE < CASE WHEN date_trunc('day', ts) + INTERVAL 8 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 8 HOUR ELSE date_trunc('day', ts) + INTERVAL 32 HOUR END AS urgent FROM events""")
def auction_urgency(spark, sf_dir):
    """Events as auctions that close some minutes on, against the rollup at eight."""
    closes = F.col("ts") + F.make_interval(mins=F.floor("value").cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), classify.closes_before_rollup(closes, F.col("ts"), 8, "UTC").alias("urgent"))
