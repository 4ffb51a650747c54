"""Job offers made of orders: titles, descriptions and places in turn. What each text
states is written by hand in the SQL, so that it checks the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import jobs
from sluice.plans.registry import query
from sluice.plans.views import spread, table

TITLES = ("Développeur PHP senior", "Lead developer Java (H/F)", "Stage développeur web", "Ingénieur logiciel confirmé", "Chef de cuisine", "Développeur junior alternance", "Tech lead Symfony remote", "")
DESCRIPTIONS = (
    "Poste en CDI, 2 jours de télétravail par semaine. Salaire 45-55 k€ brut par an. Stack PHP, Symfony, React.",
    "Freelance non accepté. CDI sur site uniquement. Salaire entre 60 000 et 70 000 € par an. Java, Angular.",
    "Pas de télétravail. TJM 450 € par jour, portage possible. Astreintes régulières. Node.js.",
    "Télétravail complet. Pas d'astreinte. TDD et revue de code. Package 80 k€ variable inclus.",
    "Habilitation secret défense requise. Hybride. 3 500 € par mois brut. PHP legacy.",
    "Nationalité française non requise. 2 jours de télétravail par mois. Prime 500 € par mois.",
    None,
)
PLACES = ("Paris 9e", "Lyon (69)", "Saint-Denis, La Réunion", "Nanterre", "")
NOW = 1_700_000_000

CRITERIA = jobs.JobCriteria(
    weights={"stack": 25, "pay": 25, "level": 10, "green": 15, "remote": 15, "freshness": 10},
    salary_floor=50_000,
    salary_target=80_000,
    tjm_floor=400,
    tjm_target=600,
    roles={"developer": r"\bdeveloppeu(?:r|se)s?\b|\bdevelopers?\b", "engineer": r"\bingenieure? logiciel\b", "lead": r"\btech[- ]?lead\b"},
    title_rejects={"stage": r"\bstages?\b", "alternance": r"\balternances?\b"},
    exclude={"angular": r"\bangular\b"},
    rejected_contracts=("stage", "alternance", "portage"),
    inside={"paris": r"\bparis\b", "saint-denis": r"\bsaint-denis\b", "nanterre": r"\bnanterre\b"},
    outside={"lyon": r"\blyon\b", "reunion": r"\bla reunion\b"},
    back=(0.7, {"PHP": r"\bphp\b", "Symfony": r"\bsymfony\b"}),
    front=(0.3, {"React": r"\breact\b"}),
    adjacent=(0.4, {"Java": r"\bjava\b", "Node": r"\bnode(?:\.js)?\b"}),
    green={"tests": {"TDD": r"\btdd\b"}, "review": {"revue": r"\brevue de code\b"}},
    red={"astreintes": r"\bastreintes?\b"},
    red_penalty=10,
    red_cap=25,
    conditions={"weekly": r"\bpar semaine\b"},
    conditions_bonus=0.1,
    level_shares={"lead": 1.0, "senior": 0.9, "confirme": 0.7, "junior": 0.2, "unlabelled": 0.5},
)

_FACTS = """j AS (SELECT o_orderkey AS key, o_orderkey % 8 AS t, (o_orderkey // 8) % 7 AS d, (o_orderkey // 3) % 5 AS l FROM orders),
facts AS (SELECT *, list_sort(list_distinct(list_concat(CASE t WHEN 2 THEN ['stage'] WHEN 5 THEN ['alternance'] ELSE []::VARCHAR[] END,
    CASE d WHEN 0 THEN ['cdi'] WHEN 1 THEN ['cdi'] WHEN 2 THEN ['portage'] ELSE []::VARCHAR[] END, CASE WHEN key % 17 = 0 THEN ['cdd'] ELSE []::VARCHAR[] END))) AS contracts,
  CASE t WHEN 0 THEN 'senior' WHEN 1 THEN 'lead' WHEN 3 THEN 'confirme' WHEN 5 THEN 'junior' WHEN 6 THEN 'lead' END AS level,
  CASE WHEN key % 19 = 0 THEN 'onsite' WHEN d = 0 THEN 'hybrid' WHEN d IN (1, 2) THEN CASE WHEN t <> 6 THEN 'onsite' END WHEN d = 3 THEN 'remote'
    WHEN d = 4 THEN CASE WHEN t <> 6 THEN 'hybrid' END WHEN t = 6 THEN 'remote' END AS mode,
  CAST(CASE WHEN key % 19 = 0 THEN 0 WHEN d = 0 THEN 2 WHEN d IN (1, 2) THEN CASE WHEN t <> 6 THEN 0 END WHEN d = 3 THEN 5 WHEN d = 4 THEN NULL WHEN t = 6 THEN 5 END AS DOUBLE) AS days,
  CASE WHEN d = 4 THEN 'clearance' END AS eligibility, CAST(key % 13 = 0 AS INTEGER) + CAST(d <= 4 AS INTEGER) AS n_pay FROM j)"""
_JUDGED = (
    f"WITH {_FACTS}"
    + """, scored AS (SELECT *,
  CASE WHEN key % 97 = 0 THEN 'unreadable' WHEN d = 4 AND key % 13 <> 0 THEN 'pay'
    WHEN len(contracts) > 0 AND len(list_filter(contracts, lambda c: c NOT IN ('stage', 'alternance', 'portage'))) = 0 THEN 'contract'
    WHEN d = 1 THEN 'pattern: angular' WHEN t = 4 THEN 'role' WHEN t = 2 THEN 'title: stage' WHEN t = 5 THEN 'title: alternance' WHEN d = 4 THEN 'clearance'
    WHEN l IN (1, 2) AND mode IN ('onsite', 'hybrid') THEN 'location' END AS disqualifier,
  25 * (CASE WHEN t IN (0, 6) OR d IN (0, 4) THEN 0.7 WHEN t = 1 OR d IN (1, 2) THEN 0.4 ELSE 0 END + CASE WHEN d = 0 THEN 0.3 ELSE 0 END)
  + 25 * greatest(CASE d WHEN 0 THEN 5 / 30.0 WHEN 1 THEN 20 / 30.0 WHEN 2 THEN 0.25 ELSE 0 END, CASE WHEN key % 13 = 0 THEN 8 / 30.0 ELSE 0 END)
  + 10 * CASE level WHEN 'lead' THEN 1.0 WHEN 'senior' THEN 0.9 WHEN 'confirme' THEN 0.7 WHEN 'junior' THEN 0.2 ELSE 0.5 END
  + CASE WHEN d = 3 THEN 15 ELSE 0 END
  + 15 * CASE WHEN mode IS NULL THEN 0 ELSE least(1.0, CASE WHEN mode = 'remote' THEN 1 WHEN mode = 'onsite' THEN 0 WHEN days = 2 THEN 0.4 ELSE 0.5 END + CASE WHEN d = 0 THEN 0.1 ELSE 0 END) END
  + 10 * CASE WHEN key % 11 = 0 THEN 0 WHEN key % 30 <= 7 THEN 1 ELSE greatest(0, 1 - (key % 30 - 7) / 7.0) END
  - CASE WHEN d = 2 THEN 10 ELSE 0 END AS total FROM facts)"""
)


def offers(spark, sf_dir):
    """Orders as job offers."""
    o = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")))
    turn = lambda values, place: F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))
    every = lambda n, value: F.when(F.col("key") % n == 0, value)
    return o.select(
        "key",
        turn(TITLES, F.col("key") % 8).alias("title"),
        turn(DESCRIPTIONS, F.floor(F.col("key") / 8) % 7).alias("description"),
        turn(PLACES, F.floor(F.col("key") / 3) % 5).alias("location"),
        F.lit(None).cast("string").alias("pay_text"),
        every(17, F.array(F.lit("CDD"))).alias("stated"),
        every(19, F.lit("onsite")).alias("stated_mode"),
        every(13, F.lit(52_000)).alias("salary_low"),
        every(13, F.lit(58_000)).alias("salary_high"),
        F.lit(None).cast("int").alias("tjm_low"),
        F.lit(None).cast("int").alias("tjm_high"),
        F.when(F.col("key") % 11 != 0, F.lit(NOW) - F.col("key") % 30 * 86_400).alias("published"),
        (F.col("key") % 97 == 0).alias("unreadable"),
    )


@query(f"WITH {_FACTS} SELECT key, contracts, level, mode, days, eligibility, n_pay FROM facts")
def job_facts(spark, sf_dir):
    return jobs.facts(offers(spark, sf_dir)).select("key", "contracts", "level", "mode", "days", "eligibility", F.size("pay").alias("n_pay"))


@query(_JUDGED + " SELECT key, disqualifier, CASE WHEN disqualifier IS NULL THEN CAST(greatest(0, least(100, round(round(total, 9)))) AS INTEGER) END AS score, CASE WHEN disqualifier IS NULL THEN 'MATCH' ELSE 'REJECT' END AS outcome FROM scored")
def job_score(spark, sf_dir):
    return jobs.judge(jobs.facts(offers(spark, sf_dir), CRITERIA), CRITERIA, F.lit(NOW)).select("key", "disqualifier", "score", "outcome")


@query(f"WITH {_FACTS} SELECT coalesce(CASE WHEN l IN (1, 2) THEN 'outside' WHEN l <> 4 THEN 'inside' END, '-') AS place, t <> 4 AS role, CASE t WHEN 2 THEN 'stage' WHEN 5 THEN 'alternance' END AS rejects, count(*) AS n FROM facts GROUP BY ALL")
def job_gates(spark, sf_dir):
    rows = offers(spark, sf_dir).withColumn("s", jobs.surface(F.col("title")))
    rows = rows.select(F.coalesce(jobs.location_class(F.col("location"), CRITERIA), F.lit("-")).alias("place"), jobs.role_passes(F.col("s"), CRITERIA).alias("role"), jobs.first_term(F.col("s"), CRITERIA.title_rejects).alias("rejects"))
    return rows.groupBy("place", "role", "rejects").agg(F.count("*").alias("n"))
