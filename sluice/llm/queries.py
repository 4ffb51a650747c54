"""The corpus queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph_ann, licences, line_dedup, mixing, ordinal, periods, pieces, pivots, ppm, set_join, simhash, suffix_dedup, whitening
from .common import read


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ordinal.ratings(read(spark, sf_dir, "labels")), grades=3)
    found = ordinal.grade_texts(docs, model)
    good = F.col("tails")[1]
    return found.select("doc_id", "expected_grade", good.alias("good_probability"), (good >= ordinal.KEEP_FROM).alias("keep"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated(read(spark, sf_dir, "documents"), length=200)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_robust_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("removed").alias("n_removed"), "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(read(spark, sf_dir, "embeddings"), k=5, every=50).select("query_id", "rank", "vec_id", "score")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"), licences.known(spark))


def op8_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.groups(read(spark, sf_dir, "documents"), per_cent=80, words=5)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.find(read(spark, sf_dir, "documents"), planted=True))


def queries() -> dict:
    return {
        "op1_ordinal_quality": op1_ordinal_quality,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_robust_graph_ann": op3_robust_graph_ann,
        "op4_subset_sum_mixing": op4_subset_sum_mixing,
        "op5_line_dedup": op5_line_dedup,
        "op6_pivot_top_k": op6_pivot_top_k,
        "op7_licence_scan": op7_licence_scan,
        "op8_ppm_scoring": op8_ppm_scoring,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_ngram_jaccard": op11_ngram_jaccard,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_pivot_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op7_licence_scan": licences.oracle(),
        "op11_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(greatest(len(w) - 4, 1)), lambda i: hash(array_to_string(w[i + 1 : i + 5], ' '))) END) AS h FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
            r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
            m AS (SELECT a, min(b) AS b FROM r GROUP BY a), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.k, 0) AS n_links, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
            FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id""",
    }
