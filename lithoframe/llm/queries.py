"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination
from .license_scan import FULL_TEXTS, TEMPLATES, license_matches
from .near_dedup import near_duplicates
from .piece_viterbi import encode
from .quality import fit_quality, held_out, quality_scores
from .secret_scan import joined, secret_findings
from .shared import only, table
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .topk_search import top_k
from .url_filter import judge_urls


def model_path() -> str:
    """Where the public SentencePiece model lies."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return near_duplicates(docs, n=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = remove_repeats(docs, length=400, carry=["doc_id"])
    removed = F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string", n_chars="bigint")
    machine = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs, machine, carry=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = license_matches(docs, templates=TEMPLATES | FULL_TEXTS, carry=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"])))
    best = F.array_max(F.transform("matches", lambda m: m["dice"]))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.round(best, 6).alias("best_dice"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = only(table(spark, sf_dir, "pages"), page_id="bigint", url="string", html="string")
    return judge_urls(pages, carry=["page_id"])


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    coded = encode(docs, model_path(), carry=["doc_id"], check=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), size=10, carry=["doc_id"])
    n_hit = F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string", source="string")
    found = secret_findings(docs, carry=["doc_id"])
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    judged = lambda verdict: F.size(F.filter("findings", lambda x: x["verdict"] == verdict)).cast("bigint").alias(f"n_{verdict}")
    base = F.filter("findings", lambda x: x["kind"] != "owned")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), judged("live"), judged("example"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return token_counts(docs, model_path(), carry=["doc_id"]).withColumn("over_limit", F.col("n_tokens") > 4096)


ENTRIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_license_scan": op5_license_scan,
    "op6_url_filter": op6_url_filter,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SHINGLES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, {_SHINGLES} AS w FROM documents),
        s AS (SELECT n, doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM d),
        c AS (SELECT row_number() OVER () AS c, g, len(g) AS m, min(doc_id) AS rep FROM s WHERE len(g) > 0 GROUP BY g),
        x AS (SELECT c, m, unnest(g) AS h FROM c),
        l AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.h = b.h AND a.c < b.c AND 100 * least(a.m, b.m) >= 80 * greatest(a.m, b.m) GROUP BY a.c, b.c, a.m, b.m HAVING 100 * count(*) >= 80 * (a.m + b.m - count(*))),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        k AS (SELECT r.a AS c, min(c.rep) AS component_id FROM r JOIN c ON r.b = c.c GROUP BY r.a)
        SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, coalesce(k.component_id, s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN c ON s.g = c.g AND len(s.g) > 0 LEFT JOIN k ON c.c = k.c""",
    "op2_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id, c.n AS other, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, other) AS p FROM s)
        SELECT query_id, CAST(p AS INTEGER) AS rank, vec_id, score FROM r WHERE p <= 5""",
    "op8_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
        l AS (SELECT DISTINCT len(g) AS l FROM g),
        o AS (SELECT n, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, l WHERE len(w) >= l),
        h AS (SELECT n, i, l, item_id FROM o JOIN g ON list_slice(w, i, i + l - 1) = g.g),
        f AS (SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY n),
        c AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(generate_series(i, i + l - 1)) AS p FROM h) GROUP BY n)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN f USING (n) LEFT JOIN c USING (n)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(ENTRIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
