"""Ranking and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as o
from ..plans.joins import shortest_paths
from ..sources.scans import table
from ..sources.types import catalog_columns
from .registry import Registry
from .relational import RELATIONS

add = Registry()
QUERIES, SQL = add.queries, add.sql

_QUERY = "SELECT embedding AS q FROM embeddings WHERE vec_id = 7"


def _cosine(spark, d, k: int):
    v = table(spark, d, "embeddings")
    query = v.filter("vec_id = 7").select("embedding").limit(1).collect()  # one vector
    return o.cosine_top_k(v, list(query[0][0]) if query else [0.0], "vec_id", "embedding", k)


@add(f"SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score, CAST(row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id) AS INTEGER) AS place FROM embeddings, ({_QUERY}) ORDER BY place LIMIT 10")
def cosine_topk(spark, d):
    return _cosine(spark, d, 10).select("doc_id", F.round("score", 6).alias("score"), "place")


_BM25 = """
terms AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS ts FROM documents),
size AS (SELECT count(*) AS n_docs, avg(len(ts)) AS mean FROM terms),
asked AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark),
tok AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM terms),
tf AS (SELECT doc_id, term, length, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
part AS (SELECT doc_id, tf.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean)) AS part FROM tf JOIN df ON tf.term = df.term, size),
scores AS (SELECT item_id AS query_id, doc_id, round(sum(part), 9) AS score FROM asked JOIN part ON asked.term = part.term GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM scores)
"""


@add(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, place FROM ranked WHERE place <= 10", also="bm25_topk_all")
def bm25_topk(spark, d):
    return o.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", {"text": 1.0}, "item_id", "text").withColumn("score", F.round("score", 6))


@add(f"WITH {_BM25}, cos AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id) AS place FROM embeddings, ({_QUERY}) ORDER BY place LIMIT 50) SELECT doc_id, round(sum(p), 8) AS score FROM (SELECT doc_id, 1.0 / (60 + place) AS p FROM cos UNION ALL SELECT doc_id, 0.5 / (60 + place) FROM ranked WHERE query_id = 1 AND place <= 50) GROUP BY 1 ORDER BY sum(p) DESC, doc_id LIMIT 10")
def rrf_fusion(spark, d):
    words = o.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").filter("item_id = 1"), "doc_id", {"text": 1.0}, "item_id", "text", k=50)
    return o.fuse([(_cosine(spark, d, 50), 1.0), (words, 0.5)]).withColumn("score", F.round("score", 8))


_EDGES = sorted({(r.from_table, r.to_table) for r in RELATIONS})


@add("WITH RECURSIVE e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + ") t(a, b)), pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT 'lineitem' AS node, 0 AS hops, 'lineitem' AS path UNION ALL SELECT b, hops + 1, path || '>' || b FROM walk JOIN pairs ON node = a WHERE hops < 6 AND strpos('>' || path || '>', '>' || b || '>') = 0), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS p FROM walk) SELECT node, hops, path FROM r WHERE p = 1")
def shortest_fk_path(spark, d):
    return shortest_paths(spark, spark.createDataFrame(_EDGES, "a string, b string"), "lineitem", 6)


_KEYED = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
_KEYS = [(t, c) for t, columns in _KEYED.items() for c in columns]
_RELATED = f"""
v AS ({" UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in _KEYS)}),
u AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) AS d, count(DISTINCT {c}) / count({c}) AS u FROM {t}" for t, c in _KEYS)}),
k AS (SELECT *, regexp_replace(regexp_replace(lower(c), '^[a-z]{{1,2}}_', ''), '(_?id|_?key)$', '') AS stem FROM u),
meet AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND a.t <> b.t GROUP BY ALL),
pairs AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, a.u AS u1, b.u AS u2, coalesce(n, 0) / a.d AS held, coalesce(n, 0) / b.d AS back FROM k a JOIN k b ON a.stem = b.stem AND a.stem <> '' AND a.t <> b.t LEFT JOIN meet ON meet.t1 = a.t AND meet.c1 = a.c AND meet.t2 = b.t AND meet.c2 = b.c),
fine AS (SELECT *, CASE WHEN u1 >= 0.95 THEN 'ONE_TO_ONE' ELSE 'MANY_TO_ONE' END AS kind, 50 + CASE WHEN u2 >= 1 THEN 25 ELSE 15 END + CASE WHEN levenshtein(c1, c2) <= 1 THEN 15 ELSE 5 END + CASE WHEN u1 < 0.95 THEN 10 ELSE 0 END AS score FROM pairs WHERE u2 >= 0.95 AND held >= 0.95 AND (u1 < 0.95 OR back < 0.95 OR t1 < t2)),
good AS (SELECT * FROM fine WHERE score >= 80)
"""


@add(f"WITH {_RELATED} SELECT t1 AS from_table_name, c1 AS from_column_name, t2 AS to_table_name, c2 AS to_column_name, kind AS cardinality, CAST(score AS INTEGER) AS score FROM good WHERE t1 IN (SELECT t1 FROM good GROUP BY t1 HAVING count(DISTINCT t2) <= 5)")
def relationship_discovery(spark, d):
    frames = {n: table(spark, d, n) for n in _KEYED}
    populated = None
    for n, df in frames.items():
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("populated")) for c in _KEYED[n]])
        one = df.agg(rows.alias("x")).select(F.lit(n).alias("table_name"), F.inline("x"))
        populated = one if populated is None else populated.unionByName(one)
    sizes, contained = o.key_values(frames, _KEYED)
    stats = sizes.join(populated, ["table_name", "column_name"]).select("table_name", "column_name", (F.col("distinct_values") / F.nullif(F.col("populated"), F.lit(0))).alias("uniqueness"))
    found = o.auto_trusted(o.relationship_candidates(catalog_columns(spark, frames).join(stats, ["table_name", "column_name"]), contained))
    return found.select("from_table_name", "from_column_name", "to_table_name", "to_column_name", "cardinality", "score")


@add("WITH a AS (SELECT DISTINCT lower(trim(CAST(l_suppkey AS VARCHAR))) AS v FROM lineitem), b AS (SELECT DISTINCT lower(trim(CAST(s_suppkey AS VARCHAR))) AS v FROM supplier WHERE s_acctbal > 0) SELECT round(count(b.v) / count(*), 3) AS containment FROM a LEFT JOIN b ON a.v = b.v")
def value_containment(spark, d):
    return o.value_overlap(table(spark, d, "lineitem"), "l_suppkey", table(spark, d, "supplier").filter("s_acctbal > 0"), "s_suppkey")


@add("SELECT c_nationkey, round(1 - exp(sum(ln(1 - least(0.5, greatest(0, c_acctbal) / 100000)))), 8) AS belief FROM customer GROUP BY 1")
def noisy_or_evidence(spark, d):
    c = F.least(F.lit(0.5), F.greatest(F.lit(0.0), F.col("c_acctbal")) / 100000)
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(o.noisy_or(c), 8).alias("belief"))


@add("WITH t AS (SELECT n_nationkey, n_name, list_distinct(list_transform(generate_series(1, length(n_name) - 1), lambda i: n_name[i:i+1])) AS g FROM nation) SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM t a JOIN t b ON a.n_nationkey < b.n_nationkey WHERE len(list_intersect(a.g, b.g)) > 0")
def name_similarity(spark, d):
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n_name") - 1), lambda i: F.substring("n_name", i, F.lit(2))))
    t = table(spark, d, "nation").select("n_nationkey", grams.alias("g"))
    pairs = t.select(F.col("n_nationkey").alias("a"), F.col("g").alias("ga"), F.explode("g").alias("x")).join(t.select(F.col("n_nationkey").alias("b"), F.col("g").alias("gb"), F.explode("g").alias("x")), "x").filter("a < b")
    return pairs.select("a", "b", "ga", "gb").distinct().select("a", "b", F.round(o.jaccard(F.col("ga"), F.col("gb")), 6).alias("similarity"))


@add()
def metadata_ranking(spark, d):
    """Scores of the catalog's columns for a question; the weights are the operator's own."""
    names = ("customer", "orders", "nation")
    return o.metadata_search(catalog_columns(spark, {n: table(spark, d, n) for n in names}), ["table_name", "column_name"], "orders custkey").select("table_name", "column_name", "score")
