"""Ranking: BM25 over weighted fields, exact cosine, reciprocal rank fusion, budgets, and relationship discovery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType

K1, B, FUSION = 1.5, 0.75, 60
#: Query terms, counted for each query that has them, that every task may hold; more are joined by a shuffle.
HELD_TERMS = 200_000
#: Documents of a block at most, and its scores (documents times queries).
BLOCK_DOCS, BLOCK_SCORES = 256, 1 << 20


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, fields: dict[str, float], query_id: str, query_text: str, k: int = 10, b: float = B) -> DataFrame:
    """query_id, doc_id, score, place: BM25 with smoothed idf, summed over weighted fields; ties by id.

    Scores are rounded to 9 places before they are ranked: copies of a text tie, in
    whatever order their parts were added.

    The queries' distinct terms are joined first, so only terms that are asked for
    are counted per document; lengths and document counts cover all documents. The
    parts of a document meet in one row and are added up for all queries at once;
    beyond HELD_TERMS they are joined to the queries by a shuffle.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(_terms(F.col(query_text)))).alias("term")).distinct()
    vocabulary = asked.select("term").distinct()
    held = asked.limit(HELD_TERMS + 1).collect()  # the queries' terms, few rows
    few = len(held) <= HELD_TERMS
    parts = []
    for name, weight in fields.items():
        own = docs.select(F.col(doc_id).alias("doc_id"), _terms(F.col(name)).alias("terms")).withColumn("length", F.size("terms"))
        size = own.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
        tf = own.filter("length > 0").select("doc_id", "length", F.explode("terms").alias("term")).join(F.broadcast(vocabulary) if few else vocabulary, "term", "left_semi").groupBy("doc_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        norm = F.col("tf") + K1 * (1 - b + b * F.col("length") / F.col("mean_length"))
        idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        scored = tf.join(F.broadcast(df) if few else df, "term").crossJoin(F.broadcast(size)).select("doc_id", "term", (weight * idf * F.col("tf") * (K1 + 1) / norm).alias("part"))  # one row of sizes
        parts.append(scored)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if few:
        kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema.fields, *every.schema.fields)}
        rows = every.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list("part").alias("parts"))  # neither is ever null
        return _first(rows.mapInArrow(_best_of_blocks([(r.query_id, r.term) for r in held], k, asked.schema["query_id"].dataType), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"), "query_id", k)
    score = asked.join(every, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return _first(score, "query_id", k)


def _best_of_blocks(asked: list[tuple], k: int, kind: DataType):
    """query_id, doc_id, score of documents (doc_id, terms, parts): of each block those among its k best of a query that the task's earlier blocks don't exclude, so no row is made for each document and query. Ties by id."""
    place = {q: n for n, q in enumerate(dict.fromkeys(q for q, _ in asked))}
    askers: dict[str, list[int]] = {}
    for q, term in asked:
        askers.setdefault(term, []).append(place[q])
    names, most = list(place), max(1, min(BLOCK_DOCS, BLOCK_SCORES // max(1, len(place))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = {t: np.array(q, dtype=np.int64) for t, q in askers.items()}
        named = to_arrow_type(kind)
        best = np.full((k, len(names)), -np.inf)  # each query's k highest scores so far
        for batch in batches:
            for lo in range(0, len(batch), most):
                part = batch.slice(lo, most)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                scores = np.full((len(part), len(names)), -np.inf)
                for n, (terms, parts) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    sets = [who[t] for t in terms]
                    at = np.concatenate(sets)
                    total = np.bincount(at, np.repeat(parts, [len(x) for x in sets]), len(names))
                    met = np.unique(at)
                    scores[n, met] = np.round(total[met], 9)
                first = np.argsort(-scores, axis=0, kind="stable")[:k]
                top = np.take_along_axis(scores, first, axis=0)
                row, query = np.nonzero((top >= best[-1]) & (top > -np.inf))
                best = -np.sort(-np.concatenate([best, top]), axis=0)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query.tolist()], named), part.column(0).take(pa.array(first[row, query])), pa.array(top[row, query])], names=["query_id", "doc_id", "score"])

    return run


def _first(scores: DataFrame, group: str, k: int) -> DataFrame:
    """The k highest scores of each group, ties by doc_id; each slice of a group is cut to k first, so no group meets whole in one task."""
    order = [F.desc("score"), F.col("doc_id")]
    part = F.row_number().over(Window.partitionBy(group, F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order))
    some = scores.withColumn("part", part).filter(f"part <= {k}").drop("part")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(f"place <= {k}")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector divided by its length; null if that is 0 or not finite."""
    length = F.sqrt(dot(v, v))
    fine = (length > 0) & ~F.isnan(length) & (length < float("inf"))
    return F.when(fine, F.transform(v, lambda x: x.cast("double") / length))


def cosine_top_k(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """doc_id, score, place of the vectors nearest to one query by cosine, ties by id; vectors of another length, of length 0 or not finite are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.size(vector_col) == len(query)).select(F.col(id_col).alias("doc_id"), dot(unit(F.col(vector_col)), unit(q)).alias("score")).filter("score is not null")
    best = rows.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # k rows


def fuse(rankings: list[tuple[DataFrame, float]], k: int = 10) -> DataFrame:
    """doc_id, score of rankings (doc_id, place) by the sum of weight / (60 + place); an absent document adds nothing."""
    every = None
    for df, weight in rankings:
        part = df.select("doc_id", (F.lit(weight) / (FUSION + F.col("place"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("doc_id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def pack_context(items: list[tuple[str, str]], budget: int) -> list[str]:
    """Texts in order of priority: the full text if it fits the characters left, else the compact one, else the item is skipped and the next tried."""
    out = []
    for full, compact in items:
        text = next((t for t in (full, compact) if t and len(t) <= budget), None)
        if text is not None:
            out.append(text)
            budget -= len(text)
    return out


# Weights of fields in metadata search, and bonuses.
FIELD_WEIGHTS = {"exact": 1.0, "prefix": 0.85, "contains": 0.5, "word": 0.75, "weak": 0.45}
PHRASE_BONUS, FIELDS_BONUS = 150, 25


def metadata_search(rows: DataFrame, fields: list[str], question: str, k: int = 20) -> DataFrame:
    """Rows with score: for each word and field 100 times a weight (equal, prefix, whole word, contained), a bonus for the phrase and for several fields."""
    words = [w for w in question.lower().split() if w]
    per_field = []
    for f in fields:
        low = F.lower(F.coalesce(F.col(f).cast("string"), F.lit("")))
        score = F.lit(0.0)
        for w in words:
            score += 100 * F.when(low == w, FIELD_WEIGHTS["exact"]).when(low.startswith(w), FIELD_WEIGHTS["prefix"]).when(F.array_contains(_terms(F.col(f)), w), FIELD_WEIGHTS["word"]).when(low.contains(w), FIELD_WEIGHTS["contains"]).otherwise(0.0)
        phrase = F.when(low.contains(" ".join(words)) & F.lit(len(words) > 1), PHRASE_BONUS).otherwise(0)
        per_field.append(score + phrase)
    hits = sum(F.when(s > 0, 1).otherwise(0) for s in per_field)
    total = sum(per_field[1:], per_field[0]) + F.when(hits > 1, FIELDS_BONUS).otherwise(0)
    return rows.withColumn("score", total).filter("score > 0").orderBy(F.desc("score"), *fields).limit(k)


def noisy_or(confidence: Column) -> Column:
    """The chance that at least one of the evidences holds, as an aggregate."""
    return 1 - F.exp(F.sum(F.ln(F.greatest(F.lit(1e-12), 1 - confidence))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def column_stem(name: Column) -> Column:
    """A key column's name without prefix and key suffix: o_custkey and c_custkey share cust."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^[a-z]{1,2}_", ""), r"(_?id|_?key)$", "")


#: Columns that one number tells apart.
BITS = 62


def key_values(frames: dict[str, DataFrame], keys: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(table_name, column_name, distinct_values) of the key columns, and their ``containments``, both from one pass.

    Each value of a stem is grouped once, with the columns that have it as bits of a
    number; equal numbers are counted. What goes to the driver is a row for each set of
    columns that some value has.
    """
    columns = [(t, c) for t in frames for c in keys[t]]
    whole = all(isinstance(frames[t].schema[c].dataType, IntegralType) for t, c in columns)
    values = None
    for name, df in frames.items():
        cells = [F.struct(F.lit(k).alias("place"), column_stem(F.lit(c)).alias("stem"), F.col(f"`{c}`").cast("bigint" if whole else "string").alias("v")) for k, (t, c) in enumerate(columns) if t == name]
        long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
        values = long if values is None else values.unionByName(long)
    words = range(-(-len(columns) // BITS))
    bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / BITS) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") % BITS))), F.lit(0)).alias(f"w{w}") for w in words]
    met = values.filter("v is not null").groupBy("stem", "v").agg(*bits).groupBy("stem", *[f"w{w}" for w in words]).agg(F.count(F.lit(1)).alias("n")).collect()
    size: dict[int, int] = {}
    both: dict[tuple[int, int], int] = {}
    for r in met:
        has = [k for k in range(len(columns)) if r[f"w{k // BITS}"] >> k % BITS & 1]
        for a in has:
            size[a] = size.get(a, 0) + r.n
            for b in has:
                if columns[a][0] != columns[b][0]:
                    both[a, b] = both.get((a, b), 0) + r.n
    spark = values.sparkSession
    sizes = spark.createDataFrame([(*columns[k], size.get(k, 0)) for k in range(len(columns))], "table_name string, column_name string, distinct_values bigint")
    names = "from_table_name string, from_column_name string, to_table_name string, to_column_name string, held double"
    return sizes, spark.createDataFrame([(*columns[a], *columns[b], n / size[a]) for (a, b), n in both.items()], names)


def containments(frames: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """from_table_name, from_column_name, to_table_name, to_column_name, held: the share of the first column's distinct values that the second has; pairs of equal stem in different tables that share a value."""
    return key_values(frames, keys)[1]


def relationship_candidates(columns: DataFrame, contained: DataFrame, least: float = 0.95) -> DataFrame:
    """Pairs of columns of equal stem and type in different tables, the unique side as the target, with a score from 0 to 100.

    ``columns``: table_name, column_name, logical_type, uniqueness; ``contained``: see
    ``containments``. The target must have the source's values: a small column whose few
    values happen to be unique is no target. Of two unique columns that hold each other's
    values the table first by name is the source.
    """
    keyed = columns.filter(F.lower("column_name").rlike("(id|key)$")).withColumn("stem", column_stem(F.col("column_name"))).filter("stem <> ''")
    side = lambda p: keyed.select("stem", "logical_type", *[F.col(c).alias(f"{p}_{c}") for c in ("table_name", "column_name", "uniqueness")])
    pairs = side("from").join(side("to"), ["stem", "logical_type"]).filter("from_table_name <> to_table_name and to_uniqueness >= 0.95")
    names = ["from_table_name", "from_column_name", "to_table_name", "to_column_name"]
    turned = contained.select(*[F.col(c).alias(n) for c, n in zip(names, [*names[2:], *names[:2]], strict=True)], F.col("held").alias("back"))
    pairs = pairs.join(contained.filter(F.col("held") >= least), names).join(turned, names, "left")
    pairs = pairs.filter(F.expr("from_uniqueness < 0.95 or from_table_name < to_table_name") | (F.coalesce("back", F.lit(0.0)) < least))
    score = F.lit(50) + F.when(F.col("to_uniqueness") >= 1.0, 25).otherwise(15) + F.when(F.levenshtein("from_column_name", "to_column_name") <= 1, 15).otherwise(5) + F.when(F.col("from_uniqueness") < 0.95, 10).otherwise(0)
    kind = F.when(F.col("from_uniqueness") >= 0.95, "ONE_TO_ONE").otherwise("MANY_TO_ONE")
    return pairs.select(*names, kind.alias("cardinality"), score.cast("int").alias("score"))


def auto_trusted(candidates: DataFrame, floor: int = 80, most_targets: int = 5) -> DataFrame:
    """Candidates of enough score, known cardinality, and at most 5 distinct targets of their source table."""
    fine = candidates.filter(f"score >= {floor} and cardinality not in ('MANY_TO_MANY', 'UNKNOWN')")
    targets = fine.groupBy("from_table_name").agg(F.count_distinct("to_table_name").alias("targets")).filter(f"targets <= {most_targets}")
    return fine.join(targets.select("from_table_name"), "from_table_name", "left_semi")


def value_overlap(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """containment: the share of a's distinct values (trimmed, lower case) that b has; null if either has none."""
    values = lambda df, c: df.select(F.lower(F.trim(F.col(c).cast("string"))).alias("v")).filter("v is not null").distinct()
    left, right = values(a, column_a), values(b, column_b).withColumn("hit", F.lit(1))
    some = right.limit(1).agg(F.count(F.lit(1)).alias("any"))
    return left.join(right, "v", "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("both")).crossJoin(some).select(F.when((F.col("n") > 0) & (F.col("any") > 0), F.round(F.col("both") / F.col("n"), 3)).alias("containment"))  # one row each
