"""A training-corpus pipeline: each stage calls one operator of ``lithoframe.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads
back as the next stage's documents; what a stage wrote on its way is then deleted. All
stages but the last return the columns of documents.

Columns that clash or are too many are left behind by the first step of every stage. A
null text is an empty one to every stage: it is judged by its other statistics, is no
copy, holds no window and no secret, and has no tokens; the last stage's ids are then
empty. A null id is kept like any other, rows that repeat are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.decontamination import contamination
from lithoframe.llm.near_dedup import one_of_each
from lithoframe.llm.piece_viterbi import encode
from lithoframe.llm.quality import fit_quality, quality_scores
from lithoframe.llm.queries import model_path
from lithoframe.llm.secret_scan import redact, secret_findings
from lithoframe.llm.shared import materialize, release_all, table

#: Columns of documents, with their types.
COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in COLUMNS.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose chance of label 1 is at least 0.3."""
    docs = _documents(docs)
    machine = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, machine).filter("score >= 0.3").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of least id, of each group of near copies (five words, similarity 0.8)."""
    return one_of_each(_documents(docs), n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of ten words of a benchmark item."""
    return contamination(_documents(docs), table(spark, sf_dir, "benchmark"), size=10).filter(F.size("hit_spans") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret found; no document goes."""
    found = secret_findings(_documents(docs))
    clean = redact(F.col("text"), F.col("findings"))
    return found.select("doc_id", clean.alias("text"), "lang", "source", F.when(F.size("findings") > 0, F.length(clean).cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; check that decoding gives it back."""
    coded = encode(_documents(docs), model_path(), carry=["doc_id", "lang", "source"], check=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("sentencepiece", sentencepiece)]

#: SQL can't express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release_all(spark, keep=[docs])
    return docs
