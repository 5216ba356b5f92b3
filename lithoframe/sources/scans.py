"""Readers: Parquet tables, uploaded files, JDBC databases, bounded heads and samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# What an upload may be.
UPLOAD_EXTENSIONS = (".csv", ".xlsx", ".xls")
UPLOAD_BYTES = 25 * 1024 * 1024


class SourceRefused(ValueError):
    """A source that may not be read, with the reason."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def read_upload(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV or Excel file of at most 25 MB; types are inferred unless a schema is given."""
    lower = path.lower()
    if not lower.endswith(UPLOAD_EXTENSIONS):
        raise SourceRefused(f"unsupported extension: {path}")
    if _size(spark, path) > UPLOAD_BYTES:
        raise SourceRefused("the file is larger than 25 MB")
    if lower.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise SourceRefused("Excel files need openpyxl") from e
    return spark.createDataFrame(pd.read_excel(path))


@dataclass(frozen=True)
class Database:
    """A JDBC source; large tables are read in ``partitions`` ranges of ``partition_column``."""

    dialect: str
    host: str
    database: str
    port: int | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    timeout_s: int = 30

    # Default ports and drivers.
    _KINDS = {
        "mssql": (1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
        "postgresql": (5432, "org.postgresql.Driver"),
        "mysql": (3306, "com.mysql.cj.jdbc.Driver"),
    }

    def options(self) -> dict[str, str]:
        if self.dialect not in self._KINDS:
            raise SourceRefused(f"unknown database kind: {self.dialect}")
        port, driver = self._KINDS[self.dialect]
        at = f"{self.host}:{self.port or port}"
        url = f"jdbc:sqlserver://{at};databaseName={self.database}" if self.dialect == "mssql" else f"jdbc:{self.dialect}://{at}/{self.database}"
        out = {"url": url, "driver": driver, "queryTimeout": str(self.timeout_s)}
        return out | {k: v for k, v in (("user", self.user), ("password", self.password)) if v}

    def read(self, spark: SparkSession, name: str, partition_column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1) -> DataFrame:
        reader = spark.read.format("jdbc").options(**self.options()).option("dbtable", name)
        if partition_column and partitions > 1:
            reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
        return reader.load()


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows as text, nulls as the empty string."""
    return df.limit(n).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def sample_rows(df: DataFrame, percent: float, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows of about ``percent`` per cent of the rows, chosen by a hash of ``keys``: the same rows each time. If so few rows are drawn that none is left, all rows count."""
    place = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000))
    drawn = df.withColumn("__place", place).withColumn("__in", F.col("__place") < F.lit(int(percent * 10_000)))
    order = [F.desc("__in"), F.col("__place"), *map(F.col, keys)]
    some = drawn.filter("__in").limit(1).count() > 0
    return (drawn.filter("__in") if some else drawn).orderBy(*order).limit(n).drop("__place", "__in")
