"""The eight logical types, the catalog as a DataFrame, and schema fingerprints."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The logical type of each raw type name.
LOGICAL_TYPES = {
    "int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "integer": "INTEGER",
    "decimal": "DECIMAL", "numeric": "DECIMAL", "float": "DECIMAL", "real": "DECIMAL", "money": "DECIMAL", "smallmoney": "DECIMAL", "double precision": "DECIMAL", "double": "DECIMAL",
    "char": "TEXT", "varchar": "TEXT", "nchar": "TEXT", "nvarchar": "TEXT", "text": "TEXT", "ntext": "TEXT", "sysname": "TEXT", "uniqueidentifier": "TEXT", "character varying": "TEXT", "character": "TEXT", "clob": "TEXT", "tinytext": "TEXT", "mediumtext": "TEXT", "longtext": "TEXT",
    "date": "DATETIME", "datetime": "DATETIME", "datetime2": "DATETIME", "datetimeoffset": "DATETIME", "smalldatetime": "DATETIME", "time": "DATETIME", "timestamp": "DATETIME", "timestamp without time zone": "DATETIME", "timestamp with time zone": "DATETIME", "interval": "DATETIME",
    "bit": "BOOLEAN", "bool": "BOOLEAN", "boolean": "BOOLEAN",
    "binary": "BINARY", "varbinary": "BINARY", "image": "BINARY", "bytea": "BINARY", "blob": "BINARY", "tinyblob": "BINARY", "mediumblob": "BINARY", "longblob": "BINARY",
    "xml": "JSON", "json": "JSON", "jsonb": "JSON",
}
#: Spark's own names beside them.
SPARK_TYPES = {"string": "TEXT", "timestamp_ntz": "DATETIME", "variant": "JSON"}
_LOGICAL = LOGICAL_TYPES | SPARK_TYPES


def logical_type(raw: str | T.DataType | None) -> str:
    """INTEGER, DECIMAL, TEXT, DATETIME, BOOLEAN, BINARY, JSON or OTHER; sizes in brackets don't matter."""
    name = re.sub(r"\s+", " ", re.sub(r"\(.*?\)", "", raw.simpleString() if isinstance(raw, T.DataType) else (raw or ""))).strip().lower()
    return _LOGICAL.get(name) or _LOGICAL.get(name.split(" ")[0], "OTHER")


def fingerprint(schema: T.StructType) -> str:
    """sha256 of the schema in a canonical order, so that column order doesn't matter."""
    fields = sorted((f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields)
    return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


CATALOG_SCHEMA = "table_name string, column_name string, position int, raw_type string, logical_type string, nullable boolean"


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A row per column of the tables."""
    rows = [(name, f.name, k, f.dataType.simpleString(), logical_type(f.dataType), f.nullable) for name, df in sorted(tables.items()) for k, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def discover(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The same for all tables and views of the session's catalog."""
    names = [t.name for t in spark.catalog.listTables(database) if t.name]
    return catalog_columns(spark, {n: spark.table(n if database is None else f"{database}.{n}") for n in names})
