"""Tables written to the folder that all executors and the driver share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Paths of the tables written and not yet released, by session.
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset and all runs on one machine (tests) a temporary one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # for release()
    _made.add(path)
    return out


def counted(df: DataFrame) -> int:
    """The number of rows of a materialised table, counted once (from the files' footers)."""
    if getattr(df, "_shared_rows", None) is None:
        df._shared_rows = df.count()
    return df._shared_rows


def small(df: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is; ``rows``: its number of rows, or an upper bound."""
    return F.broadcast(df) if (counted(df) if rows is None else rows) <= most else df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.discard(path)


def release(frames: Iterable[DataFrame]) -> None:
    """Delete materialised tables that no later result reads."""
    for df in frames:
        if (path := getattr(df, "_shared_path", None)) in _made:
            _delete(df.sparkSession, path)


def release_all(spark: SparkSession, keep: Iterable[DataFrame] = ()) -> None:
    """Delete all tables that operators wrote here, but ``keep``: to be called once their results have been written or read, since results are lazy and read them."""
    kept = {getattr(df, "_shared_path", None) for df in keep}
    for path in [p for p in _made if p not in kept]:
        _delete(spark, path)


def without(schema: T.StructType, names: Iterable[str]) -> T.StructType:
    gone = set(names)
    return T.StructType([f for f in schema.fields if f.name not in gone])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns with fixed types; other columns, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.items()])
