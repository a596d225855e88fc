"""Building blocks shared by the operators: durable tables, skew-proof joins, sibling order.

``durable`` replaces lineage by a Parquet table in the folder that the session names in
``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs a re-read and
never a recomputation of the loop before it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_ROOTS: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. Without a setting a local session gets a temporary one; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="graphloom-"))
        base = _OWN_DIR[0]
    root = f"{base.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
        atexit.register(_remove_root, spark, root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_root(spark: SparkSession, root: str) -> None:
    try:
        _delete(spark, root)
    except Exception:  # the JVM may be gone already
        pass


class Durable:
    """A written table: ``df`` reads it, ``drop`` removes its files."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def durable(df: DataFrame, drop: tuple[Durable, ...] = ()) -> Durable:
    """Write ``df`` to the shared folder and read it back; then remove the tables in ``drop``."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = Durable(spark, path, df.schema)
    for old in drop:
        old.drop()
    return out


def stripped(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns an operator needs, so that extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def hot_keys(df: DataFrame, key: str, shares: int = 512) -> DataFrame:
    """Keys holding more than 1/shares of the rows of a written table: by counting, at most ``shares`` of them."""
    rows = df.count()
    return df.groupBy(key).count().where(F.col("count") > F.lit(max(10_000, rows // shares))).select(key)


def lookup(left: DataFrame, key: str, right: DataFrame, how: str = "left", shares: int = 512) -> DataFrame:
    """``left`` joined to ``right`` (unique on ``key``), with a plan of its own for hot keys.

    Keys that hold more than 1/shares of the left rows are at most ``shares`` many, so their right
    rows have a proven bound and are broadcast; all other keys go through the shuffled join.
    ``left`` should be a written table, since it is read for counting as well.
    """
    hot = [r[0] for r in hot_keys(left.where(F.col(key).isNotNull()), key, shares).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right, key, how))


def usable(column: Column) -> Column:
    """True for a number that is neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column)
