"""Intermediate tables that several steps read, written once below the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: rows that are dealt by record alone may be joined on the record and more, and buckets are read as such and in their order, and only what is marked is broadcast.
_LAYOUT = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def buckets(spark: SparkSession) -> int:
    """How many buckets tables are laid out in: so many that a bucket's rows are sorted in memory."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _layout(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _LAYOUT}
    for k, v in _LAYOUT.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def together(parts: list[DataFrame], by: str = "id") -> DataFrame:
    """The rows of all ``parts``, in the buckets by the column ``by`` that all lie in.

    Spark sees that they lie in the same ones only if the column is named anew in each.  Else every bucket is read by one task for each
    part, which each write a file, and what follows deals the rows again.
    """
    return reduce(DataFrame.unionByName, [p.withColumnRenamed(by, f"_{by}") for p in parts]).withColumnRenamed(f"_{by}", by)


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir`` and read back, so that later steps neither compute it again nor lose it with an executor.

    With ``by`` the rows lie in buckets of the first of these columns, in the order of all, so that what is stored next can join and
    group them by that column (and more) without dealing them again.  Their files are far smaller than the rows, so joins don't go by the
    files' size and never broadcast them.  A folder is only made where the session names none, as in tests on one machine.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="treeloom-"))
        root = spark.sparkContext.getCheckpointDir()
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/treeloom/{name}"
    if not by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    with _layout(spark):
        table = f"treeloom_{name.replace('-', '_')}"
        df.write.bucketBy(buckets(spark), by[0]).sortBy(*by).option("compression", "zstd").option("path", path).saveAsTable(table)
        return spark.table(table).hint("merge")
