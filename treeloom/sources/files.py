"""File sources and sinks.  Every reader takes a schema, so nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole JSON documents (arrays of records or one object); ingest once and go on with Parquet."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, n_columns: int) -> DataFrame:
    """Rows of strings; the first line is a row too."""
    return spark.read.schema(", ".join(f"c{k} string" for k in range(n_columns))).csv(path, header=False)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``path`` and ``value``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines, sorted by range, so that the files in name order are sorted."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str, by: list[str]) -> None:
    """``value`` as text files, one folder for each combination of ``by``."""
    df.select(*by, "value").repartition(*by).write.mode("overwrite").partitionBy(*by).text(path)


def merge_shards(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """One table of all shards; a key in two of them is an error."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    twice = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("shards overlap")
    return out


def write_scopes(df: DataFrame, path: str, by: str = "scope") -> None:
    """One pass, one folder for each scope."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


#: The part of a SARIF report that findings need.
SARIF = "version string, runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int,startColumn:int,endColumn:int,snippet:struct<text:string>>>>>>>>>"


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the first run of each SARIF report at their first location, with decoded paths; ``id`` is the place among the run's results.  Results without a region are left out."""
    results = read_json(spark, path, SARIF).select(F.posexplode(F.get("runs", F.lit(0))["results"]).alias("id", "x"))
    first = F.get("x.locations", F.lit(0))["physicalLocation"]
    df = results.select("id", "x.*", first.alias("l")).where("l.region is not null")
    return df.select(
        "id",
        F.col("ruleId").alias("rule_id"),
        F.url_decode(F.replace("l.artifactLocation.uri", F.lit("+"), F.lit("%2B"))).alias("file_path"),
        F.col("l.region.startLine").alias("start_line"),
        F.coalesce("l.region.endLine", "l.region.startLine").alias("end_line"),
        F.col("l.region.startColumn").alias("start_column"),
        F.col("l.region.endColumn").alias("end_column"),
        F.col("message.text").alias("message"),
        F.coalesce("level", F.lit("warning")).alias("severity"),
        F.col("l.region.snippet.text").alias("code_snippet"),
    )
