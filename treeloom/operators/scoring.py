"""Set-based recall and precision of clusters against ground truth, and rollups of statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import f1, ratio


def cluster_metrics(members: DataFrame, truth: DataFrame, min_size: int = 1) -> DataFrame:
    """Per target: clusters that hold a true id, recall of their union and of the best one, precision of the union.

    ``members``: (``key``, ``cluster``); ``truth``: (``target``, ``key``).
    """
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    held = members.join(size, "cluster")
    hits = truth.join(held, "key").groupBy("target", "cluster", "size").agg(F.count(F.lit(1)).alias("hits"))
    total = truth.groupBy("target").agg(F.count(F.lit(1)).alias("n_truth"))
    per = hits.groupBy("target").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("hits").alias("covered"), F.max("hits").alias("best"), F.sum("size").alias("union_size"), F.count_if(F.col("hits") == F.col("size")).alias("n_pure"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = total.join(per, "target", "left").select("target", "n_truth", z("n_clusters").alias("n_clusters"), z("n_pure").alias("n_pure"), z("covered").alias("covered"), ratio(z("covered"), F.col("n_truth")).alias("r_union"), ratio(z("best"), F.col("n_truth")).alias("r_max"), ratio(z("covered"), z("union_size")).alias("p_union"))
    return out.withColumn("f1_union", f1(F.col("p_union"), F.col("r_union")))


def recall_precision(results: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Recall, precision and F1 of id sets per group; empty denominators give 0."""
    r, t = results.select(*keys, "key").distinct().withColumn("r", F.lit(1)), truth.select(*keys, "key").distinct().withColumn("t", F.lit(1))
    both = r.join(t, [*keys, "key"], "full").groupBy(*keys).agg(F.count("r").alias("n_result"), F.count("t").alias("n_truth"), F.count_if(F.col("r").isNotNull() & F.col("t").isNotNull()).alias("n_both"))
    both = both.withColumn("recall", ratio(F.col("n_both"), F.col("n_truth"))).withColumn("precision", ratio(F.col("n_both"), F.col("n_result")))
    return both.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def unknown_clusters(members: DataFrame, known: DataFrame, top_k: int) -> DataFrame:
    """The largest clusters without any known id."""
    bad = members.join(known.select("key").distinct(), "key", "left_semi").select("cluster").distinct()
    return members.join(bad, "cluster", "left_anti").groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster").limit(top_k)


def _positions(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``rows`` with ``pos``: places from 0 in each group of ``keys`` by ``order`` (hex digits), without a window over a whole group.

    Rows are numbered inside buckets of the order's first three digits, of which there are 4,096, after the sizes of the buckets before.
    """
    df = rows.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, 3))
    size = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = size.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("_order")) - 1
    return df.withColumn("_k", inside).join(offset, [*keys, "_bucket"]).withColumn("pos", F.col("_k") + F.col("_before")).drop("_order", "_bucket", "_k", "_before")


def permuted(members: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(``iteration``, ``key``, ``cluster``): random memberships with the same cluster sizes, ids shuffled over the whole table by a seeded digest."""
    shuffle = members.select("key", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    ids = _positions(shuffle, ["iteration"], F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("iteration").cast("string"), F.col("key").cast("string"))))
    cells = _positions(members.withColumn("_all", F.lit(0)), ["_all"], F.md5(F.col("key").cast("string"))).select("cluster", "pos")
    return ids.join(cells, "pos").select("iteration", "key", "cluster")


def permutation_scores(members: DataFrame, truth: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(``target``, ``iteration``, and the columns of :func:`cluster_metrics`) of shuffled memberships."""
    tag = lambda c: F.concat_ws(":", F.col("iteration").cast("string"), F.col(c).cast("string"))
    shuffled = permuted(members, iterations, seed).select(tag("key").alias("key"), tag("cluster").alias("cluster"))
    wanted = truth.select("key", "target", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration")).select(tag("target").alias("target"), tag("key").alias("key"))
    got = cluster_metrics(shuffled, wanted)
    return got.withColumn("iteration", F.substring_index("target", ":", 1).cast("int")).withColumn("target", F.expr("substring(target, length(substring_index(target, ':', 1)) + 2)"))


def dispatch(tests: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Where a group's tests run: the first environment in which all succeed; tests without any success are dropped; fewer than two left are no pair."""
    any_ok = F.lit(False)
    for f in flags:
        any_ok = any_ok | F.coalesce(F.col(f), F.lit(False))
    kept = F.count_if(any_ok)
    env: Column = F.lit("mixed_env")
    for f in reversed(flags):
        env = F.when(F.count_if(any_ok & ~F.coalesce(F.col(f), F.lit(False))) == 0, F.lit(f)).otherwise(env)
    return tests.groupBy(group).agg(kept.alias("n_kept"), F.when(kept < 2, "insufficient_pair").otherwise(env).alias("env"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: later records replace earlier ones."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def judge(pairs: DataFrame) -> DataFrame:
    """``verdict`` (step and reason) of every pair (``fast``, ``slow``: text): empty or identical, values, else different.

    Of the survey's EQ7 only steps 0 and 2 are built.  Step 1 hashes the same texts that step 0 found unequal, so it is
    never given, and there is no step for completion values: the rest is ``step3:different``.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    words = lambda c: F.array_sort(F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+")))
    common = F.size(F.array_intersect(words("fast"), words("slow")))
    verdict = (
        F.when(blank("fast") | blank("slow"), "step0:empty")
        .when(F.col("fast") == F.col("slow"), "step0:identical")
        .when(F.sha2("fast", 256) == F.sha2("slow", 256), "step1:same_output")
        .when(words("fast") == words("slow"), "step2:same_values")
        .when(common == 0, "step2:no_common_value")
        .otherwise("step3:different")
    )
    return pairs.withColumn("verdict", verdict)
