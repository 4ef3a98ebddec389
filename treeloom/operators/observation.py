"""Comparing what two programs were observed to do: outputs, variables, completion values, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of an output that are kept.
HEAD = 2000


def observed(stream: Column) -> Column:
    """Digest, size and beginning of an output."""
    return F.struct(F.sha2(stream, 256).alias("sha256"), F.octet_length(stream).cast("long").alias("bytes"), F.left(stream, F.lit(HEAD)).alias("head"))


def hashed(record: Column) -> Column:
    """A map with every value's digest in its place; null stays null."""
    return F.transform_values(record, lambda _, v: F.sha2(v, 256))


def output_reason(fast: str, slow: str, exit_code: bool = True) -> Column:
    """Why two observations (structs ``status``, ``exit_code``, ``stdout``, ``stderr``) differ, null if they don't; the first reason counts.  Pages have no exit code."""
    a, b = F.col(fast), F.col(slow)
    out = F.when((a["status"] != "success") | (b["status"] != "success"), "verification_failed")
    if exit_code:
        out = out.when(~a["exit_code"].eqNullSafe(b["exit_code"]), "exit_status_mismatch")
    return out.when(a["stdout"]["sha256"] != b["stdout"]["sha256"], "stdout_mismatch").when(a["stderr"]["sha256"] != b["stderr"]["sha256"], "stderr_mismatch")


def record_differs(a: Column, b: Column) -> Column:
    """Do two records (``s``: digest of the string form, ``v``: of the value, null if there's none) differ?"""
    return (a["s"] != b["s"]) | F.coalesce(a["v"] != b["v"], F.lit(False))


def values_reason(fast: Column, slow: Column) -> Column:
    """``verification_failed`` if either map of variables is missing, ``variable_mismatch`` if a common one differs, else null."""
    return F.when(fast.isNull() | slow.isNull(), "verification_failed").when(F.size(mismatched(fast, slow)) > 0, "variable_mismatch")


def mismatched(fast: Column, slow: Column) -> Column:
    """Names of the common variables that differ, in order."""
    common = F.array_sort(F.array_intersect(F.map_keys(fast), F.map_keys(slow)))
    return F.filter(common, lambda k: record_differs(F.try_element_at(fast, k), F.try_element_at(slow, k)))


def completion_reason(fast: Column, slow: Column, comparable: Column) -> Column:
    """``completion_value_mismatch`` or null; what can't be compared, or wasn't observed, counts as equal."""
    return F.when(comparable & fast.isNotNull() & slow.isNotNull() & record_differs(fast, slow), "completion_value_mismatch")


def dom_reason(fast: Column, slow: Column) -> Column:
    return F.when(~fast.eqNullSafe(slow), "dom_mismatch")


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``step`` and ``reason`` (null: equivalent) by stages: texts, outputs, variables, completion.

    Columns: ``fast_code``, ``slow_code``, ``determinized``, ``fast`` and ``slow`` (observed outputs), ``fast_values``, ``slow_values``,
    ``fast_completion``, ``slow_completion``, ``comparable``.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    zero = F.when(blank("fast_code") | blank("slow_code"), "empty").when(F.col("fast_code") == F.col("slow_code"), "identical").when(~F.col("determinized"), "undeterminizable")
    stages = [zero, output_reason("fast", "slow"), values_reason(F.col("fast_values"), F.col("slow_values")), completion_reason(F.col("fast_completion"), F.col("slow_completion"), F.col("comparable"))]
    at = F.coalesce(*[F.when(r.isNotNull(), F.struct(F.lit(k).alias("step"), r.alias("reason"))) for k, r in enumerate(stages)])
    return pairs.withColumn("verdict", at).withColumns({"step": F.col("verdict.step"), "reason": F.col("verdict.reason")}).drop("verdict")


def console_stream(kind: Column, n_args: Column) -> Column:
    """Where a console message goes: nowhere without arguments, errors and warnings to ``stderr``, others to ``stdout``."""
    return F.when(n_args > 0, F.when(kind.isin("assert", "error", "trace", "warning"), "stderr").otherwise("stdout"))


def last_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each page's attempts (``attempt``, ``failed``) the first that didn't fail, else the last."""
    order = W.partitionBy(*keys).orderBy(F.col("failed"), F.when(F.col("failed"), -F.col("attempt")).otherwise(F.col("attempt")))
    return attempts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sample_report(samples: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Mean, median and sample deviation of both sides, with the effect's size."""
    from .statistics import effect_size, rank_sums

    stats = samples.groupBy(*keys, side).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("sd"))
    one = lambda k: stats.where(F.col(side) == k).select(*keys, *[F.col(c).alias(f"{c}{k}") for c in ("mean", "median", "sd")])
    r = rank_sums(samples, keys, side, value)
    return one(0).join(one(1), keys).join(r.select(*keys, "n0", "n1", "u", "cliff_delta", effect_size().alias("effect")), keys)
