"""Operators between raw sources and records: addresses, findings with their code, outcomes of two runs, differences of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders of build products, and what stands for code that can't be shown.
BUILD_FOLDERS = [".next/", "build/", "dist/", "out/", "public/build/", "static/build/", "target/"]
SKIPPED, NO_FILE, NO_LINES = "[Build artifact - skipped]", "[File not found]", "[Line out of range]"


def slug_revision(path: Column) -> Column:
    """(``slug``, ``revision``) of an address's path: a last part of digits is the revision, without one it is 1; null stays null."""
    path = F.regexp_replace(path, "/+$", "")
    last = F.regexp_extract(path, r"/([0-9]+)$", 1)
    return F.when(path.isNotNull(), F.struct(F.regexp_replace(path, "/[0-9]+$", "").alias("slug"), F.when(last == "", F.lit(1)).otherwise(last.try_cast("long")).cast("long").alias("revision")))


def slow_id(name: Column) -> Column:
    """The number after ``slow_``: at the name's end, else of a script file, else the first one; null without any."""
    found = [F.regexp_extract(name, p, 1) for p in (r"(?:^|_)slow_([0-9]+)$", r"(?:^|/)slow_([0-9]+)\.js$", r"slow_([0-9]+)")]
    return F.coalesce(*[F.when(x != "", x.try_cast("long")) for x in found])


def hashed(record: Column) -> Column:
    """A map of texts with every text replaced by its SHA-256; a null map stays null."""
    return F.transform_values(record, lambda k, v: F.sha2(v, 256))


def code_lines(text: Column) -> Column:
    """The lines of a file; a line end at the end opens no further line, an empty or null file has none."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n", -1))


def with_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``findings`` (``file_path``, ``start_line``, ``end_line`` and more) with ``code_snippet``, their lines in ``files`` (``path``, ``value``; a path once).

    Findings in build folders find no file, so they take no part in the join's shuffle by path but for one null key, which
    the outer join leaves where it is.
    """
    built = F.lit(False)
    for folder in BUILD_FOLDERS:
        built = built | F.coalesce(F.startswith("file_path", F.lit(folder)), F.lit(False))
    left = findings.withColumn("_built", built).withColumn("_path", F.when(~F.col("_built"), F.ltrim("file_path", F.lit("/"))))
    right = files.select(F.col("path").alias("_path"), code_lines(F.col("value")).alias("_lines"))
    size = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    outside = (F.col("start_line") < 1) | (F.col("end_line") > F.size("_lines"))
    snippet = (
        F.when(F.col("_built"), SKIPPED)
        .when(F.col("_lines").isNull(), NO_FILE)
        .when(outside, NO_LINES)
        .otherwise(F.array_join(F.slice("_lines", F.greatest("start_line", F.lit(1)), size), "\n"))
    )
    return left.join(right, "_path", "left").withColumn("code_snippet", snippet).drop("_path", "_lines", "_built")


def single_difference(first: Column, second: Column, kind: str = "ExpressionStatement") -> Column:
    """(``prefix``, ``suffix``, ``comparable``) of two arrays of (``text``, ``type``): equal texts at the front, then at the
    back as far as they don't overlap; comparable if one statement is left on each side and both are of ``kind``.
    """
    shorter = F.least(F.size(first), F.size(second))

    def run(limit: Column, place) -> Column:
        same = lambda j: F.get(first, place(first, j))["text"].eqNullSafe(F.get(second, place(second, j))["text"])
        differ = F.filter(F.filter(F.sequence(F.lit(0), shorter), lambda j: j < limit), lambda j: ~same(j))
        return F.coalesce(F.get(differ, F.lit(0)), limit)

    def told(prefix: Column) -> Column:
        suffix = run(shorter - prefix, lambda side, j: F.size(side) - 1 - j)
        return F.get(F.transform(F.array(suffix), lambda s: F.struct(prefix.alias("prefix"), s.alias("suffix"), left_over(prefix, s).alias("comparable"))), F.lit(0))

    def left_over(prefix: Column, suffix: Column) -> Column:
        one = lambda side: (F.size(side) - prefix - suffix == 1) & F.coalesce(F.get(side, prefix)["type"] == kind, F.lit(False))
        return one(first) & one(second)

    return F.get(F.transform(F.array(run(shorter, lambda side, j: j)), told), F.lit(0))


def outcome_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys (each once a side, ``ok`` boolean) that succeed only after, and that are tried after but succeeded only before."""
    both = after.select(*keys, F.col("ok").alias("now")).join(before.select(*keys, F.col("ok").alias("was")), keys, "left")
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    return both.agg(F.count(F.when(now & ~was, 1)).alias("newly_successful"), F.count(F.when(was & ~now, 1)).alias("newly_broken"))


def involvement(results: DataFrame, members: str) -> DataFrame:
    """For every member of an array column ``members``: rows that hold it, repeats included, and successful ones (``ok``)."""
    return results.select(F.explode(members).alias("member"), "ok").groupBy("member").agg(F.count(F.lit(1)).alias("attempted"), F.count(F.when(F.col("ok"), 1)).alias("success"))
