"""Choosing among the nested scopes of a cut: candidates, a search in the source, and a score of size and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["id", "side"]
#: Scopes from small to large, and what makes a lone token tell nothing.
SCOPES = ("Diff", "Brother", "ExParent", "Parent")
TRIVIAL_NAMES = ("escape_sequence", "number", "string_fragment")
TRIVIAL_VALUES = ('"', "'", "(", ")", "*", "+", ",", "-", "/", ";", "[", '\\"', "]", "{", "}")
TRIVIAL_PREFIXES = ("FUNCTION_", "KEY_", "VAR_")


def trivial(name: Column, value: Column) -> Column:
    """A token that by itself tells nothing: a literal, a renamed identifier, a symbol or a blank."""
    out = name.isin(*TRIVIAL_NAMES) | value.isin(*TRIVIAL_VALUES) | (F.trim(value) == "")
    for p in TRIVIAL_PREFIXES:
        out = out | value.startswith(p)
    return out


def token_regex(values: Column) -> Column:
    """Tokens in order with any white space between, as a regular expression; null without tokens."""
    quoted = F.transform(F.filter(values, lambda v: F.trim(v) != ""), lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, "\\s*"))


def candidates(nodes: DataFrame, cut: DataFrame) -> DataFrame:
    """(``id``, ``side``, ``scope``, ``place``, ``nodes``, ``tokens``): each scope's nodes in order and the values of its terminals.

    ``cut``: (``id``, ``side``, ``scope``, ``idx``).  Lone trivial tokens are left out; of scopes with the same nodes the smallest stays.
    """
    leaf = F.col("subtree_end") == F.col("idx")
    at = cut.select(*KEY, "scope", "idx").distinct().join(nodes.select(*KEY, "idx", "subtree_end", "name", "value"), [*KEY, "idx"])
    got = at.groupBy(*KEY, "scope").agg(F.array_sort(F.collect_list("idx")).alias("nodes"), F.array_sort(F.collect_list(F.when(leaf, F.struct("idx", "name", "value")))).alias("ends"))
    first = F.get("ends", F.lit(0))
    got = got.where(~((F.size("ends") == 1) & F.coalesce(trivial(first["name"], first["value"]), F.lit(False))))
    place = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")).cast("int")
    one = got.withColumn("place", place).groupBy(*KEY, "nodes").agg(F.min(F.struct("place", "scope", "ends")).alias("first"))
    return one.select(*KEY, "first.scope", "first.place", "nodes", F.transform("first.ends", lambda e: e["value"]).alias("tokens"))


def with_search(cands: DataFrame, codes: DataFrame) -> DataFrame:
    """``cands`` with ``regex`` and ``found``: whether the source has the tokens one after the other."""
    return cands.withColumn("regex", token_regex(F.col("tokens"))).join(codes, KEY).withColumn("found", F.coalesce(F.regexp_like("code", "regex"), F.lit(False))).drop("code")


def scored(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cands`` with ``diff_ratio``, ``completeness`` and ``score`` (their harmonic mean).

    The changed nodes are those of the Diff candidate, or of the smallest one where that fell out.  Completeness: the mean over the
    changed nodes' parents of the share of their children that the scope holds.
    """
    base = cands.groupBy(*KEY).agg(F.min(F.struct((F.col("scope") != "Diff").alias("other"), F.size("nodes").alias("n"), "place", "nodes")).alias("b")).select(*KEY, F.col("b.nodes").alias("diff"))
    up = base.select(*KEY, F.explode("diff").alias("idx")).join(nodes.select(*KEY, "idx", "parent_idx"), [*KEY, "idx"]).where("parent_idx >= 0").select(*KEY, "parent_idx").distinct()
    children = nodes.join(up, [*KEY, "parent_idx"], "left_semi").select(*KEY, "parent_idx", F.col("idx").alias("child"))
    held = children.join(cands.select(*KEY, "place", "nodes"), KEY).groupBy(*KEY, "place", "parent_idx").agg((F.count_if(F.array_contains("nodes", F.col("child"))) / F.count(F.lit(1))).alias("share"))
    complete = held.groupBy(*KEY, "place").agg(F.avg("share").alias("completeness"))
    got = cands.join(base, KEY).withColumn("diff_ratio", F.size("diff") / F.size("nodes")).drop("diff").join(complete, [*KEY, "place"], "left").withColumn("completeness", F.coalesce("completeness", F.lit(0.0)))
    total = F.col("diff_ratio") + F.col("completeness")
    return got.withColumn("score", F.when(total > 0, 2 * F.col("diff_ratio") * F.col("completeness") / total).otherwise(0.0))


def best_scope(found: DataFrame) -> DataFrame:
    """(``id``, ``side``, ``scope``, ``score``): of the candidates that the source has, the one with the highest score; the smaller scope wins ties."""
    best = found.where("found").groupBy(*KEY).agg(F.max(F.struct(F.round("score", 12).alias("score"), (-F.col("place")).alias("place"), "scope")).alias("b"))
    return best.select(*KEY, "b.scope", "b.score")
