"""Declarative tree patterns, compiled to joins over node tables.

A pattern is a nested dict: constraints on ``name``, ``value`` and ``text`` (absent or ``"*"``: any; a string; a list; ``{"regex": ...}``,
which searches), ``children`` (an ordered subsequence of the shown children, or with ``"children_mode": "exact"`` all of them one by one),
``match`` (``child`` or ``descendant``), ``optional``, and ``bind`` (nodes with one bind have equal source text).

The question is which nodes a pattern matches, not in how many ways, so a pattern node becomes a table of (node, texts bound below it).
Of the ways to match the children so far only the one that ends first matters for each node and binding: the children are joined one
after the other, and after each join an aggregate keeps the smallest place reached.  The tables stay as small as the matches, whatever
the number of ways.  An optional child never rules a match out and frees more texts than it binds, so it is left out.

Node tables have ``id``, ``side``, ``idx``, ``parent_idx``, ``subtree_end``, ``name``, ``value`` and ``text`` (source).
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SNIPPET = 1000
KEY = ["id", "side"]
#: Names of symbols that patterns skip by default.
IGNORED = ('"', "'", "(", ")", ",", ".", ";", "[", "]", "{", "}")


def load_patterns(text: str) -> list[dict]:
    """The patterns of a JSON file in order of their ids; each has its own ``ignore_names``, the file's, or the usual ones."""
    data = json.loads(text)
    usual = data.get("ignore_names", list(IGNORED))
    return sorted(({"ignore_names": usual, **p} for p in data["patterns"]), key=lambda p: p["id"])


def constraint(rule, actual: Column) -> Column:
    """One constraint as a predicate; an unknown form raises."""
    if rule is None or rule == "*":
        return F.lit(True)
    if isinstance(rule, str):
        return actual == rule
    if isinstance(rule, list):
        return actual.isin(*rule)
    if isinstance(rule, dict) and set(rule) == {"regex"}:
        return actual.rlike(rule["regex"])
    raise ValueError(f"unknown constraint {rule!r}")


def required_names(spec: dict) -> Counter:
    """How often each plain name occurs among the nodes that every match has."""
    name = spec.get("name")
    out = Counter([name] if isinstance(name, str) and name != "*" else [])
    for child in spec.get("children", []):
        if not child.get("optional"):
            out += required_names(child)
    return out


def candidates(nodes: DataFrame, spec: dict) -> DataFrame:
    """(``id``, ``side``) of the records that hold every required name.  Descendants of neighbouring children may be one node, so names are asked for once."""
    need = sorted(required_names(spec))
    if not need:
        return nodes.select(*KEY).distinct()
    return nodes.where(F.col("name").isin(*need)).groupBy(*KEY).agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(need)).select(*KEY)


def _own(nodes: DataFrame, spec: dict) -> DataFrame:
    """The nodes that meet a pattern node's own constraints, with the text that it binds."""
    keep = nodes
    for part in ("name", "value", "text"):
        if part in spec:
            keep = keep.where(constraint(spec[part], F.col(part)))
    bound = [F.col("text").alias(f"bind_{spec['bind']}")] if "bind" in spec else []
    return keep.select(*KEY, "idx", "parent_idx", "subtree_end", "place", "n_shown", *bound)


def _binds(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("bind_")]


def _matched(all_nodes: DataFrame, shown: DataFrame, spec: dict) -> DataFrame:
    """Nodes of ``all_nodes`` that match, one row for each way to bind texts."""
    children = spec.get("children", [])
    cur = _own(all_nodes, spec)
    exact = spec.get("children_mode") == "exact"
    if exact:
        cur = cur.where(F.col("n_shown") == len(children))
    cur = cur.withColumn("upto", F.col("idx"))
    for k, child in enumerate(children):
        if child.get("optional") and not exact:
            continue
        below = _matched(shown, shown, child)
        below = below.toDF(*[f"_{c}" for c in below.columns])
        on = (F.col("id") == F.col("_id")) & (F.col("side") == F.col("_side"))
        if exact:
            on = on & (F.col("_parent_idx") == F.col("idx")) & (F.col("_place") == k)
        elif child.get("match", "child") == "child":
            on = on & (F.col("_parent_idx") == F.col("idx")) & (F.col("_idx") > F.col("upto"))
        else:
            on = on & (F.col("_idx") > F.col("upto")) & (F.col("_idx") <= F.col("subtree_end"))
        have = _binds(cur)
        new = [c[1:] for c in below.columns if c.startswith("_bind_") and c[1:] not in have]
        for c in have:
            if f"_{c}" in below.columns:
                on = on & (F.col(c) == F.col(f"_{c}"))
        joined = cur.join(below, on).select(*[c for c in cur.columns if c != "upto"], *[F.col(f"_{c}").alias(c) for c in new], F.col("_idx").alias("reached"))
        cur = joined.groupBy(*[c for c in joined.columns if c != "reached"]).agg(F.min("reached").alias("upto"))
    return cur.drop("upto").distinct() if children else cur.drop("upto")


def find(nodes: DataFrame, spec: dict, ignored: tuple[str, ...] | list[str] = IGNORED) -> DataFrame:
    """(``id``, ``side``, ``idx``): every node at which the pattern matches, once."""
    hidden = F.col("name").isin(*ignored)
    siblings = W.partitionBy(*KEY, "parent_idx")
    place = nodes.where(~hidden).withColumn("place", F.row_number().over(siblings.orderBy("idx")) - 1)
    size = nodes.where(~hidden & (F.col("parent_idx") >= 0)).groupBy(*KEY, F.col("parent_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n_shown"))
    full = lambda df: df.join(size, [*KEY, "idx"], "left").withColumn("n_shown", F.coalesce("n_shown", F.lit(0)))
    return _matched(full(nodes.withColumn("place", F.lit(-1))), full(place), spec).select(*KEY, "idx").distinct()


def find_all(nodes: DataFrame, patterns: list[dict], limit: int = SNIPPET) -> DataFrame:
    """(``id``, ``side``, ``pattern_id``, ``idx``, ``begin``, ``end``, ``snippet``) of all patterns; records without a required name are left out first."""
    out = None
    for p in patterns:
        held = nodes.join(candidates(nodes, p["root"]), KEY, "left_semi")
        got = find(held, p["root"], p.get("ignore_names", IGNORED)).withColumn("pattern_id", F.lit(p["id"]))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no patterns")
    at = out.join(nodes.select(*KEY, "idx", "begin", "end", "text"), [*KEY, "idx"])
    return at.select(*KEY, "pattern_id", "idx", "begin", "end", F.substring("text", 1, limit).alias("snippet"))


def with_text(nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """``nodes`` with their source ``text``; ``codes``: (``id``, ``side``, ``code``)."""
    return nodes.join(codes, KEY).withColumn("text", F.substring("code", F.col("begin") + 1, F.col("end") - F.col("begin"))).drop("code")


def transitions(slow: DataFrame, fast: DataFrame) -> DataFrame:
    """(``id``, ``pattern_id``, ``slow_base``, ``slow_head``, ``fast_base``, ``fast_head``, ``transition``) of the records with a match.

    The slow form's head side is looked at only where its base side has it, the fast form's base side only where its head side has it.
    A transition has the slow form on the base side alone and the fast form on the head side alone.
    """
    flags = None
    for name, df in (("slow", slow), ("fast", fast)):
        per = df.groupBy("id", "pattern_id").agg(*[F.bool_or(F.col("side") == s).alias(f"{name}_{s}") for s in ("base", "head")])
        flags = per if flags is None else flags.join(per, ["id", "pattern_id"], "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    got = flags.select("id", "pattern_id", yes("slow_base").alias("slow_base"), (yes("slow_base") & yes("slow_head")).alias("slow_head"), (yes("fast_head") & yes("fast_base")).alias("fast_base"), yes("fast_head").alias("fast_head"))
    got = got.where("slow_base or fast_head")
    return got.withColumn("transition", F.expr("slow_base and not slow_head and fast_head and not fast_base"))


def cross_matches(nodes: DataFrame, patterns: list[dict]) -> DataFrame:
    """(``id``, ``pattern_id``, ``own``): which patterns match the reference record of which pattern; a record's ``id`` is its pattern's."""
    return find_all(nodes, patterns).select("id", "pattern_id").distinct().withColumn("own", F.col("id") == F.col("pattern_id"))
