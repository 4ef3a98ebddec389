"""Generalisation of clusters of trees.

:func:`anti_unify` works on node tables: a node's address is the list of child places from the root, so nodes of different trees meet in
one aggregate by (cluster, address).  :func:`skeletons` folds the trees of a cluster by aligning children on names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reattached(cut: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cut`` (``id``, ``side``, ``idx``) with ``up``: the nearest ancestor that the cut holds, -1 without one."""
    key = ["id", "side"]
    at = cut.join(nodes.select(*key, "idx", "subtree_end"), [*key, "idx"])
    up = at.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("idx").alias("_up"), F.col("subtree_end").alias("_end"))
    near = at.join(up, (F.col("id") == F.col("_id")) & (F.col("side") == F.col("_side")) & (F.col("idx") > F.col("_up")) & (F.col("idx") <= F.col("_end")), "left")
    return near.groupBy(*key, "idx").agg(F.coalesce(F.max("_up"), F.lit(-1)).alias("up"))


def addressed(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` with ``address``: the places among siblings from the root down, joined by dots; ``depth`` is the tables' largest depth."""
    key = ["id", "side"]
    place = nodes.withColumn("place", F.row_number().over(W.partitionBy(*key, "parent_idx").orderBy("idx")) - 1)
    done = place.where("parent_idx < 0").select(*key, "idx", F.lit("0").alias("address"))
    level = done
    for _ in range(depth):
        level = place.select(*key, "idx", "parent_idx", "place").join(level.select(*key, F.col("idx").alias("parent_idx"), F.col("address").alias("above")), [*key, "parent_idx"]).select(*key, "idx", F.concat_ws(".", "above", F.lpad(F.col("place").cast("string"), 5, "0")).alias("address"))
        done = done.unionByName(level)
    return nodes.join(done, [*key, "idx"])


def anti_unify(trees: DataFrame) -> DataFrame:
    """(``cluster``, ``address``, ``kind``, ``name``, ``value``): the least general tree of every cluster, by child places.

    ``trees``: (``cluster``, ``tree``, ``address``, ``name``, ``value``).  A place that all trees have is ``concrete``, a ``value_hole``
    where only names agree, a ``node_hole`` where they don't (what lies below is gone).  Where some trees have fewer children, the first
    missing place is a ``tail_hole``, and later ones are gone.
    """
    size = trees.groupBy("cluster").agg(F.count_distinct("tree").alias("n_trees"))
    at = trees.groupBy("cluster", "address").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.max("name").alias("name2"), F.min("value").alias("value"), F.max("value").alias("value2")).join(size, "cluster")
    kind = F.when(F.col("n") < F.col("n_trees"), "tail_hole").when(F.col("name") != F.col("name2"), "node_hole").when(F.col("value") != F.col("value2"), "value_hole").otherwise("concrete")
    at = at.withColumn("kind", kind).withColumn("parent", F.regexp_replace("address", r"\.?[0-9]+$", ""))
    # of the places that some trees lack, only the first below a parent is told
    first = at.where("kind = 'tail_hole'").groupBy("cluster", "parent").agg(F.min("address").alias("first"))
    at = at.join(first, ["cluster", "parent"], "left").where("kind <> 'tail_hole' or address = first")
    holes = at.where("kind in ('tail_hole', 'node_hole')").select(F.col("cluster").alias("_c"), F.col("address").alias("_a"))
    kept = at.join(holes, (F.col("cluster") == F.col("_c")) & F.col("address").startswith(F.concat("_a", F.lit("."))), "left_anti")
    named = F.col("kind").isin("concrete", "value_hole")
    return kept.select("cluster", "address", "kind", F.when(named, F.col("name")).alias("name"), F.when(F.col("kind") == "concrete", F.col("value")).alias("value"))


def anti_unify_anchored(trees: DataFrame) -> DataFrame:
    """:func:`anti_unify` below the best common node: (``cluster``, ``anchor``, ``address``, ``kind``, ``name``, ``value``).

    Every name that all trees of a cluster have is tried, each tree giving its largest subtree of that name (the first among equals); the
    result with the most concrete places stays, the first name in order among equals.  ``trees`` also has ``idx`` and ``subtree_end``.
    """
    size = trees.groupBy("cluster").agg(F.count_distinct("tree").alias("n"))
    largest = trees.groupBy("cluster", "tree", "name").agg(F.max(F.struct((F.col("subtree_end") - F.col("idx")).alias("size"), (-F.col("idx")).alias("first"), "address", "subtree_end")).alias("x"))
    common = largest.groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("have")).join(size, "cluster").where("have = n").select("cluster", "name")
    tops = largest.join(common, ["cluster", "name"]).select(F.col("cluster").alias("_c"), F.col("tree").alias("_t"), F.col("name").alias("anchor"), (-F.col("x.first")).alias("lo"), F.col("x.subtree_end").alias("hi"), F.col("x.address").alias("above"))
    below = trees.join(tops, (F.col("cluster") == F.col("_c")) & (F.col("tree") == F.col("_t")) & F.col("idx").between(F.col("lo"), F.col("hi")))
    rooted = below.select(F.to_json(F.struct("cluster", "anchor")).alias("cluster"), "tree", F.concat(F.lit("0"), F.expr("substring(address, length(above) + 1)")).alias("address"), "name", "value")
    got = anti_unify(rooted).withColumn("at", F.from_json("cluster", "cluster string, anchor string")).select("at.cluster", "at.anchor", "address", "kind", "name", "value")
    score = got.groupBy("cluster", "anchor").agg(F.count_if(F.col("kind") == "concrete").alias("concrete"))
    best = score.groupBy("cluster").agg(F.min(F.struct((-F.col("concrete")).alias("less"), "anchor")).alias("b")).select("cluster", F.col("b.anchor").alias("anchor"))
    return got.join(best, ["cluster", "anchor"]).select("cluster", "anchor", "address", "kind", "name", "value")


def alignment(left: list, right: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; where several are longest, the one that passes over the left side's items first."""
    a, b = np.array(left, object), np.array(right, object)
    rows = [np.zeros(len(b) + 1, np.int64)]  # from the end of ``left``: the length reachable from each place of ``right``
    for item in a[::-1]:
        hit = np.append(b == item, False)
        longer = np.where(hit, np.append(rows[-1][1:], 0) + 1, rows[-1])
        rows.append(np.maximum.accumulate(longer[::-1])[::-1])
    rows.reverse()
    pairs, j = [], 0
    for i in range(len(a)):
        if rows[i][j] == rows[i + 1][j] and not (j < len(b) and b[j] == a[i] and rows[i][j] == rows[i + 1][j + 1] + 1):
            continue  # nothing is lost without this item
        while not (b[j] == a[i] and rows[i][j] == rows[i + 1][j + 1] + 1):
            j += 1
        pairs.append((i, j))
        j += 1
    return pairs


class Merged:
    """One node of a folded cluster: its name, the values met, its children."""

    def __init__(self, name: str, values: list[str], children: list[Merged]):
        self.name, self.values, self.children = name, values, children

    def absorb(self, other: Merged) -> Merged:
        """What both have: children are aligned by name, the others go."""
        pairs = alignment([c.name for c in self.children], [c.name for c in other.children])
        return Merged(self.name, self.values + other.values, [self.children[i].absorb(other.children[j]) for i, j in pairs])

    def rows(self, address: str = "0") -> Iterator[tuple[str, str, str | None, int]]:
        """(address, name, the value that more than half have, number of values)."""
        counts = pd.Series(self.values).value_counts()
        top = min(counts.index[counts == counts.max()])
        yield address, self.name, top if 2 * counts[top] > len(self.values) else None, len(self.values)
        for k, c in enumerate(self.children):
            yield from c.rows(f"{address}.{k:05d}")


def fold(trees: list[Merged]) -> Merged:
    """The trees folded from left to right; all have one root name."""
    out = trees[0]
    for t in trees[1:]:
        out = out.absorb(t)
    return out


def _build(pdf: pd.DataFrame) -> Merged:
    made: dict[int, Merged] = {}
    root = None
    for idx, up, name, value in pdf[["idx", "parent_idx", "name", "value"]].itertuples(index=False):
        made[idx] = Merged(name, [value], [])
        if up in made:
            made[up].children.append(made[idx])
        else:
            root = root or made[idx]
    return root


def skeletons(trees: DataFrame) -> DataFrame:
    """(``cluster``, ``address``, ``name``, ``value``, ``support``): what every tree of a cluster has, children aligned by name.

    ``trees``: (``cluster``, ``tree``, ``idx``, ``parent_idx``, ``name``, ``value``).  The trees of one cluster meet in one task.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "idx"])
        got = fold([_build(own) for _, own in pdf.groupby("tree")])
        return pd.DataFrame([(pdf.cluster.iloc[0], *r) for r in got.rows()], columns=["cluster", "address", "name", "value", "support"])

    return trees.groupBy("cluster").applyInPandas(work, "cluster string, address string, name string, value string, support long")
