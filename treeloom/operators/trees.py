"""Trees as flat preorder node tables.

A node table has ``id`` (the record), ``idx`` (preorder), ``name``, ``value``,
``parent`` (indices from the root to the direct parent), ``parent_idx`` (-1 for
a root), ``depth`` and ``subtree_end``.  A subtree is the index range
[idx, subtree_end], so ancestor tests are ranges and joins stay inside ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_trees(region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Each customer's tree of five levels: region, nation, customer, orders, items; ``is_action`` marks returned items."""
    none = lambda t: F.lit(None).cast(t)
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    types = dict(lineitem.dtypes)
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    named = customer.join(place, customer.c_nationkey == place.n_nationkey)
    level = lambda k, name, value: F.struct(F.lit(k).alias("kind"), F.lit(name).alias("name"), F.col(value).alias("value"))
    top = named.select(F.col("c_custkey").alias("id"), none("bigint").alias("o"), F.explode(F.array(level(0, "region", "r_name"), level(1, "nation", "n_name"), level(2, "customer", "c_mktsegment"))).alias("x"))
    top = top.select("id", "o", "x.*", *[none(types[t]).alias(t) for t in tie])
    mid = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("o"), F.lit(3).alias("kind"), F.lit("order").alias("name"), F.col("o_orderstatus").alias("value"), *[none(types[t]).alias(t) for t in tie])
    owner = orders.select("o_orderkey", "o_custkey")
    low = lineitem.join(owner, lineitem.l_orderkey == owner.o_orderkey).select(F.col("o_custkey").alias("id"), F.col("l_orderkey").alias("o"), F.lit(4).alias("kind"), F.lit("item").alias("name"), F.concat("l_returnflag", "l_linestatus").alias("value"), *tie)
    by = W.partitionBy("id").orderBy(F.col("o").asc_nulls_first(), "kind", *tie)
    rows = top.unionByName(mid).unionByName(low).withColumn("idx", F.row_number().over(by) - 1)
    own = W.partitionBy("id", "o")
    kind, order = F.col("kind"), F.min("idx").over(own)
    above = F.transform(F.sequence(F.lit(0), F.least(kind, F.lit(3)) - 1), lambda k: k.cast("int"))
    return rows.select(
        "id",
        "idx",
        "name",
        "value",
        F.when(kind == 0, F.array().cast("array<int>")).when(kind == 4, F.concat(above, F.array(order))).otherwise(above).alias("parent"),
        F.when(kind == 4, order).otherwise(kind - 1).alias("parent_idx"),
        kind.alias("depth"),
        F.when(kind <= 2, F.count(F.lit(1)).over(W.partitionBy("id")).cast("int") - 1).when(kind == 3, F.max("idx").over(own)).otherwise(F.col("idx")).alias("subtree_end"),
        ((kind == 4) & F.col("value").startswith("R")).alias("is_action"),
    )


def with_subtree_end(nodes: DataFrame) -> DataFrame:
    """Add ``subtree_end`` to a table that has only ``parent`` paths: the largest index below each ancestor."""
    last = nodes.select("id", "idx", F.explode("parent").alias("a")).groupBy("id", "a").agg(F.max("idx").alias("subtree_end"))
    out = nodes.join(last.select(F.col("id").alias("_id"), F.col("a").alias("_a"), F.col("subtree_end").alias("_e")), (F.col("id") == F.col("_id")) & (F.col("idx") == F.col("_a")), "left")
    return out.withColumn("subtree_end", F.coalesce("_e", "idx")).drop("_id", "_a", "_e")


def children(nodes: DataFrame, where: Column | None = None) -> DataFrame:
    """Of every node with children: their number, the first and the last, and the named first one (``where``)."""
    named = where if where is not None else F.lit(True)
    return nodes.where("parent_idx >= 0").groupBy("id", F.col("parent_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n_children"), F.min("idx").alias("first_child"), F.max("idx").alias("last_child"), F.min(F.when(named, F.col("idx"))).alias("first_named"))


def descendants(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every anchor (``id``, ``idx``, ``subtree_end``) with itself and all nodes below it, by range."""
    a = anchors.select(F.col("id").alias("a_id"), F.col("idx").alias("anchor"), F.col("subtree_end").alias("a_end"))
    return nodes.join(a, (F.col("id") == F.col("a_id")) & F.col("idx").between(F.col("anchor"), F.col("a_end"))).drop("a_id", "a_end")


def label_counts(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Count of each listed name, zero-filled."""
    return nodes.groupBy("id").agg(*[F.count_if(F.col("name") == n).alias(f"n_{n}") for n in names])


def ordered_values(nodes: DataFrame, name: str) -> DataFrame:
    """Values of the nodes of one name in source order, duplicates kept."""
    got = nodes.where(F.col("name") == name).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("v"))
    return got.select("id", F.transform("v", lambda x: x["value"]).alias("values"))


def scope_boundary(nodes: DataFrame, boundary: list[str]) -> DataFrame:
    """For every node the nearest ancestor whose name is a boundary; else the outermost ancestor, else itself."""
    b = nodes.where(F.col("name").isin(*boundary)).select(F.col("id").alias("b_id"), F.col("idx").alias("b"), F.col("subtree_end").alias("b_end"))
    near = nodes.join(b, (F.col("id") == F.col("b_id")) & (F.col("idx") > F.col("b")) & (F.col("idx") <= F.col("b_end")), "left").groupBy("id", "idx").agg(F.max("b").alias("near"), F.first("parent").alias("parent"))
    return near.select("id", "idx", F.coalesce("near", F.get("parent", F.lit(0)), "idx").alias("boundary"))


#: Names that bound a scope.
SCOPE_BOUNDARY = (
    "arrow_function", "catch_clause", "class", "class_body", "class_declaration", "class_static_block", "do_statement", "else_clause", "finally_clause",
    "for_in_statement", "for_statement", "function", "function_declaration", "function_expression", "generator_function", "generator_function_declaration",
    "if_statement", "labeled_statement", "method_definition", "program", "switch_body", "switch_case", "switch_default", "try_statement", "while_statement", "with_statement",
)


def scope_spans(nodes: DataFrame, actions: DataFrame, boundary: tuple[str, ...] = SCOPE_BOUNDARY, names: list[str] | None = None) -> DataFrame:
    """(``id``, ``side``, ``act``, ``action``, ``scope``, ``lo``, ``end``): the index ranges of the four nested scopes around each action.

    Diff: the action's node and all below.  Brother: all below its parent; for a root, the root and all below.  ExParent: the action's
    subtree, and the subtrees of the children of the node one below the boundary on the action's path (of the boundary itself where the
    action is its child).  Parent: the boundary and all below.  The boundary is the nearest ancestor with such a name, else the outermost
    ancestor, else the node.  Actions whose node isn't in the tree are left out; ``names`` keeps only actions of these names.
    """
    acts = actions if names is None else actions.where(F.col("action").isin(*names))
    key = ["id", "side"]
    here = acts.select(*key, "action", "idx").distinct().join(nodes.select(*key, "idx", "parent_idx", F.col("subtree_end").alias("hi")), [*key, "idx"])
    up = nodes.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("idx").alias("up"), F.col("subtree_end").alias("up_end"), F.col("name").isin(*boundary).alias("bounds"))
    above = (F.col("id") == F.col("_id")) & (F.col("side") == F.col("_side")) & (F.col("idx") > F.col("up")) & (F.col("idx") <= F.col("up_end"))
    path = here.join(up, above, "left").groupBy(*key, "action", "idx", "parent_idx", "hi").agg(F.array_sort(F.collect_list(F.when(F.col("up").isNotNull(), F.struct("up", "up_end", "bounds")))).alias("path"))
    own = F.struct(F.col("idx").alias("up"), F.col("hi").alias("up_end"), F.lit(True).alias("bounds"))
    bound = F.coalesce(F.try_element_at(F.filter("path", lambda p: p["bounds"]), F.lit(-1)), F.get("path", F.lit(0)), own)
    path = path.withColumn("bound", bound).withColumn("top", F.when(F.col("bound.up") != F.col("idx"), F.coalesce(F.get(F.filter("path", lambda p: p["up"] > F.col("bound.up")), F.lit(0)), F.col("bound"))))
    parent = F.try_element_at("path", F.lit(-1))
    span = lambda scope, lo, hi: F.struct(F.lit(scope).alias("scope"), lo.alias("lo"), hi.alias("end"))
    spans = F.array(
        span("Diff", F.col("idx"), F.col("hi")),
        span("Brother", F.coalesce(parent["up"] + 1, F.col("idx")), F.coalesce(parent["up_end"], F.col("hi"))),
        span("ExParent", F.col("idx"), F.col("hi")),
        span("ExParent", F.col("top.up") + 1, F.col("top.up_end")),
        span("Parent", F.col("bound.up"), F.col("bound.up_end")),
    )
    return path.select(*key, F.col("idx").alias("act"), "action", F.explode(spans).alias("s")).where("s.lo <= s.end").select(*key, "act", "action", "s.*")


def scope_blocks(nodes: DataFrame, actions: DataFrame, boundary: tuple[str, ...] = SCOPE_BOUNDARY, names: list[str] | None = None) -> DataFrame:
    """(``id``, ``side``, ``act``, ``action``, ``scope``, ``idx``): the nodes of each action's scopes."""
    spans = scope_spans(nodes, actions, boundary, names)
    return spans.select("id", "side", "act", "action", "scope", F.explode(F.sequence("lo", "end")).alias("idx")).distinct()


def cut_scopes(nodes: DataFrame, boundary: list[str]) -> DataFrame:
    """(``id``, ``scope``, ``idx``, ``is_diff``): the scopes over all actions (``is_action``) of each record of one side.

    Equal ranges are merged before they are laid out, so many actions under one parent cost one range.
    """
    own = nodes.withColumn("side", F.lit("base"))
    acts = own.where("is_action").select("id", "side", F.lit("change").alias("action"), "idx")
    spans = scope_spans(own, acts, tuple(boundary)).select("id", "scope", "lo", "end").distinct()
    cut = spans.select("id", "scope", F.explode(F.sequence("lo", "end")).alias("idx")).distinct()
    diff = cut.where("scope = 'Diff'").select("id", "idx", F.lit(True).alias("is_diff"))
    return cut.join(diff, ["id", "idx"], "left").select("id", "scope", "idx", F.coalesce("is_diff", F.lit(False)).alias("is_diff"))


def merged_scopes(blocks: DataFrame) -> DataFrame:
    """(``id``, ``side``, ``scope``, ``nodes``, ``diff_nodes``): each scope's nodes over all actions of a record in order, and the changed ones among them."""
    cut = blocks.select("id", "side", "scope", "idx").distinct()
    diff = cut.where("scope = 'Diff'").select("id", "side", "idx", F.col("idx").alias("changed"))
    return cut.join(diff, ["id", "side", "idx"], "left").groupBy("id", "side", "scope").agg(F.array_sort(F.collect_list("idx")).alias("nodes"), F.array_sort(F.collect_list("changed")).alias("diff_nodes"))


def _around(nodes: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What surrounds each start (``id``, ``act``, ``action``, ``at``): nodes of three kinds, and the next start.

    Siblings; smaller nodes of the parent's level (from depth 2); and what begins where the first of those begins, up to it.
    """
    n = nodes.select(F.col("id").alias("_id"), "idx", F.col("parent_idx").alias("up"), F.col("depth").alias("d"), "begin")
    at = starts.join(n.select("_id", F.col("idx").alias("at"), F.col("up").alias("at_up"), F.col("d").alias("at_depth")).withColumnRenamed("_id", "id"), ["id", "at"])
    at = at.join(n.select(F.col("_id").alias("id"), F.col("idx").alias("at_up"), F.col("up").alias("at_upper")), ["id", "at_up"], "left")
    who = ["id", "act", "action"]
    side = at.where("at_depth > 0").join(n, (F.col("id") == F.col("_id")) & (F.col("up") == F.col("at_up"))).select(*who, "idx")
    outer = at.where("at_depth >= 2").join(n, (F.col("id") == F.col("_id")) & (F.col("up") == F.col("at_upper")) & (F.col("idx") < F.col("at"))).select(*who, "idx", "begin")
    lead = outer.groupBy(*who).agg(F.min(F.struct("idx", "begin")).alias("lead"))
    level = lead.join(n.where("d > 0"), (F.col("id") == F.col("_id")) & (F.col("idx") <= F.col("lead.idx")) & (F.col("begin") == F.col("lead.begin"))).select(*who, "idx")
    following = starts.join(lead, who, "left").select(*who, F.coalesce("lead.idx", "at").alias("at"))
    return side.unionByName(outer.select(*who, "idx")).unionByName(level), following


def sigma_blocks(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """(``id``, ``act``, ``action``, ``scope``, ``idx``) of one side: ``diff`` (nodes in the action's source range), ``parent_diff`` (and what surrounds it), ``around_parent`` (and what surrounds that)."""
    who = ["id", "act", "action"]
    acts = actions.select("id", F.col("idx").alias("act"), "action").distinct()
    own = acts.join(nodes.select("id", F.col("idx").alias("act"), F.col("begin").alias("lo"), F.col("end").alias("hi")), ["id", "act"])
    inside = nodes.where("depth > 0").select(F.col("id").alias("_id"), "idx", "begin", "end")
    diff = own.join(inside, (F.col("id") == F.col("_id")) & (F.col("begin") >= F.col("lo")) & (F.col("end") <= F.col("hi"))).select(*who, "idx")
    near, following = _around(nodes, own.select(*who, F.col("act").alias("at")))
    parent = diff.unionByName(near).distinct()
    far, _ = _around(nodes, following)
    around = parent.unionByName(far).distinct()
    named = [df.distinct().withColumn("scope", F.lit(s)) for s, df in (("diff", diff), ("parent_diff", parent), ("around_parent", around))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def augmented_head_actions(actions: DataFrame, matches: DataFrame) -> DataFrame:
    """Head actions, and moves and updates of the base side at the node that matches on the head side, unless that has an action already."""
    head = actions.where("side = 'head'").select("id", "side", "action", "idx")
    carried = actions.where("side = 'base' and (action like 'move%' or action like 'update%')").select("id", "action", F.col("idx").alias("base_idx"))
    carried = carried.join(matches, ["id", "base_idx"]).select("id", F.lit("head").alias("side"), "action", F.col("head_idx").alias("idx")).distinct()
    return head.unionByName(carried.join(head.select("id", "idx"), ["id", "idx"], "left_anti").select(*head.columns))


def sibling_roots(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(``id``, ``side``, ``act``, ``idx``): the roots of the subtrees that ExParent is made of, that is its nodes whose parent it doesn't hold."""
    ex = blocks.where("scope = 'ExParent'").select("id", "side", "act", "idx").distinct()
    of = ex.join(nodes.select("id", "side", "idx", "parent_idx"), ["id", "side", "idx"])
    return of.join(ex.withColumnRenamed("idx", "parent_idx"), ["id", "side", "act", "parent_idx"], "left_anti").select("id", "side", "act", "idx")


def range_cut(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Range containment: nodes (not roots) whose [begin, end] lies inside the anchor's."""
    a = anchors.select(F.col("id").alias("a_id"), F.col("idx").alias("anchor"), F.col("begin").alias("a_b"), F.col("end").alias("a_e"))
    return nodes.where("depth > 0").join(a, (F.col("id") == F.col("a_id")) & (F.col("begin") >= F.col("a_b")) & (F.col("end") <= F.col("a_e"))).drop("a_id", "a_b", "a_e")


def sibling_completeness(nodes: DataFrame, cut: DataFrame) -> DataFrame:
    """Per record and scope: the mean over the parents of changed nodes of the share of their children that the scope holds."""
    parents = nodes.where("is_action").select("id", "parent_idx").distinct()
    kids = nodes.join(parents, ["id", "parent_idx"], "left_semi").select("id", "idx", "parent_idx")
    scopes = cut.select("id", "scope").distinct()
    have = kids.join(scopes, "id").join(cut.select("id", "scope", "idx", F.lit(1).alias("in")), ["id", "scope", "idx"], "left")
    share = have.groupBy("id", "scope", "parent_idx").agg((F.count("in") / F.count(F.lit(1))).alias("share"))
    return share.groupBy("id", "scope").agg(F.avg("share").alias("completeness"))


def keyroots(nodes: DataFrame) -> DataFrame:
    """Of the nodes with one leftmost leaf the last in postorder is a keyroot: here the one nearest to the root."""
    leaf = nodes.where("idx = subtree_end").select(F.col("id").alias("l_id"), F.col("idx").alias("leaf"))
    first = nodes.join(leaf, (F.col("id") == F.col("l_id")) & F.col("leaf").between(F.col("idx"), F.col("subtree_end"))).groupBy("id", "idx").agg(F.min("leaf").alias("leftmost"))
    return first.groupBy("id", "leftmost").agg(F.min("idx").alias("keyroot"))


def slots(nodes: DataFrame, marker: Column) -> DataFrame:
    """Each value's slot: markers numbered from 0 by first appearance in the record."""
    first = nodes.select("id", marker.alias("marker"), "value", "idx").groupBy("id", "marker", "value").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n_uses"))
    n = F.dense_rank().over(W.partitionBy("id", "marker").orderBy("first_idx")) - 1
    return first.select("id", "value", "n_uses", F.concat(F.lit("$"), "marker", n.cast("string")).alias("slot"))
