"""Syntax trees as node tables: accessors, matchers of slow forms, and linkage of matches to a change.

Node tables have ``id``, ``side``, ``idx``, ``parent_idx``, ``subtree_end``, ``depth``, ``name``, ``value``, ``begin`` and ``end``.
:func:`facts` brings each node's children to it in one aggregate; every accessor is then a column of that table, and a step from a node
to another is an equi-join on (``id``, ``side``, ``idx``).  A subtree is an index range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import together

KEY = ["id", "side"]
#: Names that navigation skips, operators, string contents, functions.
PUNCT = ('"', "'", "(", ")", ",", ".", ":", ";", "[", "]", "`", "{", "}")
OPERATORS = ("!=", "!==", "%", "&", "&&", "*", "**", "+", "-", "/", "<", "<<", "<=", "==", "===", ">", ">=", ">>", ">>>", "??", "^", "in", "instanceof", "|", "||")
CONTENT = ("escape_sequence", "html_character_reference", "string_fragment")
CALLBACKS = ("arrow_function", "function", "function_expression")
#: Characters of a match's snippet.
SNIPPET = 200


def _kids(names: tuple[str, ...] | str) -> Column:
    """The children with one of the names."""
    names = (names,) if isinstance(names, str) else names
    return F.filter("kids", lambda k: k["name"].isin(*names))


def _after(found: Column, of: Column) -> Column:
    """The element after the first for which ``found`` (an array of booleans beside ``of``) is true."""
    at = F.array_position(found, True)
    return F.when(at > 0, F.get(of, at.cast("int")))


def with_named(table: DataFrame) -> DataFrame:
    """``table`` with ``named``: its ``kids`` without punctuation."""
    return table.withColumn("named", F.filter("kids", lambda k: ~k["name"].isin(*PUNCT)))


def facts(nodes: DataFrame) -> DataFrame:
    """``nodes`` with every node's children and what the accessors read from them.

    ``kids`` (``idx``, ``name``, ``value`` in order), ``named`` (without punctuation), ``first_named``, ``last_named``, ``prop`` (value of
    the first property identifier), ``op``, ``lhs``, ``rhs`` (operands; the right one if there are two), ``paren``, ``consequence`` (after
    the parenthesis), ``args``, ``right`` (after ``in`` or ``of``), ``is_empty`` (no string content), ``fragment``.
    """
    kids = nodes.where("parent_idx >= 0").groupBy(*KEY, F.col("parent_idx").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "name", "value"))).alias("kids"))
    # read where the children are: most nodes have none
    kids = with_named(kids)
    operands = F.filter("named", lambda k: ~k["name"].isin(*OPERATORS))
    paren = F.array_position(F.transform("named", lambda k: k["name"] == "parenthesized_expression"), True).cast("int")
    later = F.filter("named", lambda k, i: (i >= paren) & (k["name"] != "parenthesized_expression"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    read = kids.select(
        *KEY, "idx", "kids", "named",
        F.get("named", F.lit(0))["idx"].alias("first_named"),
        last(F.col("named"))["idx"].alias("last_named"),
        F.get(_kids("property_identifier"), F.lit(0))["value"].alias("prop"),
        F.get(_kids(OPERATORS), F.lit(0))["name"].alias("op"),
        F.get(operands, F.lit(0))["idx"].alias("lhs"),
        F.when(F.size(operands) >= 2, last(operands)["idx"]).alias("rhs"),
        F.get(_kids("parenthesized_expression"), F.lit(0))["idx"].alias("paren"),
        F.when(paren > 0, F.get(later, F.lit(0))["idx"]).alias("consequence"),
        F.get(_kids("arguments"), F.lit(0))["idx"].alias("args"),
        _after(F.transform("named", lambda k: k["name"].isin("in", "of")), F.col("named"))["idx"].alias("right"),
        (F.size(_kids(CONTENT)) == 0).alias("is_empty"),
        F.get(_kids("string_fragment"), F.lit(0))["value"].alias("fragment"),
    )
    without = {"kids": F.array().cast("array<struct<idx:int,name:string,value:string>>"), "named": F.array().cast("array<struct<idx:int,name:string,value:string>>"), "is_empty": F.lit(True)}
    return nodes.join(read, [*KEY, "idx"], "left").select(*nodes.columns, *[F.coalesce(c, without[c]).alias(c) if c in without else c for c in read.columns[len(KEY) + 1 :]])


def hop(df: DataFrame, table: DataFrame, at: str, how: str = "left", **columns: str) -> DataFrame:
    """``df`` with columns of the node that its column ``at`` points to: new name = name in ``table``."""
    to = table.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("idx").alias("_at"), *[F.col(c).alias(n) for n, c in columns.items()])
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    return df.join(to, reduce(lambda a, b: a & b, [*same, F.col(at) == F.col("_at")]), how).drop("_at", *[f"_{k}" for k in KEY])


def calls(f: DataFrame) -> DataFrame:
    """Every call: ``method`` (property of a member callee), ``function`` (identifier callee), ``object`` with its name and value, ``arguments``; ``begin`` and ``end`` if ``f`` has them."""
    first = F.get("named", F.lit(0))
    # a child's name and value stand in its parent's row, so only members, their objects' properties and arguments are sought
    c = f.where("name = 'call_expression'").select(*KEY, "idx", *[x for x in ("subtree_end", "begin", "end") if x in f.columns], "first_named", "args", F.when(first["name"] == "identifier", first["value"]).alias("function"))
    members = f.where("name = 'member_expression'").select(*KEY, "idx", "prop", first.alias("of"))
    c = hop(c, members, "first_named", method="prop", of="of")
    c = c.select(*c.columns[:-1], F.col("of.idx").alias("object"), F.col("of.name").alias("object_name"), F.col("of.value").alias("object_value"))
    c = hop(hop(c, f.where("prop is not null"), "object", object_prop="prop"), f.where("name = 'arguments'"), "args", arguments="named")
    c = c.withColumn("arguments", F.coalesce("arguments", F.array().cast("array<struct<idx:int,name:string,value:string>>")))
    return c.select(*KEY, "idx", *[x for x in ("subtree_end", "begin", "end") if x in f.columns], "method", "object", "function", "object_name", "object_value", "object_prop", "arguments")


def _arg(k: int, name: str, value: str | None = None) -> Column:
    a = F.get("arguments", F.lit(k))
    return F.coalesce((a["name"] == name) & (F.lit(True) if value is None else a["value"] == value), F.lit(False))


def operand_forms(f: DataFrame, c: DataFrame) -> DataFrame:
    """What comparisons look for on either side, by node: ``prefix``, ``to_string``, ``object_string``, ``parity``, ``bit``."""
    none = F.lit(False)
    positive = F.coalesce(F.get("arguments", F.lit(1))["value"].try_cast("int") > 0, none)
    of_call = c.select(*KEY, "idx", (F.coalesce(F.col("method") == "substr", none) & (F.size("arguments") == 2) & _arg(0, "number", "0") & _arg(1, "number") & positive).alias("prefix"), F.coalesce((F.col("method") == "call") & (F.col("object_name") == "identifier") & (F.col("object_value") == "toString"), none).alias("to_string"), none.alias("object_string"), none.alias("parity"), none.alias("bit"))
    mod = hop(f.where("name = 'binary_expression' and op = '%'").select(*KEY, "idx", "rhs"), f.where("name = 'number'"), "rhs", rhs_name="name", rhs_value="value")
    of_mod = mod.select(*KEY, "idx", none.alias("prefix"), none.alias("to_string"), none.alias("object_string"), F.coalesce((F.col("rhs_name") == "number") & (F.col("rhs_value") == "2"), none).alias("parity"), none.alias("bit"))
    leaf = f.where("name in ('string', 'number')").select(*KEY, "idx", none.alias("prefix"), none.alias("to_string"), F.coalesce((F.col("name") == "string") & F.col("fragment").startswith("[object"), none).alias("object_string"), none.alias("parity"), ((F.col("name") == "number") & F.col("value").isin("0", "1")).alias("bit"))
    return together([of_call, of_mod, leaf])


def find_slow_forms(f: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """(``id``, ``side``, ``pattern_id``, ``confidence``, ``idx``) of the ten slow forms."""
    c = calls(f) if c is None else c
    # each step seeks only what it can use: a join with all nodes reads them all
    of = lambda *names: f.where(F.col("name").isin(*names))
    hit = lambda df, pattern, confidence: df.select(*KEY, F.lit(pattern).alias("pattern_id"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), "idx")
    # 1: the first statement of a for-in's body asks hasOwnProperty
    loop = hop(f.where("name = 'for_in_statement'").select(*KEY, "idx", "last_named", "right"), of("statement_block", "if_statement"), "last_named", body="name", inner="first_named")
    loop = loop.withColumn("test", F.when(F.col("body") == "statement_block", F.col("inner")).when(F.col("body") == "if_statement", F.col("last_named")))
    loop = hop(hop(loop, of("if_statement"), "test", "inner", test_paren="paren"), of("parenthesized_expression"), "test_paren", condition="first_named")
    loop = hop(loop, c.where("method = 'hasOwnProperty'"), "condition", "inner", object_name="object_name", object_value="object_value")
    loop = hop(loop, of("identifier"), "right", right_name="name", right_value="value")
    same = F.coalesce((F.col("object_name") == "identifier") & (F.col("right_name") == "identifier") & (F.col("object_value") == F.col("right_value")), F.lit(False))
    found = [hit(loop, 1, F.when(same, "high").otherwise("medium"))]
    # 2, 3, 4, 9: one call
    found.append(hit(c.where((F.col("method") == "substr") & (F.size("arguments") == 2) & _arg(1, "number", "1")), 2, "high"))
    found.append(hit(c.where((F.col("function") == "String") & (F.size("arguments") == 1)), 3, "high"))
    html = c.where((F.col("method") == "html") & (F.size("arguments") == 1) & _arg(0, "string")).withColumn("only", F.get("arguments", F.lit(0))["idx"])
    found.append(hit(hop(html, of("string"), "only", is_empty="is_empty").where("is_empty"), 4, "high"))
    found.append(hit(c.where((F.col("method") == "reduce") & F.exists("arguments", lambda a: a["name"].isin(*CALLBACKS))), 9, "low"))
    # 6, 10: a call on a call
    joined = hop(c.where("method = 'join' and object_name = 'call_expression'"), c, "object", on="method", on_name="object_name", on_prop="object_prop")
    found.append(hit(joined.where("on = 'split'"), 6, "high"))
    found.append(hit(joined.where("on = 'call' and on_name = 'member_expression' and on_prop = 'slice'"), 10, "medium"))
    # 5, 7, 8: a comparison, either way round
    names = ("prefix", "to_string", "object_string", "parity", "bit")
    forms = operand_forms(f, c).where(" or ".join(names))
    cmp = f.where("name = 'binary_expression' and op in ('==', '===', '!=', '!==') and lhs is not null and rhs is not null").select(*KEY, "idx", "op", "lhs", "rhs")
    cmp = hop(hop(cmp, forms, "lhs", **{f"l_{n}": n for n in names}), forms, "rhs", **{f"r_{n}": n for n in names})
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    either = lambda a, b: (yes(f"l_{a}") & yes(f"r_{b}")) | (yes(f"r_{a}") & yes(f"l_{b}"))
    found.append(hit(cmp.where(F.col("op").isin("==", "===", "!=", "!==") & (yes("l_prefix") | yes("r_prefix"))), 5, "high"))
    found.append(hit(cmp.where(F.col("op").isin("==", "===") & either("to_string", "object_string")), 7, "medium"))
    found.append(hit(cmp.where(F.col("op").isin("==", "===") & either("parity", "bit")), 8, "high"))
    return together(found)


def with_snippets(matches: DataFrame, nodes: DataFrame, codes: DataFrame, limit: int = SNIPPET) -> DataFrame:
    """Matches with ``begin``, ``end`` and the first ``limit`` characters of their source."""
    at = matches.join(nodes.select(*KEY, "idx", "begin", "end"), [*KEY, "idx"]).join(codes, KEY)
    return at.withColumn("snippet", F.substring("code", F.col("begin") + 1, F.least(F.col("end") - F.col("begin"), F.lit(limit)))).drop("code")


def patterns_of_cut(matches: DataFrame, known: tuple[int, ...] = (1, 2, 3, 6, 7, 8, 9)) -> DataFrame:
    """(``id``, ``side``, ``patterns``): which of the ``known`` forms a cut holds."""
    return matches.where(F.col("pattern_id").isin(*known)).groupBy(*KEY).agg(F.sort_array(F.collect_set("pattern_id")).alias("patterns"))


def _has_kid(*names: str) -> Column:
    return F.exists("kids", lambda k: k["name"].isin(*names))


def find_after_forms(f: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """(``id``, ``side``, ``pattern_id``, ``idx``, ``receiver``): nodes of the forms that replace the slow ones; ``receiver`` only for pattern 4."""
    c = calls(f) if c is None else c
    none = F.lit(None).cast("string")
    hit = lambda df, pattern, receiver=none: df.select(*KEY, F.lit(pattern).alias("pattern_id"), "idx", receiver.alias("receiver"))
    receiver = F.when(F.col("object_name") == "identifier", F.col("object_value"))
    binary = f.where("name = 'binary_expression'")
    strings = f.where("name = 'string' and coalesce(fragment, '') = ''").select(*KEY, F.col("parent_idx").alias("idx")).distinct()
    first_bracket = F.array_position(F.transform("kids", lambda k: k["name"]), "[").cast("int")
    before = F.filter("kids", lambda k, i: ((first_bracket == 0) | (i < first_bracket - 1)) & k["name"].isin("call_expression", "identifier", "member_expression"))
    equal = f.where((F.col("name") == "binary_expression") & _has_kid("===", "!=="))
    ifs = f.where("name = 'if_statement'").select(*KEY, "idx", "subtree_end")
    inside = equal.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("idx").alias("_at"))
    ifs = ifs.join(inside, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in KEY]) & F.col("_at").between(F.col("idx") + 1, F.col("subtree_end")), "left_semi")
    ternary = f.where("name = 'ternary_expression'").select(*KEY, "idx", "first_named")
    found = [
        hit(c.where("method = 'keys' and object_name = 'identifier' and object_value = 'Object'"), 1),
        hit(f.where((F.col("name") == "subscript_expression") & (F.size(before) > 0)), 2),
        hit(binary.where(_has_kid("+")).join(strings, [*KEY, "idx"], "left_semi"), 3),
        hit(c.where("method = 'empty'"), 4, receiver),
        hit(c.where("method = 'charAt'"), 5),
        hit(c.where("method = 'replace'"), 6),
        hit(binary.where(_has_kid("instanceof")), 7),
        hit(c.where("method = 'isArray'"), 7),
        hit(hop(binary.where(_has_kid("&")), f.where("name = 'number'"), "rhs", rhs_name="name", rhs_value="value").where("rhs_name = 'number' and rhs_value = '1'"), 8),
        hit(f.where("name = 'for_statement'"), 9),
        hit(ifs, 10),
        hit(ternary.join(equal.select(*KEY, F.col("idx").alias("first_named")), [*KEY, "first_named"], "left_semi"), 10),
    ]
    return together(found)


def anchors(nodes: DataFrame, actions: DataFrame, insert_only: bool = False) -> DataFrame:
    """(``id``, ``side``, ``anchor``, ``anchor_end``): nodes that changes hang on.

    Action nodes and their ancestors below the root; with ``insert_only`` the nodes of insert actions themselves.
    """
    if insert_only:
        at = actions.where(F.col("action").startswith("insert")).select(*KEY, "idx").distinct()
        return at.join(nodes, [*KEY, "idx"]).select(*KEY, F.col("idx").alias("anchor"), F.col("subtree_end").alias("anchor_end"))
    at = actions.select(*KEY, F.explode(F.concat(F.array("idx"), F.coalesce("ancestors", F.array().cast("array<int>")))).alias("idx")).where("idx is not null").distinct()
    return at.join(nodes.where("depth >= 1"), [*KEY, "idx"]).select(*KEY, F.col("idx").alias("anchor"), F.col("subtree_end").alias("anchor_end"))


def under(df: DataFrame, tops: DataFrame) -> DataFrame:
    """The rows whose node is an anchor or lies below one."""
    t = tops.select(*[F.col(k).alias(f"_{k}") for k in KEY], "anchor", "anchor_end")
    return df.join(t, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in KEY]) & F.col("idx").between(F.col("anchor"), F.col("anchor_end")), "left_semi")


def base_covered(matches: DataFrame, nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Matches on the base side with ``reason``: ``B1`` (an action is the node, or names it as an ancestor), ``B2`` (an action lies below it); others go."""
    m = matches.where("side = 'base'").join(nodes.select(*KEY, "idx", "subtree_end"), [*KEY, "idx"])
    a = actions.where("side = 'base'").select(F.col("id").alias("_id"), F.col("idx").alias("_idx"), F.coalesce("ancestors", F.array().cast("array<int>")).alias("_up"))
    direct = (F.col("_idx") == F.col("idx")) | F.array_contains("_up", F.col("idx"))
    got = m.join(a, (F.col("id") == F.col("_id")) & (direct | F.col("_idx").between(F.col("idx"), F.col("subtree_end"))))
    return got.groupBy(*matches.columns).agg(F.when(F.bool_or(direct), "B1").otherwise("B2").alias("reason"))


def link_matches(matches: DataFrame, f: DataFrame, actions: DataFrame, c: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Base matches with ``diff_linked`` and ``diff_reason``: a covered match whose record has its after form under a change of the head side.

    Pattern 9 also needs a for statement inside something inserted; pattern 4 the same receiver where both are identifiers.
    ``after``: the after forms, if they are at hand.
    """
    c = calls(f) if c is None else c
    after = find_after_forms(f, c) if after is None else after
    head_nodes, head_actions = f.where("side = 'head'"), actions.where("side = 'head'")
    forms = under(after.where("side = 'head'"), anchors(head_nodes, head_actions))
    loops = under(head_nodes.where("name = 'for_statement'"), anchors(head_nodes, head_actions, insert_only=True)).select("id", F.lit(9).alias("pattern_id")).distinct()
    forms = together([forms.where("pattern_id <> 9"), forms.join(loops, ["id", "pattern_id"], "left_semi").select(*forms.columns)])
    forms = forms.select(F.col("id").alias("_id"), F.col("pattern_id").alias("_pattern"), F.col("receiver").alias("_receiver")).distinct()
    base = matches.where("side = 'base'")
    held = hop(base_covered(matches, f, actions), c, "idx", object_name="object_name", object_value="object_value").withColumn("receiver", F.when(F.col("object_name") == "identifier", F.col("object_value")))
    agree = (F.col("pattern_id") != 4) | F.coalesce(F.col("receiver") == F.col("_receiver"), F.lit(True))
    linked = held.join(forms, (F.col("id") == F.col("_id")) & (F.col("pattern_id") == F.col("_pattern")) & agree, "left_semi")
    reason = linked.select(*KEY, "pattern_id", "idx", F.concat(F.lit("base_"), "reason", F.lit("_head_action")).alias("diff_reason"))
    return base.join(reason, [*KEY, "pattern_id", "idx"], "left").withColumn("diff_linked", F.col("diff_reason").isNotNull())


def signature_holds(pattern_id: Column, value: Column) -> Column:
    """The lexical signature of a form in blank-separated tokens of a representative."""
    t = F.split(value, r"\s+")
    has = lambda *w: reduce(lambda a, b: a & b, [F.array_contains(t, x) for x in w])
    parity = has("%", "2") & F.forall(t, lambda x: x.startswith("$") | x.isin("%", "0", "1", "2", "==", "==="))
    rules = {1: has("hasOwnProperty", "in"), 2: has("substr"), 3: has("String") & ~F.arrays_overlap(t, F.array(F.lit("new"), F.lit("instanceof"))), 6: has("split"), 7: has("toString", "call"), 8: parity, 9: has("reduce")}
    out = F.raise_error(F.concat(F.lit("unknown pattern "), pattern_id.cast("string"))).cast("boolean")
    for k, rule in reversed(rules.items()):
        out = F.when(pattern_id == k, rule).otherwise(out)
    return out


def query_hits(f: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """(``id``, ``side``, ``query_id``, ``idx``) of six structural queries: for-in loops, forEach calls, loops that ask hasOwnProperty, map on apply, parse of stringify, push in for-of."""
    c = calls(f) if c is None else c
    hit = lambda df, q: df.select(*KEY, F.lit(q).alias("query_id"), "idx").distinct()
    loops = f.where("name = 'for_in_statement'").withColumn("of", F.exists("kids", lambda k: k["name"] == "of"))
    body = lambda df: hop(df.select(*KEY, "idx", "last_named"), f, "last_named", body_end="subtree_end")
    within = lambda df, inner, lo, hi: df.join(inner.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("idx").alias("_in")), reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in KEY]) & F.col("_in").between(lo, hi), "left_semi")
    asks = hop(f.where("name = 'if_statement'").select(*KEY, "idx", "paren"), f, "paren", paren_end="subtree_end")
    asks = within(asks, c.where("method = 'hasOwnProperty'"), F.col("paren"), F.col("paren_end"))
    on = hop(c.where("method = 'map' and object_name = 'call_expression'"), c, "object", on="method").where("on = 'apply'")
    parse = c.where("method = 'parse'").select(*KEY, "idx", F.explode("arguments.idx").alias("arg"))
    return together(
        [
            hit(loops.where("not of"), 1),
            hit(c.where("method = 'forEach'"), 2),
            hit(within(body(loops.where("not of")), asks, F.col("last_named"), F.col("body_end")), 3),
            hit(on, 4),
            hit(hop(parse, c, "arg", inner="method").where("inner = 'stringify'"), 5),
            hit(within(body(loops.where("of")), c.where("method = 'push'"), F.col("last_named"), F.col("body_end")), 6),
        ],
    )


# --- abstraction ---------------------------------------------------------------

#: Names that abstraction leaves out, and the markers of renamed identifiers.
SKIPPED = ('"', "'", "(", ")", ",", ".", ":", ";", "[", "]", "_", "{", "}")
MARKERS = {"VAR_": "v", "FUNCTION_": "f"}


def abstract(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes without punctuation, with ``slot`` and ``abstract_value``.

    Level 1 numbers renamed variables and functions by first appearance in the record.  Level 2 also numbers what stands below a regex
    (which wins over the identifier's slot, though that keeps its number), numbers, and string contents.  ``variadic`` is never set.
    """
    regex = nodes.where("name = 'regex'").select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("idx").alias("_at"), F.col("subtree_end").alias("_end"))
    below = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in KEY]) & (F.col("idx") > F.col("_at")) & (F.col("idx") <= F.col("_end"))
    shown = nodes.where(~F.col("name").isin(*SKIPPED))
    in_regex = shown.join(regex, below, "left_semi").select(*KEY, "idx", F.lit(True).alias("in_regex"))
    shown = shown.join(in_regex, [*KEY, "idx"], "left").withColumn("in_regex", F.coalesce("in_regex", F.lit(False)))
    first = F.lit(None).cast("string")
    for prefix, marker in MARKERS.items():
        first = F.when(F.col("value").startswith(prefix), F.lit(marker)).otherwise(first)
    second = F.when(F.col("in_regex"), "r").when(F.col("name") == "number", "n").when(F.col("name") == "string_fragment", "s") if level >= 2 else F.lit(None).cast("string")
    marked = shown.withColumn("m1", first).withColumn("m2", second)
    uses = marked.select(*KEY, "idx", "value", F.explode(F.array("m1", "m2")).alias("marker")).where("marker is not null")
    seen = uses.groupBy(*KEY, "marker", "value").agg(F.min("idx").alias("at"))
    # a record has few slots, so the ones of a marker are an array
    ranked = seen.groupBy(*KEY, "marker").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select(*KEY, "marker", F.posexplode("v").alias("n", "x")).select(*KEY, F.col("marker").alias("taken"), F.col("x.value").alias("value"), F.concat(F.lit("$"), "marker", F.col("n").cast("string")).alias("slot"))
    out = marked.withColumn("taken", F.coalesce("m2", "m1")).join(ranked, [*KEY, "taken", "value"], "left")
    return out.select(*nodes.columns, "slot", F.coalesce("slot", "value").alias("abstract_value"), F.lit(False).alias("variadic"))


def tokens(abstracted: DataFrame) -> DataFrame:
    """(``id``, ``side``, ``tokens``): values of the leaves in order, slots of one family alike."""
    from ..functions.values import normalize_value

    leaf = abstracted.where("idx = subtree_end")
    return leaf.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", normalize_value(F.col("abstract_value")).alias("t")))).alias("t")).select(*KEY, F.transform("t", lambda x: x["t"]).alias("tokens"))
