"""Small programs as node tables, built from ``part``: the tables that the syntax queries run over.

Every part is a program of three statements on two sides.  A statement is one
of ``STATEMENTS`` (before, after); a changed one has its after form on the head
side.  The statements are a fixed table of a few hundred nodes, so the join with
them is a broadcast of bounded size, and the SQL has the same table as VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import buckets, together

PER_PROGRAM = 3


def _call(callee, *args):
    listed = [x for a in args for x in (",", a)][1:]
    return ("call_expression", callee, ("arguments", "(", *listed, ")"))


def _id(v):
    return ("identifier", [v])


def _num(v):
    return ("number", [v])


def _dot(obj, prop):
    return ("member_expression", obj, ".", ("property_identifier", [prop]))


def _str(v=""):
    return ("string", "'", *([("string_fragment", [v])] if v else []), "'")


def _bin(a, op, b):
    return ("binary_expression", a, op, b)


def _line(e):
    return ("expression_statement", e, ";")


def _if(cond, *body):
    return ("if_statement", "if", ("parenthesized_expression", "(", cond, ")"), ("statement_block", "{", *body, "}"))


def _for_in(left, right, *body):
    return ("for_in_statement", "for", "(", _id(left), "in", _id(right), ")", *body)


_X, _S, _O, _K = _id("x@"), _id("s@"), _id("o@"), _id("k@")
_OWN = _call(_dot(_O, "hasOwnProperty"), _K)
_FUNC = ("function_expression", "function", ("formal_parameters", "(", _id("a"), ",", _id("b"), ")"), ("statement_block", "{", "}"))
_CALL_F = _line(_call(_id("VAR_@"), _X))
_LOOP = ("for_statement", "for", "(", _line(("assignment_expression", _id("i"), "=", _num("0"))), _bin(_id("i"), "<", _dot(_X, "length")), ";", ("update_expression", _id("i"), "++"), ")", ("statement_block", "{", _CALL_F, "}"))
_SAME = None

#: (before, after) of every statement; ``@`` is a digit of the program, ``_SAME``: never changed.
STATEMENTS = [
    (_for_in("k@", "o@", ("statement_block", "{", _if(_OWN, _CALL_F), "}")), _line(_call(_dot(_id("Object"), "keys"), _O))),
    (_for_in("k@", "x@", _if(_OWN, _CALL_F)), _line(_call(_dot(_id("Object"), "values"), _O))),
    (_for_in("k@", "o@", ("statement_block", "{", _CALL_F, _if(_OWN, _CALL_F), "}")), _SAME),
    (_line(_call(_dot(_S, "substr"), _id("FUNCTION_@"), _num("1"))), _line(("subscript_expression", _S, "[", _id("i"), "]"))),
    (_line(_call(_id("String"), _X)), _line(_bin(_str(), "+", _X))),
    (_line(_call(_dot(_O, "html"), _str())), _line(_call(_dot(_id("o1"), "empty")))),
    (_line(_bin(_call(_dot(_S, "substr"), _num("0"), _num("3")), "===", _str("abc"))), _line(_bin(_call(_dot(_S, "charAt"), _num("0")), "===", _str("a")))),
    (_line(_call(_dot(_call(_dot(_S, "split"), _str(",")), "join"), _str())), _line(_call(_dot(_S, "replace"), ("regex", "/", ("regex_pattern", ["VAR_7"]), "/"), _str()))),
    (_line(_bin(_str("[object Array]"), "===", _call(_dot(_id("toString"), "call"), _X))), _line(_bin(_X, "instanceof", _id("Array")))),
    (_line(_bin(_bin(_X, "%", _num("2")), "==", _num("0"))), _line(_bin(_X, "&", _num("1")))),
    (_line(_call(_dot(_X, "reduce"), _FUNC)), _LOOP),
    (_line(_call(_dot(_call(_dot(_dot(("array", "[", "]"), "slice"), "call"), _X), "join"), _str())), _if(_bin(_X, "===", _S), _CALL_F)),
    (_line(_bin(_bin(_X, "%", _num("2")), "!=", _num("5"))), _line(("ternary_expression", _bin(_X, "!==", _S), "?", _S, ":", _X))),
    (_line(_call(_dot(_X, "reduce"), _num("1"))), _SAME),
    (_line(_bin(_call(_dot(_dot(_id("a"), "b"), "call"), _X), "===", _S)), _line(("new_expression", "new", _id("VAR_@"), ("arguments", "(", _X, ")")))),
    (_line(_call(_dot(_X, "forEach"), _FUNC)), _LOOP),
    (_line(_call(_dot(_call(_dot(_id("f"), "apply"), _X), "map"), _FUNC)), _SAME),
    (_line(_call(_dot(_id("JSON"), "parse"), _call(_dot(_id("JSON"), "stringify"), _X))), _line(_call(_id("FUNCTION_@"), _X))),
    (("for_in_statement", "for", "(", _K, "of", _O, ")", ("statement_block", "{", _line(_call(_dot(_X, "push"), _K)), "}")), _LOOP),
    (("while_statement", "while", ("parenthesized_expression", "(", _bin(_X, "<", _num("9")), ")"), ("statement_block", "{", _line(_call(_dot(_dot(_X, "apply"), "map"), _id("CLASS_@"))), "}")), _LOOP),
]


def _rows(tree) -> tuple[list[tuple], str]:
    """(rel, parent_rel, depth, end_rel, name, value, begin, end) of a statement's nodes, and its code."""
    out: list[list] = []
    words: list[str] = []

    def walk(t, parent: int, depth: int) -> None:
        name, rest = (t, [t]) if isinstance(t, str) else (t[0], t[1] if isinstance(t[1], list) else None)
        k, begin = len(out), sum(map(len, words)) + len(words)
        out.append([k, parent, depth, k, name, rest[0] if rest else name, begin, begin])
        if rest:
            words.append(rest[0])
        else:
            for child in t[1:]:
                walk(child, k, depth + 1)
        out[k][3], out[k][7] = len(out) - 1, sum(map(len, words)) + len(words) - 1

    walk(tree, -1, 1)
    return [tuple(r) for r in out], " ".join(words)


def _table() -> tuple[list[tuple], list[tuple]]:
    nodes, sizes = [], []
    for t, (before, after) in enumerate(STATEMENTS):
        for form, tree in (("before", before), ("after", before if after is _SAME else after)):
            rows, code = _rows(tree)
            sizes.append((t, form, len(rows), len(code), code))
            nodes += [(t, form, *r) for r in rows]
    return nodes, sizes


#: The depth of the deepest node of any program.
DEPTH = max(r[4] for r in _table()[0])


def _statements(spark: SparkSession, sf_dir: str, read) -> DataFrame:
    """(``id``, ``side``, ``s``, ``t``, ``form``, ``digit``, ``changed``) of every statement."""
    # dealt by program before anything is made of it: what follows stays where its program is
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size").repartition(buckets(spark), "id")
    st = part.select("id", "p_size", F.explode(F.sequence(F.lit(0), F.lit(PER_PROGRAM - 1))).alias("s"))
    changed = (F.col("p_size") + F.col("s")) % 3 == 0
    st = st.select("id", "s", ((F.col("id") * (F.col("s") + 1) + F.col("p_size") + F.col("s")) % len(STATEMENTS)).cast("int").alias("t"), ((F.col("id") + F.col("s")) % 3).cast("string").alias("digit"), changed.alias("changed"))
    return st.withColumn("side", F.explode(F.array(F.lit("base"), F.lit("head")))).withColumn("form", F.when((F.col("side") == "head") & F.col("changed"), "after").otherwise("before"))


def program_nodes(spark: SparkSession, sf_dir: str, read) -> DataFrame:
    """The node table of all programs: ``id``, ``side``, ``idx``, ``parent_idx``, ``depth``, ``subtree_end``, ``name``, ``value``, ``begin``, ``end``, ``s`` (statement, -1 for the root), ``rel``, ``changed``."""
    from pyspark.sql import Window as W

    rows, sizes = _table()
    nodes = spark.createDataFrame(rows, "t int, form string, rel int, parent_rel int, rel_depth int, end_rel int, name string, value string, b int, e int")
    size = spark.createDataFrame([x[:4] for x in sizes], "t int, form string, n int, width int")
    before = W.partitionBy("id", "side").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("id", "side")
    st = (
        _statements(spark, sf_dir, read)
        .join(F.broadcast(size), ["t", "form"])
        .withColumn("first", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("int"))
        .withColumn("at", F.coalesce(F.sum(F.col("width") + 1).over(before), F.lit(0)).cast("int"))
        .withColumn("total", F.sum("n").over(whole).cast("int"))
        .withColumn("length", (F.sum(F.col("width") + 1).over(whole) - 1).cast("int"))
    )
    own = st.join(F.broadcast(nodes), ["t", "form"]).select(
        "id", "side", (F.col("first") + F.col("rel")).alias("idx"), F.when(F.col("parent_rel") < 0, 0).otherwise(F.col("first") + F.col("parent_rel")).alias("parent_idx"), F.col("rel_depth").alias("depth"),
        (F.col("first") + F.col("end_rel")).alias("subtree_end"), "name", F.replace("value", F.lit("@"), F.col("digit")).alias("value"), (F.col("at") + F.col("b")).alias("begin"), (F.col("at") + F.col("e")).alias("end"), "s", "rel", "changed",
    )
    root = st.where("s = 0").select("id", "side", F.lit(0).alias("idx"), F.lit(-1).alias("parent_idx"), F.lit(0).alias("depth"), F.col("total").alias("subtree_end"), F.lit("program").alias("name"), F.lit("program").alias("value"), F.lit(0).alias("begin"), F.col("length").alias("end"), F.lit(-1).alias("s"), F.lit(0).alias("rel"), F.lit(False).alias("changed"))
    return root.unionByName(own)


def program_codes(spark: SparkSession, sf_dir: str, read) -> DataFrame:
    """(``id``, ``side``, ``code``)."""
    size = spark.createDataFrame([(x[0], x[1], x[4]) for x in _table()[1]], "t int, form string, code string")
    st = _statements(spark, sf_dir, read).join(F.broadcast(size), ["t", "form"]).select("id", "side", "s", F.replace("code", F.lit("@"), F.col("digit")).alias("code"))
    return st.groupBy("id", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "code"))), lambda x: x["code"]), " ").alias("code"))


def actions(nodes: DataFrame) -> DataFrame:
    """(``id``, ``side``, ``action``, ``idx``, ``ancestors``): a changed statement's first part goes and comes (its parent is a known ancestor), its last token is updated."""
    tree = nodes.where("changed and rel = 1").select("id", "side", F.when(F.col("side") == "base", "delete-tree").otherwise("insert-tree").alias("action"), "idx", F.array("parent_idx").alias("ancestors"))
    token = nodes.where("changed and rel = 0").select("id", "side", F.lit("update-node").alias("action"), F.col("subtree_end").alias("idx"), F.array().cast("array<int>").alias("ancestors"))
    return together([tree, token])


def matches(nodes: DataFrame) -> DataFrame:
    """(``id``, ``base_idx``, ``head_idx``) of nodes that are the same on both sides."""
    same = nodes.where("not changed")
    base = same.where("side = 'base'").select("id", "s", "rel", F.col("idx").alias("base_idx"))
    return base.join(same.where("side = 'head'").select("id", "s", "rel", F.col("idx").alias("head_idx")), ["id", "s", "rel"]).select("id", "base_idx", "head_idx")


def _literal(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


#: The same tables in SQL: ``nodes``, ``codes``, ``acts``, ``same``.
SQL = f"""
WITH tpl(t, form, rel, parent_rel, rel_depth, end_rel, name, value, b, e) AS (VALUES {_values(_table()[0])}
), sizes(t, form, n, width, code) AS (VALUES {_values(_table()[1])}
), st AS (
  SELECT *, CASE WHEN side = 'head' AND changed THEN 'after' ELSE 'before' END AS form FROM (
    SELECT p_partkey AS id, s::INT AS s, side, ((p_partkey * (s + 1) + p_size + s) % {len(STATEMENTS)})::INT AS t, ((p_partkey + s) % 3)::VARCHAR AS digit, (p_size + s) % 3 = 0 AS changed
    FROM part, range({PER_PROGRAM}) r(s), (VALUES ('base'), ('head')) d(side))
), placed AS (
  SELECT st.*, n, 1 + coalesce(sum(n) OVER w, 0)::INT AS first, coalesce(sum(width + 1) OVER w, 0)::INT AS pos, sum(n) OVER (PARTITION BY id, side)::INT AS total, sum(width + 1) OVER (PARTITION BY id, side)::INT - 1 AS length, replace(code, '@', digit) AS code
  FROM st JOIN sizes USING (t, form) WINDOW w AS (PARTITION BY id, side ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), nodes AS (
  SELECT id, side, 0 AS idx, -1 AS parent_idx, 0 AS depth, total AS subtree_end, 'program' AS name, 'program' AS value, 0 AS begin_, length AS end_, -1 AS s, 0 AS rel, false AS changed FROM placed WHERE s = 0
  UNION ALL SELECT id, side, first + rel, CASE WHEN parent_rel < 0 THEN 0 ELSE first + parent_rel END, rel_depth, first + end_rel, name, replace(value, '@', digit), pos + b, pos + e, s, rel, changed FROM placed JOIN tpl USING (t, form)
), codes AS (SELECT id, side, string_agg(code, ' ' ORDER BY s) AS code FROM placed GROUP BY id, side
), acts AS (
  SELECT id, side, CASE side WHEN 'base' THEN 'delete-tree' ELSE 'insert-tree' END AS action, idx, parent_idx AS anc FROM nodes WHERE changed AND rel = 1
  UNION ALL SELECT id, side, 'update-node', subtree_end, NULL FROM nodes WHERE changed AND rel = 0
), same AS (SELECT b.id, b.idx AS base_idx, h.idx AS head_idx FROM nodes b JOIN nodes h ON b.id = h.id AND b.s = h.s AND b.rel = h.rel WHERE b.side = 'base' AND h.side = 'head' AND NOT b.changed AND NOT h.changed
)"""
