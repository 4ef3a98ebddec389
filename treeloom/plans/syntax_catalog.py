"""Queries of the syntax operators over the programs of ``programs``, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, generalize, observation, patterns, selection, syntax, trees
from ..operators.storage import stored
from . import programs
from .registry import query, read

#: How tables of nodes are laid out.
_NODE = ("id", "side", "idx")
_P = ", ".join("'" + x.replace("'", "''") + "'" for x in syntax.PUNCT)
_OPS = ", ".join(f"'{x}'" for x in syntax.OPERATORS)


def _on(a: str, b: str, extra: str) -> str:
    return f"{a}.id = {b}.id AND {a}.side = {b}.side AND {extra}"


#: Children, calls and operand forms, by joins on the parent.
NAV = (
    programs.SQL
    + f""", named AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY id, side, parent_idx) AS n FROM nodes WHERE parent_idx >= 0 AND name NOT IN ({_P}) WINDOW w AS (PARTITION BY id, side, parent_idx ORDER BY idx)
), operand AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY id, side, parent_idx) AS of_n FROM named WHERE name NOT IN ({_OPS}) WINDOW w AS (PARTITION BY id, side, parent_idx ORDER BY idx)
), props AS (SELECT id, side, parent_idx, arg_min(value, idx) AS prop FROM nodes WHERE name = 'property_identifier' GROUP BY ALL
), call AS (
  SELECT c.id, c.side, c.idx, c.subtree_end, CASE WHEN m.name = 'member_expression' THEN p.prop END AS method, CASE WHEN m.name = 'identifier' THEN m.value END AS func, o.idx AS obj, o.name AS obj_name, o.value AS obj_value, op.prop AS obj_prop
  FROM nodes c LEFT JOIN named m ON {_on("m", "c", "m.parent_idx = c.idx AND m.r = 1")} LEFT JOIN props p ON {_on("p", "m", "p.parent_idx = m.idx")}
  LEFT JOIN named o ON {_on("o", "m", "o.parent_idx = m.idx AND o.r = 1 AND m.name = 'member_expression'")} LEFT JOIN props op ON {_on("op", "o", "op.parent_idx = o.idx")}
  WHERE c.name = 'call_expression'
), arg AS (SELECT x.*, a.parent_idx AS call_idx FROM nodes a JOIN named x ON {_on("x", "a", "x.parent_idx = a.idx")} WHERE a.name = 'arguments'
), op AS (SELECT id, side, parent_idx AS idx, arg_min(name, idx) AS op FROM nodes WHERE name IN ({_OPS}) GROUP BY ALL
), bin AS (
  SELECT b.id, b.side, b.idx, op.op, l.idx AS lhs, r.idx AS rhs, r.name AS rhs_name, r.value AS rhs_value FROM nodes b JOIN op ON {_on("op", "b", "op.idx = b.idx")}
  JOIN operand l ON {_on("l", "b", "l.parent_idx = b.idx AND l.k = 1 AND l.of_n >= 2")} JOIN operand r ON {_on("r", "b", "r.parent_idx = b.idx AND r.k = r.of_n AND r.of_n >= 2")} WHERE b.name = 'binary_expression'
), n_args AS (SELECT id, side, call_idx AS idx, max(n) AS n FROM arg GROUP BY ALL
), frag AS (SELECT id, side, parent_idx AS idx, arg_min(value, idx) AS fragment FROM nodes WHERE name = 'string_fragment' GROUP BY ALL
), prefix AS (
  SELECT c.id, c.side, c.idx FROM call c JOIN n_args a USING (id, side, idx) JOIN arg x ON {_on("x", "c", "x.call_idx = c.idx AND x.r = 1")} JOIN arg y ON {_on("y", "c", "y.call_idx = c.idx AND y.r = 2")}
  WHERE method = 'substr' AND a.n = 2 AND x.name = 'number' AND x.value = '0' AND y.name = 'number' AND try_cast(y.value AS INT) > 0
), to_str AS (SELECT id, side, idx FROM call WHERE method = 'call' AND obj_name = 'identifier' AND obj_value = 'toString'
), obj_str AS (SELECT id, side, idx FROM frag WHERE fragment LIKE '[object%'
), parity AS (SELECT id, side, idx FROM bin WHERE op = '%' AND rhs_name = 'number' AND rhs_value = '2'
), bit AS (SELECT id, side, idx FROM nodes WHERE name = 'number' AND value IN ('0', '1')
), cond AS (
  SELECT i.id, i.side, i.idx, e.idx AS expr FROM nodes i JOIN (SELECT id, side, parent_idx, min(idx) AS idx FROM nodes WHERE name = 'parenthesized_expression' GROUP BY ALL) p ON {_on("p", "i", "p.parent_idx = i.idx")}
  JOIN named e ON {_on("e", "p", "e.parent_idx = p.idx AND e.r = 1")} WHERE i.name = 'if_statement'
)"""
)


def _either(a: str, b: str, ops: str) -> str:
    one = lambda x, at: f"EXISTS (SELECT 1 FROM {x} q WHERE {_on('q', 'bin', f'q.idx = bin.{at}')})"
    return f"op IN ({ops}) AND (({one(a, 'lhs')} AND {one(b, 'rhs')}) OR ({one(a, 'rhs')} AND {one(b, 'lhs')}))"


_EQ, _CMP = "'==', '==='", "'==', '===', '!=', '!=='"
SLOW = (
    NAV
    + f""", body AS (SELECT f.id, f.side, f.idx, b.idx AS body, b.name AS body_name FROM nodes f JOIN named b ON {_on("b", "f", "b.parent_idx = f.idx AND b.r = b.n")} WHERE f.name = 'for_in_statement'
), test AS (
  SELECT b.id, b.side, b.idx, CASE WHEN body_name = 'if_statement' THEN body ELSE s.idx END AS test FROM body b LEFT JOIN named s ON {_on("s", "b", "s.parent_idx = b.body AND s.r = 1 AND b.body_name = 'statement_block' AND s.name = 'if_statement'")}
), slow AS (
  SELECT t.id, t.side, 1 AS pattern_id, CASE WHEN EXISTS (SELECT 1 FROM named k JOIN named r ON {_on("r", "k", "r.parent_idx = k.parent_idx AND r.r = k.r + 1")} WHERE {_on("k", "t", "k.parent_idx = t.idx AND k.name IN ('in', 'of') AND r.name = 'identifier' AND c.obj_name = 'identifier' AND r.value = c.obj_value")}) THEN 'high' ELSE 'medium' END AS confidence, t.idx
  FROM test t JOIN cond ON {_on("cond", "t", "cond.idx = t.test")} JOIN call c ON {_on("c", "t", "c.idx = cond.expr")} WHERE c.method = 'hasOwnProperty'
  UNION ALL SELECT c.id, c.side, 2, 'high', c.idx FROM call c JOIN n_args a USING (id, side, idx) JOIN arg y ON {_on("y", "c", "y.call_idx = c.idx AND y.r = 2")} WHERE method = 'substr' AND a.n = 2 AND y.name = 'number' AND y.value = '1'
  UNION ALL SELECT c.id, c.side, 3, 'high', c.idx FROM call c JOIN n_args a USING (id, side, idx) WHERE func = 'String' AND a.n = 1
  UNION ALL SELECT c.id, c.side, 4, 'high', c.idx FROM call c JOIN arg a ON {_on("a", "c", "a.call_idx = c.idx AND a.n = 1")} WHERE method = 'html' AND a.name = 'string' AND NOT EXISTS (SELECT 1 FROM frag WHERE {_on("frag", "a", "frag.idx = a.idx")})
  UNION ALL SELECT id, side, 5, 'high', idx FROM bin WHERE op IN ({_CMP}) AND EXISTS (SELECT 1 FROM prefix q WHERE {_on("q", "bin", "q.idx IN (bin.lhs, bin.rhs)")})
  UNION ALL SELECT c.id, c.side, 6, 'high', c.idx FROM call c JOIN call d ON {_on("d", "c", "d.idx = c.obj")} WHERE c.method = 'join' AND d.method = 'split'
  UNION ALL SELECT id, side, 7, 'medium', idx FROM bin WHERE {_either("to_str", "obj_str", _EQ)}
  UNION ALL SELECT id, side, 8, 'high', idx FROM bin WHERE {_either("parity", "bit", _EQ)}
  UNION ALL SELECT DISTINCT c.id, c.side, 9, 'low', c.idx FROM call c JOIN arg a ON {_on("a", "c", "a.call_idx = c.idx")} WHERE method = 'reduce' AND a.name IN ('function', 'function_expression', 'arrow_function')
  UNION ALL SELECT c.id, c.side, 10, 'medium', c.idx FROM call c JOIN call d ON {_on("d", "c", "d.idx = c.obj")} WHERE c.method = 'join' AND d.method = 'call' AND d.obj_name = 'member_expression' AND d.obj_prop = 'slice'
)"""
)

_BELOW = "EXISTS (SELECT 1 FROM nodes q WHERE {on})"
AFTER = (
    SLOW
    + f""", kid AS (SELECT p.id, p.side, p.idx, p.name AS of_name, c.idx AS kid, c.name, c.value FROM nodes p JOIN nodes c ON {_on("c", "p", "c.parent_idx = p.idx")}
), equal AS (SELECT DISTINCT id, side, idx FROM kid WHERE of_name = 'binary_expression' AND name IN ('===', '!==')
), after_form AS (
  SELECT id, side, 1 AS pattern_id, idx, NULL AS receiver FROM call WHERE method = 'keys' AND obj_name = 'identifier' AND obj_value = 'Object'
  UNION ALL SELECT DISTINCT k.id, k.side, 2, k.idx, NULL FROM kid k WHERE of_name = 'subscript_expression' AND name IN ('identifier', 'member_expression', 'call_expression') AND NOT EXISTS (SELECT 1 FROM kid b WHERE {_on("b", "k", "b.idx = k.idx AND b.name = '[' AND b.kid < k.kid")})
  UNION ALL SELECT DISTINCT k.id, k.side, 3, k.idx, NULL FROM kid k JOIN kid s ON {_on("s", "k", "s.idx = k.idx")} LEFT JOIN frag f ON {_on("f", "s", "f.idx = s.kid")} WHERE k.of_name = 'binary_expression' AND k.name = '+' AND s.name = 'string' AND coalesce(fragment, '') = ''
  UNION ALL SELECT id, side, 4, idx, CASE WHEN obj_name = 'identifier' THEN obj_value END FROM call WHERE method = 'empty'
  UNION ALL SELECT id, side, 5, idx, NULL FROM call WHERE method = 'charAt'
  UNION ALL SELECT id, side, 6, idx, NULL FROM call WHERE method = 'replace'
  UNION ALL SELECT id, side, 7, idx, NULL FROM kid WHERE of_name = 'binary_expression' AND name = 'instanceof'
  UNION ALL SELECT id, side, 7, idx, NULL FROM call WHERE method = 'isArray'
  UNION ALL SELECT k.id, k.side, 8, k.idx, NULL FROM kid k JOIN bin ON {_on("bin", "k", "bin.idx = k.idx")} WHERE k.name = '&' AND rhs_name = 'number' AND rhs_value = '1'
  UNION ALL SELECT id, side, 9, idx, NULL FROM nodes WHERE name = 'for_statement'
  UNION ALL SELECT DISTINCT i.id, i.side, 10, i.idx, NULL FROM nodes i JOIN equal e ON {_on("e", "i", "e.idx > i.idx AND e.idx <= i.subtree_end")} WHERE i.name = 'if_statement'
  UNION ALL SELECT t.id, t.side, 10, t.idx, NULL FROM nodes t JOIN named c ON {_on("c", "t", "c.parent_idx = t.idx AND c.r = 1")} JOIN equal e ON {_on("e", "t", "e.idx = c.idx")} WHERE t.name = 'ternary_expression'
), anchor AS (SELECT DISTINCT n.id, n.side, n.idx, n.subtree_end FROM nodes n JOIN acts a ON {_on("a", "n", "n.idx IN (a.idx, a.anc)")} WHERE n.depth >= 1
), inserted AS (SELECT DISTINCT f.id FROM nodes f JOIN acts a ON {_on("a", "f", "a.side = 'head' AND a.action LIKE 'insert%'")} JOIN nodes n ON {_on("n", "a", "n.idx = a.idx")} WHERE f.name = 'for_statement' AND f.idx BETWEEN n.idx AND n.subtree_end
), found AS (
  SELECT DISTINCT a.id, pattern_id, receiver FROM after_form a JOIN anchor n ON {_on("n", "a", "a.idx BETWEEN n.idx AND n.subtree_end")} WHERE a.side = 'head' AND (pattern_id <> 9 OR a.id IN (SELECT id FROM inserted))
), cover AS (
  SELECT s.id, s.pattern_id, s.idx, CASE WHEN bool_or(a.idx = s.idx OR coalesce(a.anc = s.idx, false)) THEN 'B1' ELSE 'B2' END AS reason
  FROM slow s JOIN nodes n ON {_on("n", "s", "n.idx = s.idx")} JOIN acts a ON {_on("a", "s", "(a.idx BETWEEN n.idx AND n.subtree_end OR coalesce(a.anc = s.idx, false))")} WHERE s.side = 'base' GROUP BY ALL
), linked AS (
  SELECT DISTINCT c.id, c.pattern_id, c.idx, 'base_' || c.reason || '_head_action' AS diff_reason FROM cover c LEFT JOIN call k ON k.id = c.id AND k.side = 'base' AND k.idx = c.idx JOIN found f ON f.id = c.id AND f.pattern_id = c.pattern_id
  WHERE c.pattern_id <> 4 OR f.receiver IS NULL OR k.obj_name IS DISTINCT FROM 'identifier' OR f.receiver = k.obj_value
)"""
)


def nodes(spark, sf_dir) -> DataFrame:
    """The programs' node table, written once for each use of a query."""
    return stored(programs.program_nodes(spark, sf_dir, read), "programs", _NODE)


def facts(spark, sf_dir) -> DataFrame:
    """The programs' facts, written once; ``named`` is read from ``kids`` again, since it has the same children without the punctuation."""
    return syntax.with_named(stored(syntax.facts(programs.program_nodes(spark, sf_dir, read)).drop("named"), "facts", _NODE))


def linking(spark, sf_dir, *more: str, less: tuple[str, ...] = ()) -> DataFrame:
    """The facts that links and query hits read, written once: no bare tokens (their parents' ``kids`` have them) but the first of a statement, which changes name, and of the columns that only others read ``more`` alone; ``less``: columns that this query doesn't read either."""
    f = syntax.facts(programs.program_nodes(spark, sf_dir, read)).where("rel <= 1 or size(kids) > 0 or not name <=> value")
    return syntax.with_named(stored(f.drop(*{"named", "begin", "end", "s", "consequence", *less} - set(more)), "facts", _NODE))


def calls(f: DataFrame) -> DataFrame:
    """The calls of a table of facts, written once: most matchers join them."""
    return stored(syntax.calls(f), "calls", _NODE)


def matched(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The slow forms' matches, written once, and the calls."""
    c = calls(f)
    return stored(syntax.find_slow_forms(f, c), "matches", _NODE), c


def linked(f: DataFrame) -> DataFrame:
    """The base side's matches with their links to the change, written once."""
    m, c = matched(f)
    # written first, or Spark seeks the changes above them for each of the twelve forms
    after = stored(syntax.find_after_forms(f, c).where("side = 'head'"), "after", _NODE)
    return stored(syntax.link_matches(m, f, programs.actions(f), c, after), "links", _NODE)


@query(programs.SQL + ' SELECT id, side, idx, parent_idx, depth, subtree_end, name, value, begin_ AS begin_at, end_ AS end_at FROM nodes')
def program_nodes(spark, sf_dir):
    return programs.program_nodes(spark, sf_dir, read).select("id", "side", "idx", "parent_idx", "depth", "subtree_end", "name", "value", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


@query(programs.SQL + " SELECT DISTINCT name, value FROM nodes")
def program_node_sets(spark, sf_dir):
    return programs.program_nodes(spark, sf_dir, read).select("name", "value").distinct()


@query(NAV + " SELECT id, side, idx, func AS function, method, obj AS object, obj_name AS object_name, obj_value AS object_value, coalesce(n, 0) AS n_arguments FROM call LEFT JOIN n_args USING (id, side, idx)")
def program_calls(spark, sf_dir):
    """Callee, member object, property and arguments of every call."""
    c = syntax.calls(facts(spark, sf_dir))
    return c.select("id", "side", "idx", "function", "method", "object", "object_name", "object_value", F.size("arguments").cast("long").alias("n_arguments"))


@query(NAV + " SELECT id, side, idx, op, lhs, rhs FROM bin")
def program_binaries(spark, sf_dir):
    return facts(spark, sf_dir).where("name = 'binary_expression' and op is not null and rhs is not null").select("id", "side", "idx", "op", "lhs", "rhs")


@query(
    NAV
    + f""", paren AS (SELECT * FROM named WHERE name = 'parenthesized_expression')
SELECT c.id, c.side, c.idx, c.expr AS condition, min(n.idx) AS consequence FROM cond c LEFT JOIN paren p ON {_on("p", "c", "p.parent_idx = c.idx")} LEFT JOIN named n ON {_on("n", "c", "n.parent_idx = c.idx AND n.r > p.r AND n.name <> 'parenthesized_expression'")} GROUP BY ALL"""
)
def program_ifs(spark, sf_dir):
    """Condition and consequence of every if."""
    f = facts(spark, sf_dir)
    got = syntax.hop(f.where("name = 'if_statement' and paren is not null").select("id", "side", "idx", "paren", "consequence"), f, "paren", condition="first_named")
    return got.where("condition is not null").select("id", "side", "idx", "condition", "consequence")


@query(NAV + f" SELECT s.id, s.side, s.idx, f.idx IS NULL AS is_empty, f.fragment FROM nodes s LEFT JOIN frag f ON {_on('f', 's', 'f.idx = s.idx')} WHERE s.name = 'string'")
def program_strings(spark, sf_dir):
    return facts(spark, sf_dir).where("name = 'string'").select("id", "side", "idx", "is_empty", "fragment")


@query(SLOW + f" SELECT s.id, s.side, pattern_id, confidence, s.idx, begin_ AS begin_at, end_ AS end_at, substr(code, begin_ + 1, least(end_ - begin_, {syntax.SNIPPET})) AS snippet FROM slow s JOIN nodes n ON {_on('n', 's', 'n.idx = s.idx')} JOIN codes c ON c.id = s.id AND c.side = s.side")
def program_slow_forms(spark, sf_dir):
    """The ten matchers, with source."""
    f = facts(spark, sf_dir)
    return syntax.with_snippets(matched(f)[0], f, programs.program_codes(spark, sf_dir, read)).withColumnsRenamed({"begin": "begin_at", "end": "end_at"})


@query(SLOW + " SELECT id, side, string_agg(DISTINCT pattern_id::VARCHAR, ',' ORDER BY pattern_id::VARCHAR) AS patterns FROM slow WHERE pattern_id IN (1, 2, 3, 6, 7, 8, 9) GROUP BY ALL")
def program_pattern_sets(spark, sf_dir):
    got = syntax.patterns_of_cut(matched(facts(spark, sf_dir))[0])
    return got.select("id", "side", F.array_join(F.transform("patterns", lambda p: p.cast("string")), ",").alias("patterns"))


@query(AFTER + " SELECT DISTINCT id, side, pattern_id, idx, receiver FROM after_form")
def program_after_forms(spark, sf_dir):
    f = facts(spark, sf_dir)
    return syntax.find_after_forms(f, calls(f)).distinct()


@query(AFTER + " SELECT id, pattern_id, idx, reason FROM cover")
def program_base_covered(spark, sf_dir):
    n = facts(spark, sf_dir)
    got = syntax.base_covered(matched(n)[0].select("id", "side", "pattern_id", "idx"), n, programs.actions(n))
    return stored(got, "covered", _NODE).select("id", "pattern_id", "idx", "reason")


@query(AFTER + " SELECT s.id, s.pattern_id, s.confidence, s.idx, l.idx IS NOT NULL AS diff_linked, l.diff_reason FROM slow s LEFT JOIN linked l ON l.id = s.id AND l.pattern_id = s.pattern_id AND l.idx = s.idx WHERE s.side = 'base'")
def program_diff_links(spark, sf_dir):
    return linked(linking(spark, sf_dir)).select("id", "pattern_id", "confidence", "idx", "diff_linked", "diff_reason")


@query(AFTER + " SELECT s.pattern_id, count(*) AS n_matches, count(DISTINCT s.id) AS n_records, count(l.idx) AS n_linked, count(DISTINCT l.id) AS n_linked_records FROM slow s LEFT JOIN linked l ON l.id = s.id AND l.pattern_id = s.pattern_id AND l.idx = s.idx WHERE s.side = 'base' GROUP BY ALL")
def program_link_summary(spark, sf_dir):
    """Per pattern: matches, records, linked ones."""
    got = linked(linking(spark, sf_dir))
    yes = F.col("diff_linked")
    return got.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("id").alias("n_records"), F.count_if(yes).alias("n_linked"), F.count_distinct(F.when(yes, F.col("id"))).alias("n_linked_records"))


@query(
    AFTER
    + f""", loops AS (SELECT f.*, EXISTS (SELECT 1 FROM nodes q WHERE {_on("q", "f", "q.parent_idx = f.idx AND q.name = 'of'")}) AS has_of FROM nodes f WHERE name = 'for_in_statement'
), inner_body AS (SELECT l.id, l.side, l.idx, l.has_of, b.idx AS lo, b.subtree_end AS hi FROM loops l JOIN named b ON {_on("b", "l", "b.parent_idx = l.idx AND b.r = b.n")}
), asks AS (SELECT DISTINCT i.id, i.side, i.idx FROM nodes i JOIN nodes p ON {_on("p", "i", "p.parent_idx = i.idx AND p.name = 'parenthesized_expression'")} JOIN call c ON {_on("c", "p", "c.idx BETWEEN p.idx AND p.subtree_end")} WHERE i.name = 'if_statement' AND c.method = 'hasOwnProperty')
SELECT id, side, 1 AS query_id, idx FROM loops WHERE NOT has_of
UNION ALL SELECT id, side, 2, idx FROM call WHERE method = 'forEach'
UNION ALL SELECT DISTINCT b.id, b.side, 3, b.idx FROM inner_body b JOIN asks a ON {_on("a", "b", "a.idx BETWEEN lo AND hi")} WHERE NOT has_of
UNION ALL SELECT c.id, c.side, 4, c.idx FROM call c JOIN call d ON {_on("d", "c", "d.idx = c.obj")} WHERE c.method = 'map' AND d.method = 'apply'
UNION ALL SELECT DISTINCT c.id, c.side, 5, c.idx FROM call c JOIN arg a ON {_on("a", "c", "a.call_idx = c.idx")} JOIN call d ON {_on("d", "c", "d.idx = a.idx")} WHERE c.method = 'parse' AND d.method = 'stringify'
UNION ALL SELECT DISTINCT b.id, b.side, 6, b.idx FROM inner_body b JOIN call c ON {_on("c", "b", "c.idx BETWEEN lo AND hi")} WHERE has_of AND c.method = 'push'"""
)
def program_query_hits(spark, sf_dir):
    f = linking(spark, sf_dir, less=("parent_idx", "depth", "rel", "changed", "op", "lhs", "rhs", "right", "is_empty", "fragment"))
    return stored(syntax.query_hits(f, calls(f)), "hits", _NODE)


def _slot_sql(level: int) -> str:
    skipped = ", ".join("'" + x.replace("'", "''") + "'" for x in syntax.SKIPPED)
    second = "CASE WHEN in_regex THEN 'r' WHEN name = 'number' THEN 'n' WHEN name = 'string_fragment' THEN 's' END" if level >= 2 else "NULL"
    return f""", shown AS (
  SELECT n.*, EXISTS (SELECT 1 FROM nodes q WHERE {_on("q", "n", "q.name = 'regex' AND n.idx > q.idx AND n.idx <= q.subtree_end")}) AS in_regex FROM nodes n WHERE name NOT IN ({skipped})
), marked AS (SELECT *, CASE WHEN value LIKE 'VAR\\_%' ESCAPE '\\' THEN 'v' WHEN value LIKE 'FUNCTION\\_%' ESCAPE '\\' THEN 'f' END AS m1, {second} AS m2 FROM shown
), uses AS (SELECT id, side, idx, value, m1 AS marker FROM marked WHERE m1 IS NOT NULL UNION ALL SELECT id, side, idx, value, m2 FROM marked WHERE m2 IS NOT NULL
), slots AS (SELECT id, side, marker, value, '$' || marker || (row_number() OVER (PARTITION BY id, side, marker ORDER BY min(idx)) - 1) AS slot FROM uses GROUP BY id, side, marker, value
), abstracted AS (SELECT m.*, s.slot, coalesce(s.slot, m.value) AS abstract_value FROM marked m LEFT JOIN slots s ON {_on("s", "m", "s.marker = coalesce(m.m2, m.m1) AND s.value = m.value")})"""


@query(programs.SQL + _slot_sql(1) + " SELECT id, side, idx, slot, abstract_value FROM abstracted")
def program_abstract_level1(spark, sf_dir):
    return syntax.abstract(nodes(spark, sf_dir), 1).select("id", "side", "idx", "slot", "abstract_value")


@query(programs.SQL + _slot_sql(2) + " SELECT id, side, idx, slot, abstract_value FROM abstracted")
def program_abstract_level2(spark, sf_dir):
    return syntax.abstract(nodes(spark, sf_dir), 2).select("id", "side", "idx", "slot", "abstract_value")


@query(programs.SQL + _slot_sql(2) + " SELECT id, side, string_agg(regexp_replace(abstract_value, '^(\\$[vfkns])[0-9]+$', '\\1'), ' ' ORDER BY idx) AS tokens FROM abstracted WHERE idx = subtree_end GROUP BY ALL")
def program_tokens(spark, sf_dir):
    return syntax.tokens(syntax.abstract(nodes(spark, sf_dir), 2)).select("id", "side", F.array_join("tokens", " ").alias("tokens"))


@query(
    programs.SQL
    + """, leaf AS (SELECT id, side, string_agg(value, ' ' ORDER BY idx) AS v, list(value) AS t FROM nodes WHERE idx = subtree_end GROUP BY id, side)
SELECT id, side, k::INT AS pattern_id, CASE k WHEN 1 THEN list_contains(t, 'hasOwnProperty') AND list_contains(t, 'in') WHEN 2 THEN list_contains(t, 'substr') WHEN 3 THEN list_contains(t, 'String') AND NOT list_contains(t, 'new') AND NOT list_contains(t, 'instanceof')
  WHEN 6 THEN list_contains(t, 'split') WHEN 7 THEN list_contains(t, 'toString') AND list_contains(t, 'call') WHEN 8 THEN list_contains(t, '%') AND list_contains(t, '2') AND len(list_filter(t, lambda x: NOT (x LIKE '$%' OR x IN ('%', '2', '0', '1', '==', '===')))) = 0 ELSE list_contains(t, 'reduce') END AS holds
FROM leaf, (VALUES (1), (2), (3), (6), (7), (8), (9)) p(k)"""
)
def program_signatures(spark, sf_dir):
    """The lexical signatures of seven forms on every program's tokens."""
    leaf = programs.program_nodes(spark, sf_dir, read).where("idx = subtree_end").groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("t"))
    # one blank inside a token would part it, as in the strings "[object Array]"
    leaf = leaf.select("id", "side", F.array_join(F.transform("t", lambda x: F.replace(x["value"], F.lit(" "), F.lit("_"))), " ").alias("v"))
    got = leaf.withColumn("pattern_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 6, 7, 8, 9)))))
    return got.select("id", "side", "pattern_id", syntax.signature_holds(F.col("pattern_id"), F.col("v")).alias("holds"))


# --- cuts on both sides -----------------------------------------------------------

_BOUNDARY = ", ".join(f"'{x}'" for x in trees.SCOPE_BOUNDARY)
SCOPES = (
    programs.SQL
    + f""", up AS (SELECT a.id, a.side, a.idx AS act, a.action, n.idx, n.name, n.depth, n.subtree_end FROM acts a JOIN nodes n ON n.id = a.id AND n.side = a.side AND a.idx > n.idx AND a.idx <= n.subtree_end
), act AS (
  SELECT a.id, a.side, a.action, a.idx, n.subtree_end AS hi, n.parent_idx, p.subtree_end AS parent_end,
    coalesce((SELECT max(u.idx) FROM up u WHERE u.id = a.id AND u.side = a.side AND u.act = a.idx AND u.name IN ({_BOUNDARY})), (SELECT min(u.idx) FROM up u WHERE u.id = a.id AND u.side = a.side AND u.act = a.idx), a.idx) AS bound
  FROM acts a JOIN nodes n ON n.id = a.id AND n.side = a.side AND n.idx = a.idx LEFT JOIN nodes p ON p.id = a.id AND p.side = a.side AND p.idx = n.parent_idx
), act2 AS (
  SELECT act.*, b.subtree_end AS bound_end, CASE WHEN bound = act.idx THEN NULL ELSE coalesce((SELECT min(u.idx) FROM up u WHERE u.id = act.id AND u.side = act.side AND u.act = act.idx AND u.idx > bound), bound) END AS top
  FROM act JOIN nodes b ON b.id = act.id AND b.side = act.side AND b.idx = bound
), spans AS (
  SELECT id, side, idx AS act, action, 'Diff' AS scope, idx AS lo, hi FROM act2
  UNION ALL SELECT id, side, idx, action, 'Brother', CASE WHEN parent_idx < 0 THEN idx ELSE parent_idx + 1 END, CASE WHEN parent_idx < 0 THEN hi ELSE parent_end END FROM act2
  UNION ALL SELECT id, side, idx, action, 'ExParent', idx, hi FROM act2
  UNION ALL SELECT a.id, a.side, a.idx, action, 'ExParent', t.idx + 1, t.subtree_end FROM act2 a JOIN nodes t ON t.id = a.id AND t.side = a.side AND t.idx = a.top
  UNION ALL SELECT id, side, idx, action, 'Parent', bound, bound_end FROM act2
), block AS (SELECT DISTINCT s.id, s.side, act, action, scope, n.idx FROM spans s JOIN nodes n ON n.id = s.id AND n.side = s.side AND n.idx BETWEEN lo AND hi
), cut AS (SELECT DISTINCT id, side, scope, idx FROM block)"""
)


def _blocks(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir)
    return trees.scope_blocks(n, programs.actions(n))


@query(SCOPES + " SELECT id, side, act, action, scope, count(*) AS n_nodes, min(idx) AS first, max(idx) AS last FROM block GROUP BY ALL")
def program_scope_blocks(spark, sf_dir):
    """The four scopes of each action, on both sides."""
    return _blocks(spark, sf_dir).groupBy("id", "side", F.col("act"), "action", "scope").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query(SCOPES + " SELECT id, side, scope, count(*) AS n_nodes, count(d.idx) AS n_diff, string_agg(d.idx::VARCHAR, ',' ORDER BY d.idx) AS diff_nodes FROM cut c LEFT JOIN (SELECT id, side, idx FROM cut WHERE scope = 'Diff') d USING (id, side, idx) GROUP BY ALL")
def program_scope_cuts(spark, sf_dir):
    """Merged scopes of each record and side, with the changed nodes in them."""
    got = trees.merged_scopes(_blocks(spark, sf_dir))
    return got.select("id", "side", "scope", F.size("nodes").cast("long").alias("n_nodes"), F.size("diff_nodes").cast("long").alias("n_diff"), F.when(F.size("diff_nodes") > 0, F.array_join(F.transform("diff_nodes", lambda i: i.cast("string")), ",")).alias("diff_nodes"))


@query(
    programs.SQL
    + """, act AS (SELECT a.action, n.* FROM acts a JOIN nodes n ON n.id = a.id AND n.side = a.side AND n.idx = a.idx WHERE a.side = 'base'
), diff AS (SELECT a.id, a.idx AS act, a.action, n.idx FROM act a JOIN nodes n ON n.id = a.id AND n.side = 'base' AND n.depth > 0 AND n.begin_ >= a.begin_ AND n.end_ <= a.end_
), sib AS (SELECT a.id, a.idx AS act, a.action, n.idx FROM act a JOIN nodes n ON n.id = a.id AND n.side = 'base' AND n.parent_idx = a.parent_idx WHERE a.depth > 0
), outer1 AS (SELECT a.id, a.idx AS act, a.action, n.idx, n.begin_ FROM act a JOIN nodes p ON p.id = a.id AND p.side = 'base' AND p.idx = a.parent_idx JOIN nodes n ON n.id = a.id AND n.side = 'base' AND n.parent_idx = p.parent_idx AND n.idx < a.idx WHERE a.depth >= 2
), lead1 AS (SELECT id, act, action, min(idx) AS idx, arg_min(begin_, idx) AS begin_ FROM outer1 GROUP BY ALL
), same1 AS (SELECT l.id, act, action, n.idx FROM lead1 l JOIN nodes n ON n.id = l.id AND n.side = 'base' AND n.depth > 0 AND n.idx <= l.idx AND n.begin_ = l.begin_
), parent_diff AS (SELECT * FROM diff UNION SELECT * FROM sib UNION SELECT id, act, action, idx FROM outer1 UNION SELECT * FROM same1
), start2 AS (SELECT a.id, a.idx AS act, a.action, n.* EXCLUDE (id, side) FROM act a LEFT JOIN lead1 l ON l.id = a.id AND l.act = a.idx AND l.action = a.action JOIN nodes n ON n.id = a.id AND n.side = 'base' AND n.idx = coalesce(l.idx, a.idx)
), sib2 AS (SELECT a.id, a.act, a.action, n.idx FROM start2 a JOIN nodes n ON n.id = a.id AND n.side = 'base' AND n.parent_idx = a.parent_idx WHERE a.depth > 0
), outer2 AS (SELECT a.id, a.act, a.action, n.idx, n.begin_ FROM start2 a JOIN nodes p ON p.id = a.id AND p.side = 'base' AND p.idx = a.parent_idx JOIN nodes n ON n.id = a.id AND n.side = 'base' AND n.parent_idx = p.parent_idx AND n.idx < a.idx WHERE a.depth >= 2
), lead2 AS (SELECT id, act, action, min(idx) AS idx, arg_min(begin_, idx) AS begin_ FROM outer2 GROUP BY ALL
), same2 AS (SELECT l.id, act, action, n.idx FROM lead2 l JOIN nodes n ON n.id = l.id AND n.side = 'base' AND n.depth > 0 AND n.idx <= l.idx AND n.begin_ = l.begin_
), around AS (SELECT * FROM parent_diff UNION SELECT * FROM sib2 UNION SELECT id, act, action, idx FROM outer2 UNION SELECT * FROM same2)
SELECT id, act, action, scope, count(*) AS n_nodes, sum(idx)::BIGINT AS total FROM (SELECT DISTINCT *, 'diff' AS scope FROM diff UNION ALL SELECT *, 'parent_diff' FROM parent_diff UNION ALL SELECT *, 'around_parent' FROM around) GROUP BY ALL"""
)
def program_sigma_blocks(spark, sf_dir):
    """The three growing cuts around each action of the base side."""
    n = nodes(spark, sf_dir)
    got = trees.sigma_blocks(n.where("side = 'base'"), programs.actions(n).where("side = 'base'"))
    return got.groupBy("id", "act", "action", "scope").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("idx").alias("total"))


@query(
    programs.SQL
    + """, moved AS (SELECT b.id, 'move-tree' AS action, b.idx FROM nodes b WHERE side = 'base' AND NOT changed AND rel = 0 AND s >= 0
), mapped AS (SELECT DISTINCT m.id, m.action, s.head_idx AS idx FROM moved m JOIN same s ON s.id = m.id AND s.base_idx = m.idx), head AS (SELECT id, action, idx FROM acts WHERE side = 'head')
SELECT * FROM head UNION ALL SELECT * FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.id = m.id AND h.idx = m.idx)"""
)
def program_augmented_head_actions(spark, sf_dir):
    """Head actions, and the base side's moves and updates carried over by the matching; here whole unchanged statements count as moved."""
    n = nodes(spark, sf_dir)
    acts = programs.actions(n)
    moved = n.where("side = 'base' and not changed and rel = 0 and s >= 0").select("id", "side", F.lit("move-tree").alias("action"), "idx", F.array().cast("array<int>").alias("ancestors"))
    return trees.augmented_head_actions(acts.unionByName(moved), programs.matches(n)).select("id", "action", "idx")


# --- declarative patterns ---------------------------------------------------------

_ANY = {"name": "*"}
_ASK = {"name": "call_expression", "match": "descendant", "children": [{"name": "member_expression", "children": [{"name": "*", "bind": "o"}, {"name": "property_identifier", "value": "hasOwnProperty"}]}]}
DECLARED = [
    {"id": 1, "root": {"name": "for_in_statement", "children": [{"name": "identifier", "bind": "k"}, {"name": "in"}, {"name": "*", "bind": "o"}, {"name": "if_statement", "match": "descendant", "children": [_ASK, {"name": "while", "optional": True}]}]}},
    {"id": 2, "root": {"name": "arguments", "children_mode": "exact", "children": [{"name": "number", "value": "0"}, {"name": ["number", "string"]}]}},
    {"id": 3, "root": {"name": "expression_statement", "text": {"regex": "substr"}, "children": [{"name": "identifier", "match": "descendant", "value": {"regex": "^[sx][0-2]$"}}]}},
]
_IGN = ", ".join("'" + x.replace("'", "''") + "'" for x in patterns.IGNORED)
_DECLARED = (
    programs.SQL
    + f""", txt AS (SELECT n.*, substr(code, begin_ + 1, end_ - begin_) AS text FROM nodes n JOIN codes c ON c.id = n.id AND c.side = n.side
), kids AS (SELECT *, row_number() OVER (PARTITION BY id, side, parent_idx ORDER BY idx) AS r, count(*) OVER (PARTITION BY id, side, parent_idx) AS n FROM txt WHERE name NOT IN ({_IGN})
), hits AS (
  SELECT DISTINCT f.id, f.side, 1 AS pattern_id, f.idx, f.text FROM txt f JOIN kids a ON {_on("a", "f", "a.parent_idx = f.idx AND a.name = 'identifier'")} JOIN kids b ON {_on("b", "f", "b.parent_idx = f.idx AND b.name = 'in' AND b.idx > a.idx")} JOIN kids o ON {_on("o", "f", "o.parent_idx = f.idx AND o.idx > b.idx")}
    JOIN kids i ON {_on("i", "f", "i.idx > o.idx AND i.idx <= f.subtree_end AND i.name = 'if_statement'")} JOIN kids c ON {_on("c", "i", "c.idx > i.idx AND c.idx <= i.subtree_end AND c.name = 'call_expression'")}
    JOIN kids m ON {_on("m", "c", "m.parent_idx = c.idx AND m.name = 'member_expression'")} JOIN kids x ON {_on("x", "m", "x.parent_idx = m.idx AND x.text = o.text")} JOIN kids p ON {_on("p", "m", "p.parent_idx = m.idx AND p.idx > x.idx AND p.name = 'property_identifier' AND p.value = 'hasOwnProperty'")}
  WHERE f.name = 'for_in_statement'
  UNION ALL SELECT f.id, f.side, 2, f.idx, f.text FROM txt f JOIN kids a ON {_on("a", "f", "a.parent_idx = f.idx AND a.r = 1 AND a.n = 2 AND a.name = 'number' AND a.value = '0'")} JOIN kids b ON {_on("b", "f", "b.parent_idx = f.idx AND b.r = 2 AND b.name IN ('number', 'string')")} WHERE f.name = 'arguments'
  UNION ALL SELECT DISTINCT f.id, f.side, 3, f.idx, f.text FROM txt f JOIN kids x ON {_on("x", "f", "x.idx > f.idx AND x.idx <= f.subtree_end AND x.name = 'identifier' AND regexp_matches(x.value, '^[sx][0-2]$')")} WHERE f.name = 'expression_statement' AND regexp_matches(f.text, 'substr')
)"""
)


def texts(spark, sf_dir) -> DataFrame:
    return stored(patterns.with_text(programs.program_nodes(spark, sf_dir, read), programs.program_codes(spark, sf_dir, read)), "texts")


@query(_DECLARED + f" SELECT id, side, pattern_id, idx, substr(text, 1, {patterns.SNIPPET}) AS snippet FROM hits")
def program_declared_patterns(spark, sf_dir):
    """Declarative patterns with bindings, exact children, descendants, regular expressions and an optional child."""
    return patterns.find_all(texts(spark, sf_dir), DECLARED).select("id", "side", "pattern_id", "idx", "snippet")


_SLOW_SPECS = [{"id": 3, "root": {"name": "call_expression", "children": [{"name": "identifier", "value": "String"}, {"name": "arguments", "children_mode": "exact", "children": [_ANY]}]}}, {"id": 6, "root": {"name": "property_identifier", "value": "split"}}]
_FAST_SPECS = [{"id": 3, "root": {"name": "binary_expression", "children": [{"name": "string"}, {"name": "+"}]}}, {"id": 6, "root": {"name": "property_identifier", "value": "replace"}}]


@query(
    programs.SQL
    + f""", hit AS (
  SELECT DISTINCT c.id, c.side, 3 AS pattern_id, 'slow' AS kind FROM nodes c JOIN nodes i ON {_on("i", "c", "i.parent_idx = c.idx AND i.name = 'identifier' AND i.value = 'String'")} JOIN nodes a ON {_on("a", "c", "a.parent_idx = c.idx AND a.name = 'arguments'")}
    WHERE c.name = 'call_expression' AND (SELECT count(*) FROM nodes x WHERE {_on("x", "a", f"x.parent_idx = a.idx AND x.name NOT IN ({_IGN})")}) = 1
  UNION SELECT id, side, 6, 'slow' FROM nodes WHERE name = 'property_identifier' AND value = 'split'
  UNION SELECT DISTINCT b.id, b.side, 3, 'fast' FROM nodes b JOIN nodes s ON {_on("s", "b", "s.parent_idx = b.idx AND s.name = 'string'")} JOIN nodes p ON {_on("p", "b", "p.parent_idx = b.idx AND p.name = '+' AND p.idx > s.idx")} WHERE b.name = 'binary_expression'
  UNION SELECT id, side, 6, 'fast' FROM nodes WHERE name = 'property_identifier' AND value = 'replace'
), flag AS (SELECT id, pattern_id, bool_or(kind = 'slow' AND side = 'base') AS sb, bool_or(kind = 'slow' AND side = 'head') AS sh, bool_or(kind = 'fast' AND side = 'base') AS fb, bool_or(kind = 'fast' AND side = 'head') AS fh FROM hit GROUP BY ALL)
SELECT id, pattern_id, sb AS slow_base, sb AND sh AS slow_head, fh AND fb AS fast_base, fh AS fast_head, sb AND NOT sh AND fh AND NOT fb AS transition FROM flag WHERE sb OR fh"""
)
def program_transitions(spark, sf_dir):
    t = texts(spark, sf_dir)
    hits = lambda specs: patterns.find_all(t, specs).select("id", "side", "pattern_id").distinct()
    return patterns.transitions(hits(_SLOW_SPECS), hits(_FAST_SPECS))


# --- generalisation -----------------------------------------------------------------

_ADDRESSED = (
    programs.SQL
    + """, placed_nodes AS (SELECT *, row_number() OVER (PARTITION BY id, side, parent_idx ORDER BY idx) - 1 AS place FROM nodes WHERE side = 'base'
), adr AS (SELECT n.id, n.idx, any_value(n.name) AS name, any_value(n.value) AS value, string_agg(CASE WHEN a.depth = 0 THEN '0' ELSE lpad(a.place::VARCHAR, 5, '0') END, '.' ORDER BY a.depth) AS address FROM placed_nodes n JOIN placed_nodes a ON a.id = n.id AND n.idx BETWEEN a.idx AND a.subtree_end GROUP BY n.id, n.idx
)"""
)


def _addressed(spark, sf_dir) -> DataFrame:
    n = programs.program_nodes(spark, sf_dir, read).where("side = 'base'")
    return stored(generalize.addressed(stored(n, "base"), programs.DEPTH), "addresses")


@query(_ADDRESSED + " SELECT id, idx, address FROM adr")
def program_addresses(spark, sf_dir):
    return _addressed(spark, sf_dir).select("id", "idx", "address")


_CLUSTER_SQL = "((id % 60 + 1) * 100 + p_size)::VARCHAR"


@query(
    _ADDRESSED
    + f""", tree AS (SELECT {_CLUSTER_SQL} AS cluster, id AS tree, address, name, value FROM adr JOIN part ON p_partkey = id
), total AS (SELECT cluster, count(DISTINCT tree) AS n_trees FROM tree GROUP BY cluster
), g AS (SELECT cluster, address, count(*) AS n, min(name) AS a, max(name) AS b, min(value) AS v, max(value) AS w, regexp_replace(address, '[.]?[0-9]+$', '') AS parent FROM tree GROUP BY ALL
), k AS (SELECT g.*, CASE WHEN n < n_trees THEN 'tail_hole' WHEN a <> b THEN 'node_hole' WHEN v <> w THEN 'value_hole' ELSE 'concrete' END AS kind FROM g JOIN total USING (cluster)
), f AS (SELECT *, min(CASE WHEN kind = 'tail_hole' THEN address END) OVER (PARTITION BY cluster, parent) AS first FROM k
), kept AS (SELECT * FROM f WHERE kind <> 'tail_hole' OR address = first)
SELECT cluster, address, kind, CASE WHEN kind IN ('concrete', 'value_hole') THEN a END AS name, CASE WHEN kind = 'concrete' THEN v END AS value FROM kept x
WHERE NOT EXISTS (SELECT 1 FROM kept h WHERE h.cluster = x.cluster AND h.kind IN ('tail_hole', 'node_hole') AND starts_with(x.address, h.address || '.'))"""
)
def program_generalisations(spark, sf_dir):
    """The least general tree of groups of programs."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (((F.col("p_partkey") % 60) + 1) * 100 + F.col("p_size")).cast("string").alias("cluster"))
    got = _addressed(spark, sf_dir).join(part, "id")
    return generalize.anti_unify(got.select("cluster", F.col("id").alias("tree"), "address", "name", "value"))


@query(SCOPES + " SELECT c.id, c.side, c.idx, coalesce(max(u.idx), -1) AS up FROM cut c JOIN nodes n ON n.id = c.id AND n.side = c.side AND n.idx = c.idx LEFT JOIN (SELECT cut.*, subtree_end FROM cut JOIN nodes USING (id, side, idx) WHERE scope = 'Brother') u ON u.id = c.id AND u.side = c.side AND c.idx > u.idx AND c.idx <= u.subtree_end WHERE c.scope = 'Brother' GROUP BY ALL")
def program_cut_forest(spark, sf_dir):
    """The forest of every Brother cut: nodes hang under their nearest ancestor in the cut."""
    n = nodes(spark, sf_dir)
    cut = trees.scope_blocks(n, programs.actions(n)).where("scope = 'Brother'").select("id", "side", "idx").distinct()
    return generalize.reattached(cut, n)


# --- choosing a scope, features, summaries ------------------------------------------

_CAND = (
    SCOPES
    + f""", member AS (SELECT c.id, c.side, c.scope, CASE c.scope WHEN 'Diff' THEN 1 WHEN 'Brother' THEN 2 WHEN 'ExParent' THEN 3 ELSE 4 END AS place, n.idx, n.subtree_end = n.idx AS leaf, n.name, n.value FROM cut c JOIN nodes n ON n.id = c.id AND n.side = c.side AND n.idx = c.idx
), cand0 AS (
  SELECT id, side, scope, any_value(place) AS place, list(idx ORDER BY idx) AS node_list, string_agg(regexp_escape(value), '\\s*' ORDER BY idx) FILTER (WHERE leaf AND trim(value) <> '') AS regex, count(*) FILTER (WHERE leaf) AS n_leaf,
    bool_or(leaf AND (name IN ({", ".join(f"'{x}'" for x in selection.TRIVIAL_NAMES)}) OR value IN ({", ".join(programs._literal(x) for x in selection.TRIVIAL_VALUES)}) OR trim(value) = '' OR starts_with(value, 'VAR_') OR starts_with(value, 'FUNCTION_') OR starts_with(value, 'KEY_'))) AS trivial
  FROM member GROUP BY id, side, scope
), cand AS (SELECT id, side, node_list, min(place) AS place, arg_min(scope, place) AS scope, arg_min(regex, place) AS regex FROM cand0 WHERE NOT (n_leaf = 1 AND trivial) GROUP BY id, side, node_list
), diff_of AS (SELECT id, side, coalesce(max(CASE WHEN scope = 'Diff' THEN place END), arg_min(place, len(node_list) * 10 + place)) AS place FROM cand GROUP BY id, side
), base AS (SELECT c.id, c.side, c.node_list AS diff FROM cand c JOIN diff_of d ON d.id = c.id AND d.side = c.side AND d.place = c.place
), ups AS (SELECT DISTINCT b.id, b.side, n.parent_idx FROM (SELECT id, side, unnest(diff) AS idx FROM base) b JOIN nodes n ON n.id = b.id AND n.side = b.side AND n.idx = b.idx WHERE n.parent_idx >= 0
), share AS (SELECT c.id, c.side, c.place, k.parent_idx, count(*) FILTER (WHERE list_contains(c.node_list, k.idx))::DOUBLE / count(*) AS share FROM cand c JOIN ups u ON u.id = c.id AND u.side = c.side JOIN nodes k ON k.id = u.id AND k.side = u.side AND k.parent_idx = u.parent_idx GROUP BY ALL
), score AS (
  SELECT c.id, c.side, c.scope, c.place, len(c.node_list) AS n_nodes, regexp_matches(code, regex) AS found, len(diff)::DOUBLE / len(c.node_list) AS dr, coalesce((SELECT avg(share) FROM share s WHERE s.id = c.id AND s.side = c.side AND s.place = c.place), 0) AS sc
  FROM cand c JOIN base b ON b.id = c.id AND b.side = c.side JOIN codes o ON o.id = c.id AND o.side = c.side
), final AS (SELECT *, CASE WHEN dr + sc > 0 THEN 2 * dr * sc / (dr + sc) ELSE 0 END AS score FROM score)"""
)


def _candidates(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir)
    cut = stored(trees.scope_spans(n, programs.actions(n)).select("id", "side", "scope", F.explode(F.sequence("lo", "end")).alias("idx")).distinct(), "cut", _NODE)
    found = selection.with_search(selection.candidates(n, cut), programs.program_codes(spark, sf_dir, read))
    return stored(selection.scored(stored(found, "candidates", _NODE[:2]), n), "scored", _NODE[:2])


@query(_CAND + " SELECT id, side, scope, n_nodes, coalesce(found, false) AS found, round(dr, 9) AS diff_ratio, round(sc, 9) AS completeness, round(score, 9) AS score FROM final")
def program_scope_candidates(spark, sf_dir):
    """Scopes that differ and tell something, searched in the source and scored, on both sides."""
    got = _candidates(spark, sf_dir)
    return got.select("id", "side", "scope", F.size("nodes").cast("long").alias("n_nodes"), "found", *[F.round(c, 9).alias(c) for c in ("diff_ratio", "completeness", "score")])


@query(_CAND + " SELECT id, side, arg_max(scope, (round(score, 12), -place)) AS scope, round(max(score), 9) AS score FROM final WHERE found GROUP BY ALL")
def program_best_scopes(spark, sf_dir):
    return selection.best_scope(_candidates(spark, sf_dir)).withColumn("score", F.round("score", 9))


_MARKS = ", ".join(f"'{x}'" for x in features.MARKS)
_FEATURES = (
    NAV
    + f""", kid AS (SELECT * FROM nodes WHERE parent_idx >= 0
), spot AS (SELECT f.id, f.side, f.idx, min(k.idx) FILTER (WHERE k.name = '(') AS open, max(k.idx) FILTER (WHERE k.name = ')') AS shut FROM nodes f JOIN kid k ON {_on("k", "f", "k.parent_idx = f.idx")} WHERE f.name = 'for_statement' GROUP BY ALL
), head AS (SELECT s.id, s.side, s.idx, list(k.idx ORDER BY k.idx) AS h FROM spot s JOIN kid k ON {_on("k", "s", "k.parent_idx = s.idx AND k.idx > open AND k.idx < shut")} GROUP BY ALL
), word AS (SELECT f.id, f.side, f.idx, min(k.idx) AS op, bool_or(k.name = 'of') AS has_of FROM nodes f JOIN kid k ON {_on("k", "f", "k.parent_idx = f.idx AND k.name IN ('in', 'of')")} WHERE f.name = 'for_in_statement' GROUP BY ALL
), raw AS (
  SELECT f.id, f.side, f.idx, 'for_statement' AS feature_type, NULL AS value, h[1] AS i, h[2] AS c, h[3] AS a, NULL::INT AS it FROM nodes f LEFT JOIN head USING (id, side, idx) WHERE f.name = 'for_statement'
  UNION ALL SELECT w.id, w.side, w.idx, CASE WHEN has_of THEN 'for_of_statement' ELSE 'for_in_statement' END, NULL, NULL, NULL, NULL, (SELECT min(k.idx) FROM kid k WHERE {_on("k", "w", "k.parent_idx = w.idx AND k.idx > w.op AND k.name <> ')' AND k.name NOT IN ('in', 'of')")}) FROM word w
  UNION ALL SELECT f.id, f.side, f.idx, f.name, NULL, NULL, (SELECT min(k.idx) FROM kid k WHERE {_on("k", "f", "k.parent_idx = f.idx AND k.name = 'parenthesized_expression'")}), NULL, NULL FROM nodes f WHERE f.name IN ('while_statement', 'do_statement')
  UNION ALL SELECT id, side, idx, 'if_statement', NULL, NULL, NULL, NULL, NULL FROM nodes WHERE name = 'if_statement'
  UNION ALL SELECT id, side, idx, 'call_exp', value, NULL, NULL, NULL, NULL FROM nodes WHERE name = 'property_identifier'
  UNION ALL SELECT f.id, f.side, f.idx, 'new_exp', (SELECT arg_min(k.value, k.idx) FROM kid k WHERE {_on("k", "f", "k.parent_idx = f.idx AND k.name = 'identifier'")}), NULL, NULL, NULL, NULL FROM nodes f WHERE f.name = 'new_expression'
), root AS (SELECT DISTINCT id, side, unnest([i, c, a, it]) AS root FROM raw
), frag_of AS (
  SELECT r.id, r.side, r.root, string_agg((n.depth - t.depth) || ':' || CASE WHEN n.value <> n.name THEN n.name || '=' || n.value ELSE n.name END, ' ' ORDER BY n.idx) AS fragment
  FROM root r JOIN nodes t ON {_on("t", "r", "t.idx = r.root")} JOIN nodes n ON {_on("n", "r", f"n.idx BETWEEN t.idx AND t.subtree_end AND n.name NOT IN ({_MARKS})")} GROUP BY ALL
), feature AS (
  SELECT raw.id, raw.side, raw.idx, feature_type, value, x1.fragment AS initialization, x2.fragment AS condition, x3.fragment AS afterthought, x4.fragment AS iterable FROM raw
  LEFT JOIN frag_of x1 ON {_on("x1", "raw", "x1.root = i")} LEFT JOIN frag_of x2 ON {_on("x2", "raw", "x2.root = c")} LEFT JOIN frag_of x3 ON {_on("x3", "raw", "x3.root = a")} LEFT JOIN frag_of x4 ON {_on("x4", "raw", "x4.root = it")}
)"""
)


@query(_FEATURES + " SELECT * FROM feature")
def program_features(spark, sf_dir):
    return features.extract(facts(spark, sf_dir))


@query(_FEATURES + " SELECT feature_type, value, initialization, condition, afterthought, iterable, count(DISTINCT id) AS origin_num, min(id) AS first_id, max(id) AS last_id FROM feature GROUP BY ALL")
def program_feature_groups(spark, sf_dir):
    """Equal features of all programs with their numbers of origins."""
    got = features.integrate(features.extract(facts(spark, sf_dir)))
    content = F.from_json("feature", "feature_type string, value string, initialization string, condition string, afterthought string, iterable string")
    return got.select(content.alias("f"), "origin_num", F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id")).select("f.*", "origin_num", "first_id", "last_id")


_LINKS = AFTER + " , m AS (SELECT s.id, s.pattern_id, s.confidence, s.idx, n.begin_ AS begin_at, l.idx IS NOT NULL AS diff_linked, l.diff_reason FROM slow s JOIN nodes n ON n.id = s.id AND n.side = s.side AND n.idx = s.idx LEFT JOIN linked l ON l.id = s.id AND l.pattern_id = s.pattern_id AND l.idx = s.idx WHERE s.side = 'base')"


def _links(spark, sf_dir) -> DataFrame:
    f = linking(spark, sf_dir, "begin")
    return stored(linked(f).join(f.select("id", "side", "idx", F.col("begin").alias("begin_at")), ["id", "side", "idx"]), "begins", _NODE)


@query(_LINKS + " SELECT id, pattern_id, bool_or(diff_linked) AS diff_linked, arg_min(idx, (NOT diff_linked, begin_at)) AS idx, arg_min(diff_reason, (NOT diff_linked, begin_at)) AS diff_reason FROM m GROUP BY ALL")
def program_link_rollup(spark, sf_dir):
    """One row for each record and pattern: a linked match first, then the one that begins first."""
    first = F.min(F.struct(~F.col("diff_linked"), "begin_at", "idx", "diff_reason")).alias("x")
    return _links(spark, sf_dir).groupBy("id", "pattern_id").agg(F.bool_or("diff_linked").alias("diff_linked"), first).select("id", "pattern_id", "diff_linked", "x.idx", "x.diff_reason")


@query(_LINKS + ", r AS (SELECT id, pattern_id, bool_or(diff_linked) AS linked FROM m GROUP BY ALL) SELECT k::INT AS pattern_id, count(id) AS total, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE NOT linked) AS unlinked FROM range(1, 11) p(k) LEFT JOIN r ON r.pattern_id = k GROUP BY k")
def program_pattern_totals(spark, sf_dir):
    """Records with each of the ten patterns, linked or not; zero where there are none."""
    r = linked(linking(spark, sf_dir)).groupBy("id", "pattern_id").agg(F.bool_or("diff_linked").alias("linked"))
    per = r.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("unlinked"))
    ten = spark.range(1, 11).select(F.col("id").cast("int").alias("pattern_id"))
    return ten.join(per, "pattern_id", "left").select("pattern_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "linked", "unlinked")])


# --- observations: turns of conversations stand for two programs' runs -----------------

_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda x: x <> '')"
_OBS = f"""
WITH p AS (SELECT u.conv_id, u.turn AS t, u.text AS f, a.text AS s FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.text IS NOT NULL AND a.text IS NOT NULL
), w AS (SELECT *, {_WORDS.format(c="f")} AS wf, {_WORDS.format(c="s")} AS ws FROM p
), o AS (
  SELECT *, (length(f) % 11) <> 0 AND (length(s) % 11) <> 0 AS success, length(f) % 7 = 0 AS ef, length(s) % 7 = 0 AS es, length(f) % 2 AS outf, length(s) % 2 AS outs, length(f) % 3 = 0 AS errf, length(s) % 3 = 0 AS errs,
    list_sort(list_distinct(list_filter(list_intersect(wf, ws), lambda k: len(list_filter(wf, lambda x: x = k)) <> len(list_filter(ws, lambda x: x = k))))) AS differ FROM w
), v AS (
  SELECT conv_id, t, len(differ) AS n_differ, CASE WHEN trim(f) = '' OR trim(s) = '' THEN '0empty' WHEN f = s THEN '0identical' WHEN length(f) % 13 = 0 THEN '0undeterminizable' WHEN NOT success THEN '1verification_failed' WHEN ef <> es THEN '1exit_status_mismatch' WHEN outf <> outs THEN '1stdout_mismatch' WHEN errf <> errs THEN '1stderr_mismatch'
    WHEN len(differ) > 0 THEN '2variable_mismatch' WHEN length(s) % 2 = 0 AND wf[len(wf)] <> ws[len(ws)] THEN '3completion_value_mismatch' END AS verdict FROM o)"""


def _observed(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("text is not null")
    user = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("fast_code"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("slow_code"))
    p = user.join(reply, ["conv_id", "t"]).withColumn("determinized", F.length("fast_code") % 13 != 0)
    for side in ("fast", "slow"):
        n = F.length(f"{side}_code")
        w = F.filter(F.split(F.lower(f"{side}_code"), "[^a-z]+"), lambda x: x != "")
        p = p.withColumn(side, F.struct(F.when(n % 11 != 0, "success").otherwise("error").alias("status"), (n % 7 == 0).cast("int").alias("exit_code"), observation.observed((n % 2).cast("string")).alias("stdout"), observation.observed((n % 3 == 0).cast("string")).alias("stderr")))
        p = p.withColumn("w", w).withColumn(f"{side}_values", F.map_from_entries(F.transform(F.array_distinct("w"), lambda k: F.struct(k.alias("key"), F.struct(F.sha2(F.size(F.filter("w", lambda x: x == k)).cast("string"), 256).alias("s"), F.lit(None).cast("string").alias("v")).alias("value")))))
        last = F.try_element_at("w", F.lit(-1))
        p = p.withColumn(f"{side}_completion", F.when(last.isNotNull(), F.struct(F.sha2(last, 256).alias("s"), F.lit(None).cast("string").alias("v")))).drop("w")
    return p.withColumn("comparable", F.length("slow_code") % 2 == 0)


@query(_OBS + " SELECT conv_id, t, substr(verdict, 1, 1)::INT AS step, substr(verdict, 2) AS reason FROM v")
def observed_pair_verdicts(spark, sf_dir):
    """Pairs judged by texts, outputs, variables and completion values."""
    return observation.judge_pairs(_observed(spark, sf_dir)).select("conv_id", "t", "step", "reason")


@query(_OBS + " SELECT conv_id, t, n_differ FROM v")
def observed_value_mismatches(spark, sf_dir):
    """Common variables that differ."""
    return _observed(spark, sf_dir).select("conv_id", "t", F.size(observation.mismatched(F.col("fast_values"), F.col("slow_values"))).cast("long").alias("n_differ"))


@query("SELECT role, turn % 4 AS attempt_kind, CASE WHEN length(text) % 3 = 0 THEN NULL WHEN role IN ('error', 'warning', 'trace', 'assert') OR turn % 2 = 1 THEN 'stderr' ELSE 'stdout' END AS stream, count(*) AS n FROM conversations GROUP BY ALL")
def console_routing(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 2 == 1, "warning").otherwise(F.col("role"))
    return c.groupBy("role", (F.col("turn") % 4).alias("attempt_kind"), observation.console_stream(kind, F.length("text") % 3).alias("stream")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value < 50), CASE WHEN value < 50 THEN -event_id ELSE event_id END) AS r FROM events) WHERE r = 1")
def last_attempts(spark, sf_dir):
    """Of each user's events of a kind the first that succeeded (50 or more), else the last."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("attempt"), (F.col("value") < 50).alias("failed"))
    return observation.last_attempt(e, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


_U2 = """
WITH s AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS side, value FROM events), c AS (SELECT event_type, value, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1 FROM s GROUP BY ALL
), r AS (SELECT *, coalesce(sum(c1) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower_c1 FROM c
), u AS (SELECT event_type, sum(c0)::BIGINT AS n0, sum(c1)::BIGINT AS n1, 2 * sum(c0 * (lower_c1 + c1 / 2.0))::DOUBLE / (sum(c0) * sum(c1)) - 1 AS d FROM r GROUP BY event_type
), g AS (SELECT event_type, side, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd FROM s GROUP BY ALL)"""


@query(_U2 + " SELECT u.event_type, round(a.mean, 6) AS mean0, round(a.median, 6) AS median0, round(a.sd, 6) AS sd0, round(b.mean, 6) AS mean1, round(b.median, 6) AS median1, round(b.sd, 6) AS sd1, CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) < 0.33 THEN 'small' WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM u JOIN g a ON a.event_type = u.event_type AND a.side = 0 JOIN g b ON b.event_type = u.event_type AND b.side = 1")
def two_sample_report(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, 0).otherwise(1).alias("side"), "value")
    got = observation.sample_report(e, ["event_type"], "side", "value")
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean0", "median0", "sd0", "mean1", "median1", "sd1")], "effect")
