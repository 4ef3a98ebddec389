"""The registered queries of the library's own operators, each over its whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, values
from ..operators import patterns, scoring, similarity, statistics, trees
from ..operators.storage import stored
from .registry import ORACLE_SQL, QUERIES, query, read

FLAGSHIP = "near_duplicate_pairs"


# --- trees: every customer's orders and items ---------------------------------

BOUNDARY = ["nation"]
_NODES = """
WITH top AS (SELECT c_custkey AS id, r_name, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
), raw AS (
  SELECT id, NULL::BIGINT AS o, k AS depth, CASE k WHEN 0 THEN 'region' WHEN 1 THEN 'nation' ELSE 'customer' END AS name, CASE k WHEN 0 THEN r_name WHEN 1 THEN n_name ELSE c_mktsegment END AS value,
    NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, NULL::TIMESTAMP AS d, NULL::DOUBLE AS e, NULL::DOUBLE AS f FROM top, (VALUES (0), (1), (2)) l(k)
  UNION ALL SELECT o_custkey, o_orderkey, 3, 'order', o_orderstatus, NULL, NULL, NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT o_custkey, l_orderkey, 4, 'item', l_returnflag || l_linestatus, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o NULLS FIRST, depth, a, b, c, d, e, f) - 1 AS idx FROM raw
), nodes AS (
  SELECT id, o, idx, name, value, depth, CASE depth WHEN 4 THEN min(idx) OVER (PARTITION BY id, o) ELSE depth - 1 END AS parent_idx,
    CASE WHEN depth <= 2 THEN count(*) OVER (PARTITION BY id) - 1 WHEN depth = 3 THEN max(idx) OVER (PARTITION BY id, o) ELSE idx END AS subtree_end, depth = 4 AND value LIKE 'R%' AS is_action
  FROM numbered
)"""
_CUT = (
    _NODES
    + """, acts AS (SELECT * FROM nodes WHERE is_action
), spans AS (
  SELECT DISTINCT id, 'Diff' AS scope, idx AS lo, subtree_end AS hi FROM acts
  UNION SELECT a.id, 'Brother', a.parent_idx + 1, p.subtree_end FROM acts a JOIN nodes p ON p.id = a.id AND p.idx = a.parent_idx
  UNION SELECT a.id, 'ExParent', p.idx + 1, p.subtree_end FROM acts a JOIN nodes p ON p.id = a.id AND p.name = 'customer'
  UNION SELECT a.id, 'Parent', p.idx, p.subtree_end FROM acts a JOIN nodes p ON p.id = a.id AND p.name = 'nation'
), cut AS (SELECT DISTINCT s.id, scope, n.idx, n.is_action AS is_diff, n.parent_idx FROM spans s JOIN nodes n ON n.id = s.id AND n.idx BETWEEN lo AND hi)"""
)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.order_trees(*(read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem")))


def kept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table written once, for queries that use it more than once."""
    return stored(nodes(spark, sf_dir), "order-nodes")


@query(_NODES + " SELECT id, idx, name, value, parent_idx, depth, subtree_end FROM nodes")
def order_tree_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", "idx", "name", "value", "parent_idx", "depth", "subtree_end")


@query(_NODES + " SELECT id, parent_idx AS idx, count(*) AS n_children, min(idx) AS first_child, max(idx) AS last_child, min(idx) FILTER (WHERE value LIKE 'N%') AS first_named FROM nodes WHERE parent_idx >= 0 GROUP BY ALL")
def order_tree_children(spark, sf_dir):
    return trees.children(nodes(spark, sf_dir), F.col("value").startswith("N"))


@query(_NODES + " SELECT n.id, a.idx AS anchor, count(*) AS n_nodes, max(n.idx) AS last FROM nodes a JOIN nodes n ON n.id = a.id AND n.idx BETWEEN a.idx AND a.subtree_end WHERE a.name = 'order' AND a.value = 'F' GROUP BY ALL")
def order_tree_descendants(spark, sf_dir):
    n = kept_nodes(spark, sf_dir)
    return trees.descendants(n, n.where("name = 'order' and value = 'F'")).groupBy("id", "anchor").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("idx").alias("last"))


@query(_NODES + " SELECT id, count(*) FILTER (WHERE name = 'nation') AS n_nation, count(*) FILTER (WHERE name = 'customer') AS n_customer, count(*) FILTER (WHERE name = 'order') AS n_order, count(*) FILTER (WHERE name = 'item') AS n_item FROM nodes GROUP BY id")
def order_tree_label_counts(spark, sf_dir):
    return trees.label_counts(nodes(spark, sf_dir), ["nation", "customer", "order", "item"])


@query(_NODES + " SELECT id, string_agg(value, ',' ORDER BY idx) AS value_list FROM nodes WHERE name = 'item' GROUP BY id")
def order_tree_ordered_values(spark, sf_dir):
    return trees.ordered_values(nodes(spark, sf_dir), "item").select("id", F.array_join("values", ",").alias("value_list"))


@query(_NODES + " SELECT id, idx, CASE WHEN depth >= 2 THEN 1 ELSE 0 END AS boundary FROM nodes")
def order_tree_scope_boundary(spark, sf_dir):
    return trees.scope_boundary(kept_nodes(spark, sf_dir), BOUNDARY)


@query(_CUT + " SELECT id, scope, count(*) AS n_nodes, count(*) FILTER (WHERE is_diff) AS n_diff FROM cut GROUP BY ALL")
def order_tree_scope_cut(spark, sf_dir):
    return trees.cut_scopes(kept_nodes(spark, sf_dir), BOUNDARY).groupBy("id", "scope").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_diff").alias("n_diff"))


@query(_CUT + ", r AS (SELECT id, scope, count(*) AS n, count(*) FILTER (WHERE NOT is_diff)::DOUBLE / count(*) AS r FROM cut GROUP BY ALL) SELECT scope, count(*) AS n_records, round(avg(r), 9) AS mean_ratio, quantile_cont(r, 0.5) AS median_ratio, quantile_cont(n, 0.5) AS median_size FROM r GROUP BY scope")
def order_tree_non_diff_ratio(spark, sf_dir):
    cut = trees.cut_scopes(kept_nodes(spark, sf_dir), BOUNDARY).groupBy("id", "scope").agg(F.count(F.lit(1)).alias("n"), (F.count_if(~F.col("is_diff")) / F.count(F.lit(1))).alias("r"))
    return cut.groupBy("scope").agg(F.count(F.lit(1)).alias("n_records"), F.round(F.avg("r"), 9).alias("mean_ratio"), F.percentile("r", F.lit(0.5)).alias("median_ratio"), F.percentile("n", F.lit(0.5)).alias("median_size"))


@query(
    _CUT
    + """, k AS (SELECT n.id, n.idx, n.parent_idx FROM nodes n SEMI JOIN acts a ON a.id = n.id AND a.parent_idx = n.parent_idx
), s AS (SELECT k.id, x.scope, k.parent_idx, count(cut.idx)::DOUBLE / count(*) AS share FROM k JOIN (SELECT DISTINCT id, scope FROM cut) x USING (id) LEFT JOIN cut ON cut.id = k.id AND cut.scope = x.scope AND cut.idx = k.idx GROUP BY ALL)
SELECT id, scope, round(avg(share), 9) AS completeness FROM s GROUP BY ALL"""
)
def order_tree_sibling_completeness(spark, sf_dir):
    n = kept_nodes(spark, sf_dir)
    got = trees.sibling_completeness(n, stored(trees.cut_scopes(n, BOUNDARY), "order-cut"))
    return got.select("id", "scope", F.round("completeness", 9).alias("completeness"))


@query(_NODES + ", m AS (SELECT a.id, a.idx, min(l.idx) AS leftmost FROM nodes a JOIN nodes l ON l.id = a.id AND l.idx = l.subtree_end AND l.idx BETWEEN a.idx AND a.subtree_end GROUP BY ALL) SELECT id, leftmost, min(idx) AS keyroot FROM m GROUP BY ALL")
def order_tree_keyroots(spark, sf_dir):
    return trees.keyroots(kept_nodes(spark, sf_dir))


@query(_NODES + " SELECT a.id, a.idx AS anchor, count(*) AS n_inside FROM nodes a JOIN nodes n ON n.id = a.id AND n.idx >= a.idx AND n.subtree_end <= a.subtree_end AND n.depth > 0 WHERE a.depth = 3 GROUP BY ALL")
def order_tree_range_cut(spark, sf_dir):
    n = kept_nodes(spark, sf_dir).withColumns({"begin": F.col("idx"), "end": F.col("subtree_end")})
    return trees.range_cut(n, n.where("depth = 3")).groupBy("id", "anchor").agg(F.count(F.lit(1)).alias("n_inside"))


@query(
    _NODES
    + """, f AS (SELECT id, substr(value, 1, 1) AS marker, value, min(idx) AS first_idx, count(*) AS n_uses FROM nodes WHERE depth = 4 GROUP BY ALL)
SELECT id, value, n_uses, '$' || lower(marker) || (dense_rank() OVER (PARTITION BY id, marker ORDER BY first_idx) - 1) AS slot FROM f"""
)
def order_tree_first_appearance_slots(spark, sf_dir):
    return trees.slots(nodes(spark, sf_dir).where("depth = 4"), F.lower(F.substring("value", 1, 1)))


@query(
    _NODES
    + """, t AS (SELECT id, idx, name || ':' || value AS tok, lead(name || ':' || value) OVER (PARTITION BY id ORDER BY idx) AS nxt FROM nodes)
SELECT id, count(*) AS n_tokens, count(DISTINCT tok || chr(1) || nxt) AS n_bigrams FROM t GROUP BY id"""
)
def order_tree_token_bigrams(spark, sf_dir):
    tok = values.label(F.col("name"), F.col("value"), 1)
    got = nodes(spark, sf_dir).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", tok.alias("t")))).alias("t")).withColumn("tokens", F.transform("t", lambda x: x["t"]))
    return got.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.size(values.bigrams(F.col("tokens"))).cast("long").alias("n_bigrams"))


# --- token sequences and clusters: documents ------------------------------------

TAU = 0.7
_GRAMS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents
), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1])) AS g FROM d
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(2) ORDER BY g)) AS h FROM g GROUP BY doc_id
), cls AS (SELECT h, min(doc_id) AS cid, count(*) AS size FROM sets GROUP BY h
), reps AS (SELECT cid, n FROM cls JOIN sets ON sets.doc_id = cid
), rg AS (SELECT g.doc_id AS cid, g FROM g SEMI JOIN reps ON reps.cid = g.doc_id
), pairs AS (
  SELECT a, b, c::DOUBLE / (x.n + y.n - c) AS sim FROM (SELECT p.cid AS a, q.cid AS b, count(*) AS c FROM rg p JOIN rg q ON p.g = q.g AND p.cid < q.cid GROUP BY ALL) JOIN reps x ON x.cid = a JOIN reps y ON y.cid = b
  WHERE c::DOUBLE / (x.n + y.n - c) >= 0.7)"""


def doc_classes(spark, sf_dir):
    return similarity.gram_classes(read(spark, sf_dir, "documents"), "doc_id", values.words(F.col("text")))


@query(_GRAMS + " SELECT a, b, round(sim, 9) AS sim FROM pairs")
def near_duplicate_pairs(spark, sf_dir):
    """Pairs between class representatives; ``identical_gram_classes`` has the membership."""
    classes, _ = doc_classes(spark, sf_dir)
    return similarity.jaccard_pairs(classes, TAU).select("a", "b", F.round("sim", 9).alias("sim"))


@query(_GRAMS + " SELECT sets.doc_id AS key, cid, size AS class_size FROM sets JOIN cls USING (h)")
def identical_gram_classes(spark, sf_dir):
    _, members = doc_classes(spark, sf_dir)
    return members.join(members.groupBy("cid").agg(F.count(F.lit(1)).alias("class_size")), "cid").select("key", "cid", "class_size")


@query("SELECT md5(text) AS content, count(*) AS size, min(doc_id) AS first_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1")
def identical_document_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content"))
    return d.groupBy("content").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_id"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string")), ",").alias("ids")).where("size > 1")


@query("SELECT route, count(*) AS n FROM (SELECT CASE len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) WHEN 0 THEN 'excluded' WHEN 1 THEN 'unigram' ELSE 'bigram' END AS route FROM (SELECT text FROM documents UNION ALL SELECT p_type FROM part UNION ALL SELECT l_returnflag FROM lineitem)) GROUP BY route")
def token_length_routing(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select("text").union(read(spark, sf_dir, "part").select("p_type")).union(read(spark, sf_dir, "lineitem").select("l_returnflag"))
    n = F.size(values.words(F.col("text")))
    return texts.groupBy(F.when(n == 0, "excluded").when(n == 1, "unigram").otherwise("bigram").alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_type AS content, 'L1_uni_' || substr(sha256(p_type), 1, 8) AS class_id, count(*) AS size, min(p_partkey) AS first_key FROM part GROUP BY p_type")
def unigram_groups(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("content")).agg(F.count(F.lit(1)).alias("size"), F.min("p_partkey").alias("first_key")).select("content", values.class_id(1, F.col("content"), "uni").alias("class_id"), "size", "first_key")


@query("SELECT lang, count(n) AS n, round(avg(n), 6) AS mean, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, round(var_pop(n), 4) AS variance, min(n)::BIGINT AS least, max(n)::BIGINT AS largest FROM (SELECT lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM documents) GROUP BY lang")
def doc_token_quantiles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", F.size(values.words(F.col("text"))).cast("long").alias("v"))
    return statistics.summary(d, ["lang"], "v").withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


def clusters(spark, sf_dir, method: str = "agglomerate") -> DataFrame:
    """(``key``, ``cluster``) of every document with a bigram."""
    classes, members = doc_classes(spark, sf_dir)
    pairs = stored(similarity.jaccard_pairs(classes, TAU), "pairs")
    got = similarity.linkage(classes, pairs, TAU, method)
    return members.join(got, "cid").select("key", "cluster")


@query(
    _GRAMS.replace("WITH d AS", "WITH RECURSIVE d AS", 1)
    + """, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), walk AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node), c AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
SELECT node, root FROM c"""
)
def cluster_components(spark, sf_dir):
    classes, _ = doc_classes(spark, sf_dir)
    return similarity.component_labels(similarity.jaccard_pairs(classes, TAU))


@query()
def complete_linkage_clusters(spark, sf_dir):
    return clusters(spark, sf_dir)


@query()
def hash_linkage_clusters(spark, sf_dir):
    return clusters(spark, sf_dir, "hash")


@query()
def cluster_representatives(spark, sf_dir):
    """Mode or medoid of every cluster of two documents or more."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.md5("text").alias("value"), values.bigrams(values.words(F.col("text"))).alias("grams"))
    own = clusters(spark, sf_dir)
    big = own.join(own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cluster", "left_semi")
    return similarity.representatives(docs.join(big, "key"), "key", "cluster", "value", F.col("grams"))


_LABELLED = "members AS (SELECT doc_id AS key, md5(text) AS cluster FROM documents), truth AS (SELECT 'low_quality' AS target, doc_id AS key FROM labels WHERE quality = 0 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1)"


@query(
    f"""WITH {_LABELLED}, size AS (SELECT cluster, count(*) AS size FROM members GROUP BY cluster
), h AS (SELECT target, cluster, size, count(*) AS hits FROM truth JOIN members USING (key) JOIN size USING (cluster) GROUP BY ALL
), p AS (SELECT target, count(*) AS n_clusters, count(*) FILTER (WHERE hits = size) AS n_pure, sum(hits) AS covered, max(hits) AS best, sum(size) AS u FROM h GROUP BY target
), t AS (SELECT target, count(*) AS n_truth FROM truth GROUP BY target
), m AS (SELECT target, n_truth, n_clusters, n_pure, covered::BIGINT AS covered, covered::DOUBLE / n_truth AS r, best::DOUBLE / n_truth AS rm, covered::DOUBLE / u AS p FROM t JOIN p USING (target))
SELECT target, n_truth, n_clusters, n_pure, covered, round(r, 9) AS r_union, round(rm, 9) AS r_max, round(p, 9) AS p_union, round(2 * p * r / (p + r), 9) AS f1_union FROM m"""
)
def cluster_vs_labels(spark, sf_dir):
    members = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.md5("text").alias("cluster"))
    got = scoring.cluster_metrics(members, _truth(spark, sf_dir))
    return got.withColumns({c: F.round(c, 9) for c in ("r_union", "r_max", "p_union", "f1_union")})


def _truth(spark, sf_dir) -> DataFrame:
    lab = read(spark, sf_dir, "labels")
    return lab.where("quality = 0").select(F.lit("low_quality").alias("target"), F.col("doc_id").alias("key")).unionByName(lab.where("toxic = 1").select(F.lit("toxic").alias("target"), F.col("doc_id").alias("key")))


@query(
    """WITH r AS (SELECT DISTINCT source, doc_id FROM documents WHERE n_chars < 1000), t AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0
), b AS (SELECT source, count(r.doc_id) AS n_result, count(t.doc_id) AS n_truth, count(*) FILTER (WHERE r.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS n_both FROM r FULL JOIN t USING (source, doc_id) GROUP BY source
), m AS (SELECT *, CASE WHEN n_truth > 0 THEN n_both::DOUBLE / n_truth ELSE 0 END AS r, CASE WHEN n_result > 0 THEN n_both::DOUBLE / n_result ELSE 0 END AS p FROM b)
SELECT source, n_result, n_truth, n_both, round(r, 9) AS recall, round(p, 9) AS precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM m"""
)
def precision_recall_f1_by_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("key"), "n_chars")
    bad = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("key"))
    got = scoring.recall_precision(d.where("n_chars < 1000"), d.join(bad, "key"), ["source"])
    return got.withColumns({c: F.round(c, 9) for c in ("recall", "precision", "f1")})


@query(f"WITH {_LABELLED} SELECT cluster, count(*) AS size FROM members WHERE cluster NOT IN (SELECT cluster FROM members JOIN truth USING (key)) GROUP BY cluster ORDER BY size DESC, cluster LIMIT 20")
def unknown_top_clusters(spark, sf_dir):
    """A top-k report."""
    members = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.md5("text").alias("cluster"))
    return scoring.unknown_clusters(members, _truth(spark, sf_dir), 20)


@query(
    f"""WITH {_LABELLED}, it AS (SELECT i::INT AS iteration FROM range(50) r(i)
), ids AS (SELECT iteration, doc_id AS key, row_number() OVER (PARTITION BY iteration ORDER BY md5('20260918:' || iteration || ':' || doc_id)) AS pos FROM documents, it
), cells AS (SELECT coalesce(source, '') AS cluster, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) AS pos FROM documents
), m AS (SELECT iteration, key, cluster FROM ids JOIN cells USING (pos)
), size AS (SELECT iteration, cluster, count(*) AS size FROM m GROUP BY ALL
), h AS (SELECT target, iteration, cluster, size, count(*) AS hits FROM truth JOIN m USING (key) JOIN size USING (iteration, cluster) GROUP BY ALL
), n AS (SELECT target, count(*) AS n_truth FROM truth GROUP BY target
), s AS (SELECT target, iteration, sum(hits)::DOUBLE / any_value(n_truth) AS r, max(hits)::DOUBLE / any_value(n_truth) AS rm, sum(hits)::DOUBLE / sum(size) AS p FROM h JOIN n USING (target) GROUP BY ALL)
SELECT target, count(*) AS n, round(avg(rm), 9) AS mean, round(quantile_cont(rm, 0.25), 9) AS q1, round(quantile_cont(rm, 0.5), 9) AS median, round(quantile_cont(rm, 0.75), 9) AS q3, round(var_pop(rm), 9) AS variance, round(avg(p), 9) AS mean_precision, round(avg(r), 9) AS mean_recall FROM s GROUP BY target"""
)
def permutation_baseline_scores(spark, sf_dir):
    """Fifty shuffled memberships, each scored against the labels, and summarised: recall of the best cluster, and means of the union's."""
    members = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("")).alias("cluster"))
    got = stored(scoring.permutation_scores(members, _truth(spark, sf_dir), 50, 20260918), "permutations")
    best = statistics.summary(got, ["target"], "r_max").drop("least", "largest")
    means = got.groupBy("target").agg(F.round(F.avg("p_union"), 9).alias("mean_precision"), F.round(F.avg("r_union"), 9).alias("mean_recall"))
    return best.join(means, "target").withColumns({c: F.round(c, 9) for c in ("mean", "q1", "median", "q3", "variance")})


@query("SELECT lang, doc_id, n_chars, rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20")
def rank_topk_per_language(spark, sf_dir):
    """A top-k report."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", n.alias("rank")).where("rank <= 20")


@query("SELECT least(a, b) || '::' || greatest(a, b) AS pair, sha256(least(a, b) || '::' || greatest(a, b)) AS pair_hash FROM (SELECT p_brand AS a, p_type AS b FROM part GROUP BY ALL)")
def pair_hashes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return p.select(values.pair_key(F.col("p_brand"), F.col("p_type")).alias("pair"), values.pair_hash(F.col("p_brand"), F.col("p_type")).alias("pair_hash"))


# --- samples: events -------------------------------------------------------------

_T = ", ".join(f"({n}, {statistics.t_quantile(0.975, n - 1)!r}::DOUBLE)" for n in range(2, 400))
_DAYS = "(SELECT event_type, date_part('hour', ts)::INT AS hour, value FROM events)"
_CI = f"""
WITH s AS (SELECT user_id, event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY ALL HAVING count(value) >= 2
), t(n, t) AS (VALUES {_T}
), ci AS (SELECT user_id, event_type, s.n, mean, mean - t * sd / sqrt(s.n) AS ci_low, mean + t * sd / sqrt(s.n) AS ci_high FROM s JOIN t USING (n))"""


def _intervals(spark, sf_dir) -> DataFrame:
    return statistics.confidence_intervals(read(spark, sf_dir, "events"), ["user_id", "event_type"], "value")


@query(_CI + " SELECT user_id, event_type, n, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci")
def event_ci_by_group(spark, sf_dir):
    return _intervals(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("mean", "ci_low", "ci_high")})


@query(_CI + " SELECT l.user_id, l.event_type AS fast, h.event_type AS slow, round(h.mean / l.mean, 6) AS mean_ratio FROM ci l JOIN ci h ON l.user_id = h.user_id AND l.ci_high < h.ci_low")
def event_disjoint_ci_pairs(spark, sf_dir):
    return statistics.disjoint_pairs(_intervals(spark, sf_dir), "user_id", "event_type").withColumn("mean_ratio", F.round("mean_ratio", 6))


@query(_CI + ", e AS (SELECT user_id, count(*) AS k FROM ci GROUP BY user_id HAVING count(*) >= 2) SELECT count(*) AS n_groups, sum(k)::BIGINT AS n_tests, sum(k * (k - 1) // 2)::BIGINT AS n_pairs, (SELECT count(*) FROM ci l JOIN ci h ON l.user_id = h.user_id AND l.ci_high < h.ci_low) AS n_disjoint FROM e")
def event_pair_summary(spark, sf_dir):
    ci = _intervals(spark, sf_dir)
    per = ci.groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("k").alias("n_tests"), F.sum(F.expr("k * (k - 1) div 2")).alias("n_pairs"))
    found = statistics.disjoint_pairs(ci, "user_id", "event_type").agg(F.count(F.lit(1)).alias("n_disjoint"))
    return per.join(F.broadcast(found))


_SIDES = "SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS side, value FROM events"
_U = f"""
WITH s AS ({_SIDES}), c AS (SELECT event_type, value, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1 FROM s GROUP BY ALL
), r AS (SELECT *, coalesce(sum(c1) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower_c1 FROM c
), u AS (SELECT event_type, sum(c0)::BIGINT AS n0, sum(c1)::BIGINT AS n1, sum(c0 * (lower_c1 + c1 / 2.0))::DOUBLE AS u FROM r GROUP BY event_type)"""


def _sides(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, 0).otherwise(1).alias("side"), "value")


@query(_U + " SELECT event_type, n0, n1, u, round(2 * u / (n0 * n1) - 1, 9) AS cliff_delta, CASE WHEN abs(2 * u / (n0 * n1) - 1) < 0.147 THEN 'negligible' WHEN abs(2 * u / (n0 * n1) - 1) < 0.33 THEN 'small' WHEN abs(2 * u / (n0 * n1) - 1) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM u")
def event_cliff_delta(spark, sf_dir):
    r = statistics.rank_sums(_sides(spark, sf_dir), ["event_type"], "side", "value")
    return r.select("event_type", "n0", "n1", "u", F.round("cliff_delta", 9).alias("cliff_delta"), statistics.effect_size().alias("effect"))


@query()
def event_mann_whitney(spark, sf_dir):
    return statistics.mann_whitney(_sides(spark, sf_dir), ["event_type"], "side", "value")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(var_pop(value), 4) AS variance, min(value) AS least, max(value) AS largest FROM events GROUP BY event_type")
def event_value_summary(spark, sf_dir):
    got = statistics.summary(read(spark, sf_dir, "events"), ["event_type"], "value")
    return got.withColumns({"mean": F.round("mean", 6), "q1": F.round("q1", 6), "median": F.round("median", 6), "q3": F.round("q3", 6), "variance": F.round("variance", 4)})


# --- statuses, shards and dispatch --------------------------------------------------


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS n_ok, bool_or(event_type = 'purchase') AS any_ok, bool_and(event_type = 'purchase') AS all_ok, max(value) AS longest, CASE WHEN bool_and(event_type = 'purchase') THEN 'all' WHEN bool_or(event_type = 'purchase') THEN 'partial' ELSE 'none' END AS status FROM events GROUP BY user_id")
def event_status_rollup(spark, sf_dir):
    ok = F.col("event_type") == "purchase"
    got = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.bool_or(ok).alias("any_ok"), F.bool_and(ok).alias("all_ok"), F.max("value").alias("longest"))
    return got.withColumn("status", F.when(F.col("all_ok"), "all").when(F.col("any_ok"), "partial").otherwise("none"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_upsert(spark, sf_dir):
    return scoring.latest(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT c_mktsegment AS segment, c_custkey AS key, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 8 AS shard FROM customer")
def round_robin_shards(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), ((n - 1) % 8).cast("long").alias("shard"))


@query("SELECT o_custkey AS key, count(*) AS n_orders, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS n_missing FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) > 0")
def incomplete_groups(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(1))
    got = read(spark, sf_dir, "orders").join(done, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("done").isNull()).alias("n_missing"))
    return got.where("n_missing > 0")


@query(
    """WITH t AS (SELECT o_custkey AS key, o_orderstatus = 'F' AS node, o_totalprice > 100000 AS npm, o_orderpriority <= '3' AS playwright FROM orders), k AS (SELECT * FROM t WHERE node OR npm OR playwright)
SELECT key, count(k.key) AS n_kept, CASE WHEN count(k.key) < 2 THEN 'insufficient_pair' WHEN bool_and(k.node) THEN 'node' WHEN bool_and(k.npm) THEN 'npm' WHEN bool_and(k.playwright) THEN 'playwright' ELSE 'mixed_env' END AS env
FROM (SELECT DISTINCT key FROM t) LEFT JOIN k USING (key) GROUP BY key"""
)
def user_dispatch_rule(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    t = o.select(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "F").alias("node"), (F.col("o_totalprice") > 100000).alias("npm"), (F.col("o_orderpriority") <= "3").alias("playwright"))
    return scoring.dispatch(t, "key", ["node", "npm", "playwright"])


@query("SELECT 'step' || (o_shippriority % 3) || ':' || o_orderstatus AS reason, count(*) AS n FROM (SELECT o_orderkey AS o_shippriority, o_orderstatus FROM orders) GROUP BY reason")
def reason_breakdown(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("step"), (F.col("o_orderkey") % 3).cast("string"), F.lit(":"), "o_orderstatus").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS p1, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS p2, count(*) AS total, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY o_orderstatus")
def condition_grid_summary(spark, sf_dir):
    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(p.startswith("1")).alias("p1"), F.count_if(p.startswith("2")).alias("p2"), F.count(F.lit(1)).alias("total"), F.round(F.sum("o_totalprice"), 2).alias("price"))


# --- pages and conversations ------------------------------------------------------


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY host ORDER BY n DESC, host LIMIT 40")
def page_hosts_topk(spark, sf_dir):
    """A top-k report."""
    return read(spark, sf_dir, "pages").groupBy(F.expr("parse_url(url, 'HOST')").alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(40)


@query()
def page_script_classes(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", markup.page_scripts(F.col("html")).alias("s")).select("page_id", "s.*")


@query()
def page_markup_nodes(spark, sf_dir):
    got = read(spark, sf_dir, "pages").select("page_id", F.explode(markup.markup_nodes(F.col("html"))).alias("n"))
    return got.select("page_id", "n.*")


#: Patterns over markup, as an example of declarative tree patterns.
PAGE_PATTERNS = [
    {"id": 1, "root": {"name": "ul", "children": [{"name": "li", "children": [{"name": "a"}]}]}},
    {"id": 2, "root": {"name": "body", "children": [{"name": "a", "match": "descendant"}, {"name": "p", "match": "descendant"}]}},
    {"id": 3, "root": {"name": {"regex": "^h[1-6]$"}}},
]


@query()
def page_pattern_matches(spark, sf_dir):
    """Declarative tree patterns over the element trees of all pages."""
    got = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.explode(markup.markup_nodes(F.col("html"))).alias("n"))
    elements = stored(got.select("id", F.lit("base").alias("side"), "n.idx", "n.parent_idx", "n.subtree_end", "n.name", F.col("n.name").alias("value"), F.lit("").alias("text"), "n.begin", F.col("n.begin").alias("end")), "elements")
    return patterns.find_all(elements, PAGE_PATTERNS).groupBy("id", "pattern_id").agg(F.count(F.lit(1)).alias("n_matches"), F.min("begin").alias("first"))


def _turns(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("fast"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("slow"))
    return user.join(reply, ["conv_id", "t"])


@query(
    """WITH p AS (SELECT u.conv_id, u.turn AS t, u.text AS fast, a.text AS slow FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
), w AS (SELECT *, list_sort(list_distinct(regexp_split_to_array(lower(trim(fast)), '\\s+'))) AS f, list_sort(list_distinct(regexp_split_to_array(lower(trim(slow)), '\\s+'))) AS s FROM p)
SELECT conv_id, t, CASE WHEN trim(fast) = '' OR trim(slow) = '' THEN 'step0:empty' WHEN fast = slow THEN 'step0:identical' WHEN f = s THEN 'step2:same_values' WHEN len(list_intersect(f, s)) = 0 THEN 'step2:no_common_value' ELSE 'step3:different' END AS verdict FROM w"""
)
def conversation_turn_equivalence(spark, sf_dir):
    return scoring.judge(_turns(spark, sf_dir)).select("conv_id", "t", "verdict")


@query(
    """WITH p AS (SELECT u.conv_id, u.turn AS t, string_split(u.text, chr(10)) AS f, string_split(a.text, chr(10)) AS s FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, t, len(list_filter(list_distinct(f), lambda x: NOT list_contains(s, x))) AS n_removed, len(list_filter(list_distinct(s), lambda x: NOT list_contains(f, x))) AS n_added FROM p"""
)
def conversation_added_removed(spark, sf_dir):
    p = _turns(spark, sf_dir).withColumns({"f": F.split("fast", "\n"), "s": F.split("slow", "\n")})
    return p.select("conv_id", "t", F.size(F.array_except("f", "s")).cast("long").alias("n_removed"), F.size(F.array_except("s", "f")).cast("long").alias("n_added"))


_DOC_GRAMS = "SELECT DISTINCT {k}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT {k}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {t})"


@query(f"WITH d AS ({_DOC_GRAMS.format(k='doc_id', t='documents')}), b AS ({_DOC_GRAMS.format(k='item_id', t='benchmark')}) SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY ALL")
def passage_overlap_pairs(spark, sf_dir):
    """Five-word grams that a document shares with a benchmark item: an inverted-index join."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        w = values.words(F.lower("text"))
        five: Column = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.array_join(F.slice(F.col("w"), i + 1, 5), " "))
        return df.select(key, w.alias("w")).where(F.size("w") >= 5).select(key, F.explode(F.array_distinct(five)).alias("g"))

    return grams(read(spark, sf_dir, "documents"), "doc_id").join(grams(read(spark, sf_dir, "benchmark"), "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))


@query("SELECT label, count(*) AS n, round(avg(list_cosine_similarity(embedding::DOUBLE[], c::DOUBLE[])), 5) AS mean_cosine FROM embeddings, (SELECT embedding AS c FROM embeddings WHERE vec_id = 0) GROUP BY label")
def vector_cosine_by_label(spark, sf_dir):
    """Mean cosine of each label's vectors with vector 0."""
    e = read(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("c"))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = dot("embedding", "c") / F.sqrt(dot("embedding", "embedding") * dot("c", "c"))
    return e.join(F.broadcast(probe)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cos), 5).alias("mean_cosine"))


from . import group_catalog, ingest_catalog, syntax_catalog  # noqa: E402, F401  (register their queries)
