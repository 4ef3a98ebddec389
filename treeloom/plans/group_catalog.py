"""Queries over groups of parts and documents: representatives, centrality, rankings and set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values
from ..operators import similarity, statistics
from .registry import query, read

#: Parts of one type are a group; a part's tokens are its name's, brand's and size's.
_SETS = """
WITH r AS (SELECT p_type AS grp, p_partkey AS key, p_brand || ' ' || (p_size // 10) || ' ' || p_name AS value, regexp_split_to_array(trim(p_brand || ' ' || (p_size // 10) || ' ' || p_name), '\\s+') AS w FROM part
), g AS (SELECT grp, key, value, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1])) AS grams FROM r
)"""
_MEANS = (
    _SETS
    + """, pair AS (SELECT a.grp, a.key, CASE WHEN len(a.grams) = 0 AND len(b.grams) = 0 THEN 1.0 ELSE len(list_intersect(a.grams, b.grams))::DOUBLE / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) END AS sim FROM g a JOIN g b ON a.grp = b.grp AND a.key <> b.key
), means AS (SELECT g.grp, g.key, value, avg(sim) AS mean FROM g LEFT JOIN pair USING (grp, key) GROUP BY ALL)"""
)


def _rows(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_brand", F.floor(F.col("p_size") / 10).cast("string"), "p_name")
    return p.select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("key"), text.alias("value"), values.bigrams(values.words(text)).alias("grams"))


@query(_MEANS + " SELECT grp, key, round(mean, 9) AS mean FROM means")
def part_mean_similarity(spark, sf_dir):
    """Each part's mean similarity to the others of its type."""
    return similarity.mean_similarity(_rows(spark, sf_dir)).select("grp", "key", F.round("mean", 9).alias("mean"))


@query(_MEANS + ", c AS (SELECT grp, avg(mean) AS m FROM means GROUP BY grp HAVING count(*) > 1) SELECT count(*) AS n, round(avg(m), 9) AS mean, round(quantile_cont(m, 0.5), 9) AS median, round(stddev_pop(m), 9) AS deviation, round(min(m), 9) AS least, round(max(m), 9) AS largest FROM c")
def part_group_cohesion(spark, sf_dir):
    """The mean similarity inside every group of two or more, summarised."""
    c = similarity.mean_similarity(_rows(spark, sf_dir)).where("mean is not null").groupBy("grp").agg(F.avg("mean").alias("m"))
    r = lambda x, name: F.round(x, 9).alias(name)
    return c.agg(F.count(F.lit(1)).alias("n"), r(F.avg("m"), "mean"), r(F.percentile("m", F.lit(0.5)), "median"), r(F.stddev_pop("m"), "deviation"), r(F.min("m"), "least"), r(F.max("m"), "largest"))


@query(
    _MEANS
    + """, size AS (SELECT grp, count(*) AS size FROM means GROUP BY grp), votes AS (SELECT grp, value, count(*) AS support, min(key) AS first FROM means GROUP BY ALL
), mode AS (SELECT v.grp, first AS representative, CASE WHEN size = 1 THEN 'single' ELSE 'mode' END AS strategy, support, size FROM votes v JOIN size USING (grp) WHERE 2 * support > size)
SELECT * FROM mode UNION ALL SELECT m.grp, arg_max(key, (round(mean, 12), -key)), 'medoid', 1, any_value(size) FROM means m JOIN size USING (grp) WHERE grp NOT IN (SELECT grp FROM mode) GROUP BY m.grp"""
)
def part_representatives(spark, sf_dir):
    """Single, mode or medoid of each type."""
    rows = _rows(spark, sf_dir)
    return similarity.representatives(rows, "key", "grp", "value", F.col("grams")).withColumnRenamed("group", "grp")


@query(_MEANS + ", one AS (SELECT grp, value, round(max(mean), 12) AS mean, arg_max(key, (round(mean, 12), -key)) AS key FROM means GROUP BY grp, value) SELECT grp, rank, key, value FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mean DESC NULLS LAST, key) - 1 AS rank FROM one) WHERE rank < 3")
def part_central_rows(spark, sf_dir):
    """The three most central parts of each type with different values: a top-k report."""
    return similarity.central_rows(_rows(spark, sf_dir), 3).select("grp", F.col("rank").cast("long").alias("rank"), "key", "value")


_HITS = """
WITH truth AS (SELECT 'low_quality' AS target, doc_id FROM labels WHERE quality = 0 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1
), size AS (SELECT source AS cluster, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY source), n AS (SELECT target, count(*) AS n FROM truth GROUP BY target
), hit AS (SELECT target, source AS cluster, count(*) AS hits FROM truth JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY ALL
), m AS (SELECT target, cluster, hits, size, hits::DOUBLE / size AS precision, hits::DOUBLE / n AS recall FROM hit JOIN size USING (cluster) JOIN n USING (target)
), s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


def _scores(spark, sf_dir) -> DataFrame:
    lab, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").where("source is not null")
    truth = lab.where("quality = 0").select(F.lit("low_quality").alias("target"), "doc_id").unionByName(lab.where("toxic = 1").select(F.lit("toxic").alias("target"), "doc_id"))
    size = docs.groupBy(F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    n = truth.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    hit = truth.join(docs, "doc_id").groupBy("target", F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("hits"))
    got = hit.join(size, "cluster").join(n, "target").withColumn("precision", values.ratio(F.col("hits"), F.col("size"))).withColumn("recall", values.ratio(F.col("hits"), F.col("n")))
    return got.withColumn("f1", values.f1(F.col("precision"), F.col("recall")))


@query(_HITS + " " + " UNION ALL ".join(f"SELECT target, '{k}' AS metric, rank, cluster, round({k}, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {k} DESC, size DESC, cluster) AS rank FROM s) WHERE rank <= 3" for k in ("precision", "recall", "f1")))
def top_clusters_by_metric(spark, sf_dir):
    """The three best sources for each target by precision, by recall and by F1: a top-k report."""
    s, out = _scores(spark, sf_dir), None
    for k in ("precision", "recall", "f1"):
        n = F.row_number().over(W.partitionBy("target").orderBy(F.desc(k), F.desc("size"), "cluster"))
        got = s.withColumn("rank", n).where("rank <= 3").select("target", F.lit(k).alias("metric"), F.col("rank").cast("long").alias("rank"), "cluster", F.round(k, 9).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


@query(_HITS + " SELECT target, arg_max(cluster, (size, -hits, cluster)) AS cluster, max(size) AS size FROM s GROUP BY target")
def largest_hit_cluster(spark, sf_dir):
    """The largest source that holds a true document."""
    got = _scores(spark, sf_dir).groupBy("target").agg(F.max(F.struct("size", (-F.col("hits")).alias("h"), "cluster")).alias("x"))
    return got.select("target", "x.cluster", "x.size")


@query("WITH c AS (SELECT source, doc_id FROM documents WHERE n_chars < 1000), fp AS (SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) SELECT source, count(f.doc_id) AS n_fp, CASE WHEN count(f.doc_id) > 0 THEN round(count(l.doc_id)::DOUBLE / count(f.doc_id), 9) END AS ratio FROM (SELECT DISTINCT source FROM c) s LEFT JOIN fp f USING (source) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = f.doc_id GROUP BY source")
def false_positive_ratio(spark, sf_dir):
    """Of the short documents that aren't of low quality the share that is toxic; nothing where there are none."""
    lab = read(spark, sf_dir, "labels")
    c = read(spark, sf_dir, "documents").where("n_chars < 1000").select("source", "doc_id")
    bad = lab.where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    odd = lab.where("toxic = 1").select("doc_id").distinct().withColumn("odd", F.lit(True))
    got = c.join(bad, "doc_id", "left").join(odd, "doc_id", "left").withColumn("fp", F.col("bad").isNull())
    n = F.count_if("fp")
    return got.groupBy("source").agg(n.alias("n_fp"), F.when(n > 0, F.round(F.count_if(F.col("fp") & F.col("odd").isNotNull()) / n, 9)).alias("ratio"))


@query("SELECT l_orderkey AS grp, l_returnflag AS flag, arg_min(l_linenumber, (l_quantity, -l_tax, l_linenumber, l_partkey)) AS line, min(l_quantity) AS quantity, count(DISTINCT l_linestatus || ':' || l_linenumber) AS variants FROM lineitem GROUP BY ALL")
def minimal_per_group(spark, sf_dir):
    """The least row of every order and flag, and how many variants there are."""
    low = F.min(F.struct("l_quantity", (-F.col("l_tax")).alias("t"), "l_linenumber", "l_partkey")).alias("x")
    got = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("flag")).agg(low, F.count_distinct(F.concat_ws(":", "l_linestatus", F.col("l_linenumber").cast("string"))).alias("variants"))
    return got.select("grp", "flag", F.col("x.l_linenumber").alias("line"), F.col("x.l_quantity").alias("quantity"), "variants")


@query("SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def needed_documents(spark, sf_dir):
    """The documents of the wanted ids."""
    ids = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return read(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").select("doc_id", F.md5("text").alias("content"))


@query("SELECT event_type, user_id % 5 = 0 AS origin, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS deviation, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY ALL")
def means_by_origin(spark, sf_dir):
    """Users' means, parted by origin: mean, deviation and the middle 95 percent."""
    m = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m")).withColumn("origin", F.col("user_id") % 5 == 0)
    return statistics.spread(m, ["event_type", "origin"], "m").withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "low", "high")}).drop("least", "largest")


@query("SELECT c_custkey AS key, concat_ws(chr(10), CASE WHEN trim(c_name) <> '' THEN c_name END, CASE WHEN trim(c_mktsegment) <> '' THEN c_mktsegment END) AS program, CASE WHEN ends_with(c_name, right(c_custkey::VARCHAR, 3)) THEN substr(c_name, 1, length(c_name) - length(right(c_custkey::VARCHAR, 3))) END AS before FROM customer")
def text_assembly(spark, sf_dir):
    """Segments put together, and what stands before a suffix."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("key"), values.program_of([F.col("c_name"), F.lit(" "), F.col("c_mktsegment")]).alias("program"), values.before_suffix(F.col("c_name"), F.right(F.col("c_custkey").cast("string"), F.lit(3))).alias("before"))
