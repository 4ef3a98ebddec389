"""Queries over operators that turn raw sources into records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from .registry import query, read

_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/', ''), '/+$', '')"


@query(
    rf"""SELECT page_id, regexp_replace(p, '/[0-9]+$', '') AS slug, CASE WHEN regexp_matches(p, '/[0-9]+$') THEN regexp_extract(p, '/([0-9]+)$', 1)::BIGINT ELSE 1 END AS revision
FROM (SELECT page_id, {_PATH} AS p FROM pages)"""
)
def page_slug_revisions(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]+/", "")
    return read(spark, sf_dir, "pages").select("page_id", ingest.slug_revision(path).alias("s")).select("page_id", "s.*")


_NAMES = "CASE event_id % 5 WHEN 0 THEN 'block_slow_' || user_id WHEN 1 THEN 'a/slow_' || user_id || '.js' WHEN 2 THEN 'xslow_' || user_id || 'z' WHEN 3 THEN 'slow_1_slow_' || user_id ELSE 'fast_' || user_id END"


@query(
    rf"""SELECT event_id, coalesce(nullif(regexp_extract(n, '(?:^|_)slow_([0-9]+)$', 1), ''), nullif(regexp_extract(n, '(?:^|/)slow_([0-9]+)\.js$', 1), ''), nullif(regexp_extract(n, 'slow_([0-9]+)', 1), ''))::BIGINT AS slow_id
FROM (SELECT event_id, {_NAMES} AS n FROM events)"""
)
def event_slow_ids(spark, sf_dir):
    """Ids out of names of four forms made by rule."""
    return read(spark, sf_dir, "events").select("event_id", ingest.slow_id(F.expr(_NAMES)).alias("slow_id"))


@query("SELECT conv_id, turn, sha256(role) AS role_sha256, sha256(text) AS text_sha256 FROM conversations")
def conversation_hashed_records(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    r = ingest.hashed(F.create_map(F.lit("role"), "role", F.lit("text"), "text"))
    return rows.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", F.col("r")["role"].alias("role_sha256"), F.col("r")["text"].alias("text_sha256"))


#: Findings made by rule: some in build folders, some without a file, some beyond their file.
_FINDINGS = [
    "event_id AS id",
    "CASE WHEN event_id % 11 = 0 THEN 'dist/a' WHEN event_id % 7 = 0 THEN 'none/' || user_id ELSE '/doc/' || user_id END AS file_path",
    "CAST(event_id % 6 AS INT) AS start_line",
    "CAST(event_id % 6 + event_id % 4 - 1 AS INT) AS end_line",
]


@query(
    rf"""WITH f AS (SELECT {", ".join(_FINDINGS)} FROM events), d AS (
  SELECT 'doc/' || doc_id AS path, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) END AS ls FROM documents
)
SELECT id, CASE WHEN file_path LIKE 'dist/%' THEN '[Build artifact - skipped]' WHEN ls IS NULL THEN '[File not found]' WHEN start_line < 1 OR end_line > len(ls) THEN '[Line out of range]'
  WHEN end_line < start_line THEN '' ELSE array_to_string(ls[start_line:end_line], chr(10)) END AS code_snippet
FROM f LEFT JOIN d ON d.path = ltrim(file_path, '/')"""
)
def finding_snippets(spark, sf_dir):
    """Findings with the lines that they point to; documents are the files."""
    findings = read(spark, sf_dir, "events").selectExpr(*_FINDINGS)
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("value"))
    return ingest.with_snippets(findings, files).select("id", "code_snippet")


@query(
    """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), t AS (SELECT doc_id, a, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i - 1 = doc_id % len(a) OR (doc_id % 3 = 0 AND i = 1) THEN a[i] || '!' ELSE a[i] END) AS b FROM s
), p AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) - 1, len(a)) AS prefix FROM t
), q AS (SELECT *, CASE WHEN prefix = len(a) THEN 0 ELSE len(a) - list_max(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) END AS suffix FROM p)
SELECT doc_id, prefix::INT AS prefix, suffix::INT AS suffix, len(a) - prefix - suffix = 1 AND length(a[prefix + 1]) > 0 AS comparable FROM q"""
)
def document_single_differences(spark, sf_dir):
    """Lines as statements (those with text are expressions) against a copy in which one or two lines are altered by rule."""
    a = read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    typed = lambda t: F.when(F.length(t) > 0, "ExpressionStatement").otherwise("EmptyStatement").alias("type")
    altered = lambda i: (i == F.col("doc_id") % F.size("ls")) | ((F.col("doc_id") % 3 == 0) & (i == 0))
    first = F.transform("ls", lambda t: F.struct(t.alias("text"), typed(t)))
    second = F.transform("ls", lambda t, i: F.struct(F.when(altered(i), F.concat(t, F.lit("!"))).otherwise(t).alias("text"), typed(t)))
    sides = a.select("doc_id", first.alias("a"), second.alias("b"))
    return sides.select("doc_id", ingest.single_difference(F.col("a"), F.col("b")).alias("d")).select("doc_id", "d.*")


_RUN = "SELECT user_id, event_type, max(value) > 100 AS ok FROM {} WHERE event_id % 2 = {} GROUP BY user_id, event_type"


@query(
    f"""WITH b AS ({_RUN.format("events", 0)}), a AS ({_RUN.format("events", 1)})
SELECT count(*) FILTER (WHERE a.ok AND NOT coalesce(b.ok, false)) AS newly_successful, count(*) FILTER (WHERE NOT a.ok AND coalesce(b.ok, false)) AS newly_broken
FROM a LEFT JOIN b USING (user_id, event_type)"""
)
def event_outcome_changes(spark, sf_dir):
    """Users' events of even ids as the run before, of odd ids as the run after."""
    e = read(spark, sf_dir, "events")
    run = lambda side: e.where(F.col("event_id") % 2 == side).groupBy("user_id", "event_type").agg((F.max("value") > 100).alias("ok"))
    return ingest.outcome_changes(run(0), run(1), ["user_id", "event_type"])


@query("SELECT member, count(*) AS attempted, count(*) FILTER (WHERE p_size > 25) AS success FROM (SELECT unnest(string_split(p_name, ' ')) AS member, p_size FROM part) GROUP BY member")
def part_word_involvement(spark, sf_dir):
    """Words of part names as libraries; parts above size 25 succeed."""
    return ingest.involvement(read(spark, sf_dir, "part").select(F.split("p_name", " ", -1).alias("w"), (F.col("p_size") > 25).alias("ok")), "w")
