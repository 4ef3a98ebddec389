"""Line de-duplication with levelled sorted runs of line hashes.

The store keeps *runs*: Parquet tables of (``h1``, ``h2``, ``n``), sorted by the
hash, ``n`` being the number of documents of the run that hold the line.  A
batch of documents first anti-joins the runs' settled keys (those already found
in ``min_docs`` documents need no more counting), then adds its own counts as a
new run of level 0.  When a level holds ``fanout`` runs they are merged into one
run of the next level, so a key lies in at most ``fanout`` runs a level and the
number of runs grows with the logarithm of the number of batches.

Edge cases: a null text is one empty line; an empty key (blank line) is never
counted and never dropped; each row counts as one document, repeated rows
included; a null ``doc_id`` is a value like any other; other columns are not
read, so clashing names do no harm; an empty table gives an empty result.
Lines are identified by 128 bits of hash (two seeded XXH64).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, lower_ascii, new_path, strip_spaces, written

BATCHES = 4
FANOUT = 4
MIN_DOCS = 10
#: A key that holds more than one in so many of all (document, line) pairs is hot.
HOT_SHARE = 4000

_SALT = 7


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(_SALT), key).alias("h2")]


def _keys(text: Column) -> Column:
    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1), strip_spaces)


class LineRuns:
    """Levelled sorted runs of line hashes below one folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.spark, self.fanout, self.min_docs = spark, fanout, min_docs
        self.levels: list[list[str]] = []

    def _all(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, counts: DataFrame) -> str:
        path = new_path(self.spark, "line-run")
        counts.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _merged(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame:
        """Keys (and counts ``n``) of all runs found in ``min_docs`` documents or more."""
        return self._merged(self._all()).where(F.col("n") >= self.min_docs)

    def add(self, lines: DataFrame) -> None:
        """Add a batch: (``h1``, ``h2``), one row for each document and distinct line of it."""
        counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        if self._all():
            counts = counts.join(self.settled(), ["h1", "h2"], "left_anti")
        self._push(0, self._write(counts))

    def close(self) -> None:
        """Remove the runs."""
        for p in self._all():
            drop_path(self.spark, p)
        self.levels = []

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            for p in old:
                drop_path(self.spark, p)
            self._push(level + 1, merged)


def frequent_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """(``h1``, ``h2``, ``hot``) of the line keys of ``min_chars`` code points or more that ``min_docs`` documents hold.

    The documents are hashed once into a table partitioned by batch; the runs
    take one batch after the other.  ``hot`` marks keys that hold more than one
    in ``HOT_SHARE`` of all (document, line) pairs, so there are fewer than
    ``HOT_SHARE`` of them whatever the corpus.
    """
    spark = docs.sparkSession
    path = new_path(spark, "line-batches")
    (
        docs.select(F.col("doc_id"), F.explode(F.array_distinct(_keys(F.col("text")))).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), *_hashes(F.col("key")))
        .write.partitionBy("batch")
        .parquet(path)
    )
    schema = "h1 long, h2 long, batch int"
    table = spark.read.schema(schema).parquet(path)
    pairs = table.count()
    runs = LineRuns(spark, fanout, min_docs)
    for b in range(batches):
        runs.add(table.where(F.col("batch") == b).select("h1", "h2"))
    drop_path(spark, path)
    # a settled key isn't counted on, so its count is that of the batches up to then
    found = written(runs.settled().select("h1", "h2", (F.col("n") * HOT_SHARE > pairs).alias("hot")), "frequent-lines")
    runs.close()
    return found


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, led by as many underscores as it takes to clash with no column."""
    have = {c.lower() for c in docs.columns}
    lead = "_"
    while any((lead + n).lower() in have for n in names):
        lead += "_"
    return [lead + n for n in names]


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Only (document, position, hash) rows meet the frequent keys; the positions
    that go come back by document.  Text isn't shuffled with its lines.  Lines
    with a hot key are told by a broadcast of the hot keys (fewer than
    ``HOT_SHARE``) and take no part in the join: their join key is spread.
    """
    th, gone, lines_, oid, oth = _fresh(docs, "th", "gone", "lines", "oid", "oth")
    own = docs.withColumn(th, F.xxhash64(F.lit(_SALT), F.col("text")))
    hot = F.broadcast(frequent.where("hot").select("h1", "h2", F.lit(True).alias("hot")))
    cold = frequent.where("not hot").select(F.col("h1").alias("j1"), F.col("h2").alias("j2"), F.lit(True).alias("cold"))
    at = (
        own.select(F.col("doc_id").alias(oid), F.col(th).alias(oth), F.posexplode(_keys(F.col("text"))).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select(oid, oth, "pos", *_hashes(F.col("key")))
        .join(hot, ["h1", "h2"], "left")
        .select(oid, oth, "pos", "hot", F.when(F.col("hot"), F.xxhash64(oid, oth, "pos")).otherwise(F.col("h1")).alias("j1"), F.when(F.col("hot"), F.lit(0)).otherwise(F.col("h2")).alias("j2"))
        .join(cold, ["j1", "j2"], "left")
        .where(F.col("hot") | F.col("cold"))
        .groupBy(oid, oth)
        .agg(F.collect_set("pos").alias(gone))
    )
    out = own.join(at, F.col("doc_id").eqNullSafe(F.col(oid)) & (F.col(th) == F.col(oth)), "left").withColumn(lines_, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone))
    return out.select(
        *docs.columns,
        F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.concat_ws("\n", F.transform(left, lambda i: F.get(F.col(lines_), i)))).alias("kept_text"),
        F.size(lines_).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """``doc_id``, ``text``, ``kept_text``, ``n_lines``, ``n_dropped`` of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    return drop_lines(docs, frequent_lines(docs, batches, fanout, min_docs, min_chars), min_chars)
