"""Quality rules whose cutoffs are learned from mergeable quantile sketches.

Every text gets exact features.  For each (language, source) the features of
the texts that pass the base rules are summarised by a log-bucket quantile
sketch: a table of (group, metric, bucket, count) whose buckets grow by 5 %.
Sketches merge by adding counts, so partial aggregation builds them and the
language's sketch is the sum of its sources'.  A group's sketch is merged with
its language's at a fixed weight, so that groups of few texts lean on their
language.  Median, quartiles and outer tenths of that give a fence for each
metric: beyond the spread of the middle half and of the tail.  A join with the
fences filters.

Edge cases: a null text has no words and fails the base rule; null languages
and sources are groups of their own; a text that fails the base rules is never
kept; repeated rows each get their row and each count in the sketch; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, space_words, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Growth of a sketch bucket: quantiles are right within 5 %.
GAMMA = 1.05
#: Texts that a language's sketch weighs in each of its groups.
PRIOR = 100
#: Quantiles read from a sketch, in twentieths.
RANKS = (2, 5, 10, 15, 18)
#: Distances from the median to a quartile, and to an outer tenth, that a fence lies beyond the median at least.
SPREAD, TAIL = 6, 4
#: metric -> slack in thousandths that a fence has besides the spread (so a group without spread has no cutoff at its median)
SLACK = {"chars_per_word": 1000, "symbols_per_word": 100, "dup_line_share": 400, "repeat_share": 250}
#: Metrics with a lower fence too.
TWO_SIDED = ("chars_per_word",)


def _repeat_words(win: Column, order: Column, at: Column, n: int = WINDOW) -> tuple[Column, Column, Column]:
    """Expressions for: windows sorted with their place; places of repeated windows; words these cover."""
    sorted_windows = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, k: F.coalesce(F.get(order, k)["h"] == s["h"], F.lit(False))
    places = F.sort_array(F.filter(F.transform(order, lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return sorted_windows, places, covered


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the exact features of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = (
        docs.select("doc_id", "lang", "source", space_words(F.col("text")).alias("words"), lines.alias("lines"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
        .drop("words", "lines")
    )
    wh = F.col("wh")
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)]))
    df = df.withColumn("win", F.when(F.col("n_words") > WINDOW, windows)).drop("wh")
    repeats = F.size("win") > F.size(F.array_distinct("win"))
    order, places, covered = _repeat_words(F.col("win"), F.col("order"), F.col("at"))
    return (
        df.withColumn("order", F.when(repeats, order))
        .drop("win")
        .withColumn("at", places)
        .drop("order")
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .drop("at")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")
    )


def _metrics() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")
    return {"chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")}


def sketch(feats: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``metric``, ``bucket``, ``n``): the sketches of all groups."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in _metrics().items()])).alias("m")
    bucket = F.when(F.col("m.v") <= 0, 0).otherwise(1 + F.floor(F.ln(F.col("m.v").cast("double")) / F.ln(F.lit(GAMMA)))).cast("int")
    return feats.where(~F.col("base_failed")).select("lang", "source", pairs).groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _packed(sk: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, metric, ``total_<name>``, ``<name>``: array of (bucket, n) in order); a group and metric has at most a few hundred buckets."""
    merged = sk.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    return merged.groupBy(*keys, "metric").agg(F.sum("n").alias(f"total_{name}"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias(name))


def _value(bucket: Column) -> Column:
    """The lower edge of a bucket."""
    return F.when(bucket == 0, 0).otherwise(F.floor(F.pow(F.lit(GAMMA), (bucket - 1).cast("double")))).cast("long")


def quantiles(sk: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``metric``, ``q<r>`` for each r of ``RANKS``): the r / 20 quantiles of each group.

    A group's sketch is merged with its language's, the latter scaled to the weight of ``PRIOR`` texts: a group of few texts is near
    its language, one of many near itself, and nothing switches at any size.
    """
    own, wide = _packed(sk, ["lang", "source"], "own"), _packed(sk, ["lang"], "wide")
    both = own.join(wide.withColumnsRenamed({"lang": "_lang", "metric": "_metric"}), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric")))
    upto = lambda name, x: F.aggregate(F.filter(name, lambda y: y["bucket"] <= x["bucket"]), F.lit(0).cast("long"), lambda a, y: a + y["n"])
    weight = lambda x: upto("own", x) + F.lit(float(PRIOR)) * upto("wide", x) / F.col("total_wide")
    # the language's buckets are a superset of the group's
    cum = F.transform("wide", lambda x: F.struct(x["bucket"].alias("bucket"), weight(x).alias("upto")))
    both = both.withColumn("cum", cum)
    least = lambda r: F.get(F.filter("cum", lambda x: F.lit(20.0) * x["upto"] >= F.lit(float(r)) * (F.col("total_own") + F.lit(float(PRIOR)))), F.lit(0))["bucket"]
    return both.select("lang", "source", "metric", *[_value(least(r)).alias(f"q{r}") for r in RANKS])


def fences(sk: DataFrame) -> DataFrame:
    """(``lang``, ``source``, then ``lo_<metric>`` and ``hi_<metric>``): the cutoffs of every group."""
    both, out = quantiles(sk), []
    for m, slack in SLACK.items():
        here = F.col("metric") == m
        beyond = lambda a, b: F.greatest(SPREAD * F.abs(F.col(a) - F.col("q10")), TAIL * F.abs(F.col(b) - F.col("q10"))) + slack
        out.append(F.max(F.when(here, F.col("q10") + beyond("q15", "q18"))).alias(f"hi_{m}"))
        if m in TWO_SIDED:
            out.append(F.max(F.when(here, F.col("q10") - beyond("q5", "q2"))).alias(f"lo_{m}"))
    return both.groupBy("lang", "source").agg(*out)


def quality_filter(docs: DataFrame) -> DataFrame:
    """Features, fences' verdict (``kept``) and ``base_failed`` of every row of ``docs``."""
    feats = written(features(docs), "quality-features")
    limits = fences(sketch(feats)).withColumnsRenamed({"lang": "_l", "source": "_s"})
    joined = feats.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    ok = ~F.col("base_failed")
    for m, v in _metrics().items():
        ok = ok & F.coalesce(v <= F.col(f"hi_{m}"), F.lit(True))
        if m in TWO_SIDED:
            ok = ok & F.coalesce(v >= F.col(f"lo_{m}"), F.lit(True))
    return joined.withColumn("kept", ok).select(*feats.columns, "kept")
