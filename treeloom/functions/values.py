"""Scalar functions over names, values, labels and ids; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error classes in the order in which they are tried, and what tells them.
ERRORS = {
    "ModuleNotFound": "Cannot find module",
    "OutOfMemory": "JavaScript heap out of memory",
    "ReferenceError": "ReferenceError",
    "TypeError": "TypeError",
    "SyntaxError": "SyntaxError",
    "RangeError": "RangeError",
}


def normalize_value(v: Column) -> Column:
    """``$v0`` -> ``$v`` for the markers v, f, k, n, s (not r); null is empty."""
    return F.regexp_replace(F.coalesce(v, F.lit("")), r"^(\$[vfkns])\d+$", "$1")


def label(name: Column, value: Column, level: int, literal: Column | None = None) -> Column:
    """A node's label: its name where the value is a placeholder (or, from level 2, a literal), else ``name:value``."""
    hole = F.coalesce(value, F.lit("")).rlike(r"^(?:VAR|FUNCTION|KEY|CLASS)_\d+$")
    if level >= 2 and literal is not None:
        hole = hole | literal
    return F.when(hole, name).otherwise(F.concat_ws(":", name, F.coalesce(value, F.lit(""))))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def pair_hash(a: Column, b: Column) -> Column:
    """sha256 of the sorted pair joined by ``::``."""
    return F.sha2(pair_key(a, b), 256)


def class_id(level: int, content: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"L{level}_{prefix}_"), F.substring(F.sha2(content, 256), 1, 8))


def error_class(stderr: Column) -> Column:
    """The first class that the text tells, else (also for null) ``OtherError``."""
    return F.coalesce(*[F.when(F.contains(stderr, F.lit(told)), F.lit(name)) for name, told in ERRORS.items()], F.lit("OtherError"))


def words(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    """The distinct adjacent pairs of an array of tokens, each joined by U+0001."""

    def of(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws("\x01", F.get(t, i - 1), F.get(t, i)))
        return F.when(F.size(t) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))

    # bound by a one-element transform, so that the tokens are computed once and not for each pair
    return F.get(F.transform(F.array(tokens), of), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def condition_name(scope: Column, level: Column, tau: Column) -> Column:
    return F.format_string("%s/%s/tau%02d", scope, level, F.round(tau * 10).cast("int"))


def slug_id(i: Column) -> Column:
    return F.lpad(i.cast("string"), 5, "0")


def is_punctuation(name: Column, marks: tuple[str, ...]) -> Column:
    return F.trim(name).isin(*marks)


def program_of(segments: list[Column]) -> Column:
    """The segments that aren't blank, one below the other."""
    return F.concat_ws("\n", *[F.when(F.trim(s) != "", s) for s in segments])


def before_suffix(text: Column, suffix: Column) -> Column:
    """What stands before ``suffix`` at the end of ``text``, null if it doesn't end so."""
    return F.when(F.endswith(text, suffix), F.left(text, F.length(text) - F.length(suffix)))
