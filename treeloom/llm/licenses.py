"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

The units compared are every line, every paragraph (lines up to an empty one)
and the whole text.  A unit of ``a`` bigrams can reach a Dice coefficient ``t``
with a template of ``b`` only if ``a`` lies between ``b * t / (2 - t)`` and
``b * (2 - t) / t``; templates outside these bounds are not compared, and units
outside the bounds of all templates aren't cut into bigrams.

A notice can share its line with other words or be wrapped and split by blank
lines, so a template that none of these units matches is sought in windows of
the whole text's words, whatever its lines: from the template's length up to
the upper bound times that length.  A shorter window would need only two thirds
of the template.  A bigram of the template at either side of a window raises
its coefficient, so windows start and end where runs of such bigrams do (or at
the least length, or the text's end); the best window is the match.  All
windows from one start are scored in one pass over the longest of them, so the
work of a text grows with its starts times the template's length.  It is left
out if it is a part of a longer notice's match: lies in its unit and shares
only bigrams that the longer template has too.

A match shares at least ``b * t / (2 - t)`` bigrams with its template.  So
rows that hold none of the words of :func:`anchor_words` can't match and are not
cut at all, and templates of which a row holds too few bigrams get no windows.

Everything is one projection over a row: no shuffle, no join, no skew.

Edge cases: a null or empty text has no units and no match; ties go to the
higher coefficient, then the alphabetically first template; repeated rows each
get their row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .license_texts import TEXTS

THRESHOLD = 0.8

#: Window starts that are judged together before each is judged by itself.
START_BLOCK = 64

#: Well-known licence notices, and beginnings of texts (``bsd-opening`` is that of BSD-2 and BSD-3 alike), besides whole texts.
TEMPLATES = {
    **TEXTS,
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: ASCII characters that aren't letters, digits or a new line separate words.
_SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return re.sub(_SEPARATORS, " ", text.lower()).split()


def template_bags(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    """The distinct word bigrams of every template, in order."""
    out = {}
    for name, text in sorted(templates.items()):
        words = _words(text)
        out[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    return out


#: Words too common to tell a licence by; they are anchors only where a template has no others.
_COMMON = frozenset("a above all an and any are as at basis be by can code copies copy deal do file files following for free from general in into is it may no not of on or other such that the this to under was which will with without you your 0 1 2 3 4".split())


def anchor_words(bags: dict[str, list[str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every match of any template holds at least one: too few bigrams to match are without them."""
    low, chosen = threshold / (2 - threshold) - 1e-9, set()
    for bag in sorted(bags.values(), key=len):
        free = [b.split(" ") for b in bag if not chosen & set(b.split(" "))]
        while free and len(free) >= len(bag) * low:
            count = Counter(w for b in free for w in set(b))
            best = min(count, key=lambda w: (w in _COMMON, -count[w], w))
            chosen.add(best)
            free = [b for b in free if best not in b]
    return sorted(chosen)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def literal_words(words: list[str]) -> Column:
    """An array literal; ``words`` hold no new line."""
    return F.split(F.lit("\n".join(words)), "\n", -1)


def gram_groups(grams: Column) -> Column:
    """Array of (``gram``, ``at``: its places from 1, ascending) of every distinct gram of a non-empty array."""

    def grouped(s: Column) -> Column:
        gram = lambda j: F.get(s, j)["gram"]
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: ~gram(j).eqNullSafe(gram(j - 1)))
        places = lambda j, end: F.transform(F.slice(s, j + 1, end - j), lambda x: x["k"])
        return let(firsts, lambda f: F.transform(f, lambda j, r: F.struct(gram(j).alias("gram"), places(j, F.coalesce(F.get(f, r + 1), F.size(s))).alias("at"))))

    return let(F.sort_array(F.transform(grams, lambda x, k: F.struct(x.alias("gram"), (k + 1).alias("k")))), grouped)


def gram_places(groups: Column, bag: Column) -> Column:
    """(``k``, ``before``: the place of the same gram before it or 0, ``hit``: in ``bag``) of every place, in order.

    Groups and bag are merged by sorting: a group's gram is in the bag if the same gram stands before it.
    """
    merged = F.sort_array(F.concat(F.transform(bag, lambda x: F.struct(x.alias("gram"), F.lit(-1).alias("r"))), F.transform(groups, lambda x, r: F.struct(x["gram"].alias("gram"), r.alias("r")))))
    told = let(merged, lambda m: F.transform(m, lambda x, j: F.struct(x["r"].alias("r"), x["gram"].eqNullSafe(F.get(m, j - 1)["gram"]).alias("hit"))))
    spread = lambda at, hit: F.transform(at, lambda k, j: F.struct(k.alias("k"), F.coalesce(F.get(at, j - 1), F.lit(0)).alias("before"), hit.alias("hit")))
    return F.sort_array(F.flatten(F.transform(F.filter(told, lambda x: x["r"] >= 0), lambda x: spread(F.get(groups, x["r"])["at"], x["hit"]))))


def normalised(text: Column) -> Column:
    return F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS, " ")


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``matches``: array of (``license``, ``dice``, ``unit`` text) of every unit and template that reach ``threshold``, and of the best window of a template that no unit matches."""
    bags = template_bags(templates)
    # the bounds are a little wide, so that rounding prunes no unit that lies on one
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    sizes = [len(b) for b in bags.values()]
    least, most = min(sizes) * low, max(sizes) * high
    spans = {k: len(_words(text)) - 1 for k, text in templates.items()}
    tpl = F.array(*[F.struct(F.lit(k).alias("id"), literal_words(b).alias("bag"), F.lit(len(b)).alias("n"), F.lit(spans[k]).alias("span")) for k, b in bags.items()])
    known = literal_words(sorted({x for b in bags.values() for x in b}))
    anchors = r"[ \n](?:" + "|".join(map(re.escape, anchor_words(bags, threshold))) + r")[ \n]"
    norm = F.col("norm")
    units = F.array_distinct(F.transform(F.concat(F.split(norm, "\n", -1), F.transform(F.split(norm, r"\n *\n[ \n]*", -1), lambda p: F.translate(p, "\n", " ")), F.array(F.translate(norm, "\n", " "))), lambda u: F.btrim(u)))
    # a unit has a blank for each bigram at least, so most are sorted out by their length before they're cut
    words = F.filter(F.transform(F.filter(units, lambda u: F.length(u) > 2 * least), lambda u: F.split(u, " +", -1)), lambda w: (F.size(w) - 1 >= least) & (F.size(w) >= 2))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    bag = F.transform("words", lambda w: F.array_distinct(grams(w)))
    in_bounds = lambda b, t: (F.size(b) >= t["n"] * F.lit(low)) & (F.size(b) <= t["n"] * F.lit(high))
    dice = lambda b, t: F.lit(2.0) * F.size(F.array_intersect(b, t["bag"])) / (F.size(b) + t["n"])
    scored = F.flatten(
        F.transform(
            "bags",
            lambda b, k: F.transform(
                F.filter(F.col("tpl"), lambda t: in_bounds(b, t)),
                lambda t: F.struct(t["id"].alias("license"), dice(b, t).alias("dice"), F.array_join(F.get(F.col("words"), k), " ").alias("unit")),
            ),
        )
    )

    all_words, g = F.col("all_words"), F.col("grams")
    n_grams = F.size(g)

    def best_window(t: Column) -> Column:
        """(``dice``, -``size``, -``start``) of the template's best window, null without one."""
        last = n_grams - t["span"] + 1
        limit = F.floor(t["span"] * F.lit(high)).cast("int")
        need = F.ceil(t["n"] * F.lit(low)).cast("int")

        def from_places(places: Column) -> Column:
            new = lambda i, size: F.filter(F.slice(places, i, size), lambda x: x["before"] < i)
            shared = lambda i, size: F.size(F.filter(new(i, size), lambda x: x["hit"]))

            def starts(at: Column) -> Column:
                opens = lambda k, r: ~F.get(at, r - 1).eqNullSafe(k - 1)
                early = F.filter(at, lambda k, r: (k < last) & opens(k, r) & (F.get(at, r + need - 1) < k + limit))
                late = F.filter(at, lambda k, r: (k >= last) & opens(k, r))
                return F.concat(early, F.transform(F.slice(late, 1, 1), lambda k: last))

            def from_start(i: Column) -> Column:
                def step(a: Column, x: Column) -> Column:
                    size, fresh = x["k"] - i + 1, x["before"] < i
                    d, s = a["d"] + fresh.cast("int"), a["s"] + (fresh & x["hit"]).cast("int")
                    ends = (size == t["span"]) | (size == limit) | (x["hit"] & ~F.coalesce(F.get(places, x["k"])["hit"], F.lit(False)))
                    score = F.struct((F.lit(2.0) * s / (d + t["n"])).alias("dice"), (-size).alias("size"))
                    return F.struct(d.alias("d"), s.alias("s"), F.when(ends, F.greatest(a["best"], score)).otherwise(a["best"]).alias("best"))

                # every window from here holds the span's first grams, so those are only counted
                head = t["span"] - 1
                none = F.lit(None).cast("struct<dice:double,size:int>")
                zero = F.struct(F.size(new(i, head)).alias("d"), shared(i, head).alias("s"), none.alias("best"))
                best = F.aggregate(F.slice(places, i + head, limit - head), zero, step, lambda a: a["best"])
                return let(best, lambda w: F.struct(w["dice"].alias("dice"), w["size"].alias("size"), (-i).alias("start")))

            def from_starts(st: Column) -> Column:
                # no start of a block shares enough if the windows of all together don't; then each is judged by its longest window
                blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(st) - 1, F.lit(0)), F.lit(START_BLOCK)), lambda b: F.slice(st, b + 1, START_BLOCK))
                able = F.filter(blocks, lambda b: shared(F.get(b, F.lit(0)), F.get(b, F.size(b) - 1) - F.get(b, F.lit(0)) + limit) >= need)
                return F.array_max(F.transform(F.filter(F.flatten(able), lambda i: shared(i, limit) >= need), from_start))

            return let(F.transform(F.filter(places, lambda x: x["hit"]), lambda x: x["k"]), lambda at: let(starts(at), from_starts))

        return let(gram_places(F.col("groups"), t["bag"]), from_places)

    # the templates that no unit matches and of which the text holds enough bigrams, for the sought ones only
    sought = F.filter(
        F.col("tpl"),
        lambda t: (n_grams >= t["span"])
        & (F.size("known") >= t["n"] * F.lit(low))
        & ~F.exists("by_unit", lambda m: m["license"] == t["id"])
        & (F.size(F.array_intersect(F.col("known"), t["bag"])) >= t["n"] * F.lit(low)),
    )
    windows = F.filter(F.transform("sought", lambda t: F.struct(t.alias("t"), best_window(t).alias("best"))), lambda x: x["best"]["dice"] >= threshold)
    found = F.transform(
        windows, lambda x: F.struct(x["t"]["id"].alias("license"), x["best"]["dice"].alias("dice"), F.array_join(F.slice(all_words, -x["best"]["start"], F.lit(1) - x["best"]["size"]), " ").alias("unit"))
    )
    the_bag = lambda name: F.get(F.filter(F.col("tpl"), lambda t: t["id"] == name), F.lit(0))["bag"]
    padded = lambda m: F.concat(F.lit(" "), m["unit"], F.lit(" "))
    part = lambda m, whole: (
        (F.size(the_bag(whole["license"])) > F.size(the_bag(m["license"])))
        & F.contains(padded(whole), padded(m))
        & (F.size(F.array_except(F.array_intersect(grams(F.split(m["unit"], " ")), the_bag(m["license"])), the_bag(whole["license"]))) == 0)
    )
    own = F.filter("by_window", lambda m: ~F.exists(F.concat("by_unit", "by_window"), lambda whole: part(m, whole)))
    empty = F.array().cast("array<string>")
    return (
        docs.select("doc_id", normalised(F.col("text")).alias("norm"))
        .withColumn("norm", F.when(F.concat(F.lit(" "), norm, F.lit(" ")).rlike(anchors), norm).otherwise(F.lit("")))
        .withColumn("words", words)
        .withColumn("bags", F.transform(bag, lambda b: F.when(F.size(b) <= most, b).otherwise(empty)))
        .withColumn("tpl", tpl)
        .withColumn("by_unit", F.filter(scored, lambda m: m["dice"] >= threshold))
        .withColumn("all_words", F.filter(F.split(norm, r"[ \n]+", -1), lambda w: w != ""))
        .withColumn("grams", F.when(F.size(all_words) >= 2, grams(all_words)).otherwise(empty))
        .withColumn("known", F.when(n_grams > 0, F.array_intersect(g, known)).otherwise(empty))
        .withColumn("sought", sought)
        .withColumn("groups", F.when((F.size("sought") > 0) & (n_grams > 0), gram_groups(g)))
        .withColumn("by_window", found)
        .select("doc_id", F.concat("by_unit", own).alias("matches"))
    )
