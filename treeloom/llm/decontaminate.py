"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and benchmark items become sequences of word numbers.  A pattern is a
window of ``WINDOW`` consecutive item words (an item of fewer words is one
pattern).  Patterns of one length ``m`` share a shift table from blocks of two
words to the distance that the search may skip: a block that occurs in no
pattern skips ``m - 1`` words.  A block that ends patterns selects, by its
hash, the bucket of test strings, and a direct comparison confirms them.

Benchmark items are dealt to blocks of about ``BLOCK_BYTES`` of text, each
broadcast by itself.  A worker searches a batch of documents for one block after
the other and holds the tables of one block at a time, so one pass over the
documents serves up to ``PASS_BYTES`` of benchmark text.  Only beyond that are the
hits so far carried along in a written table.

Edge cases: null and empty texts have no words and no hit; an item without
words has no pattern; equal items (or repeated rows) are all reported, an
``item_id`` once; a null ``item_id`` marks hits but has no name to report;
documents keep their rows, repeated ones too; extra columns are not read; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
BLOCK_BYTES = 1 << 20
PASS_BYTES = 64 << 20

#: A word is a run of these, after lower-casing A-Z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Words of a text, A-Z lower-cased and nothing else."""
    if not text:
        return []
    return WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class WuManber:
    """Shift tables and suffix buckets for word patterns of several lengths; built once, searched many times."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.codes: dict[str, int] = {}
        patterns: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = [self.codes.setdefault(x, len(self.codes) + 1) for x in words_of(text)]
            m = min(len(w), window)
            for i in range(len(w) - m + 1 if m else 0):
                patterns[m][tuple(w[i : i + m])].add(item)
        self.base = len(self.codes) + 1
        #: pattern length -> (block length, shift table, suffix buckets)
        self.tables: dict[int, tuple[int, dict[int, int], dict[int, list]]] = {}
        for m, of in sorted(patterns.items()):
            block = min(2, m)
            shift: dict[int, int] = {}
            buckets: dict[int, list] = defaultdict(list)
            for p, ids in of.items():
                for end in range(block, m + 1):
                    key = self._block(p, end, block)
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[self._block(p, m, block)].append((list(p), frozenset(ids)))
            self.tables[m] = (block, shift, dict(buckets))

    def _block(self, p, end: int, block: int) -> int:
        return p[end - 1] if block == 1 else p[end - 2] * self.base + p[end - 1]

    def search(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """((start, end) of every occurrence, item ids that occur)."""
        get = self.codes.get
        seq = [get(w, 0) for w in words]
        spans: list[tuple[int, int]] = []
        found: set = set()
        n, base = len(seq), self.base
        for m, (block, shift, buckets) in self.tables.items():
            skip = m - block + 1
            end = m
            while end <= n:
                last = seq[end - 1]
                key = last if block == 1 else seq[end - 2] * base + last
                step = shift.get(key, skip) if last else skip if block == 1 else m
                if step:
                    end += step
                    continue
                for p, ids in buckets[key]:
                    if seq[end - m : end] == p:
                        spans.append((end - m, end))
                        found |= ids
                end += 1
        return spans, found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of about ``block_bytes`` of text, dealt by a hash of the item."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // block_bytes
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def _passes(benchmark: DataFrame, block_bytes: int, pass_bytes: int) -> Iterator[list[list[tuple[int | None, str | None]]]]:
    """Blocks in groups that one pass over the documents serves."""
    blocks = _blocks(benchmark, block_bytes)
    while group := list(islice(blocks, max(1, pass_bytes // block_bytes))):
        yield group


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``text``, the columns ``carry``, ``n_words``, ``spans`` (word ranges hit: start, end, start, end ...), ``items`` of every row of ``docs``."""
    spark = docs.sparkSession
    same = ["doc_id", "text", *carry]
    cur = docs.select(*same, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<long>").alias("items"))
    schema = cur.schema
    for k, group in enumerate(_passes(benchmark, block_bytes, pass_bytes)):
        if k:
            cur = written(cur, "hits")
        shared = [spark.sparkContext.broadcast(block) for block in group]

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            only = WuManber(shared[0].value, window) if len(shared) == 1 else None
            for batch in batches:
                words = [words_of(t) for t in batch.column("text").to_pylist()]
                spans = batch.column("spans").to_pylist()
                items = [set(x) for x in batch.column("items").to_pylist()]
                for block in shared:
                    wm = only or WuManber(block.value, window)
                    for n, w in enumerate(words):
                        s, f = wm.search(w)
                        if s:
                            spans[n] = [*spans[n], *(x for ab in s for x in ab)]
                            items[n] |= f - {None}
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, same), pa.array(map(len, words), pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(map(sorted, items), pa.list_(pa.int64()))],
                    names=[*same, "n_words", "spans", "items"],
                )

        cur = cur.mapInArrow(search, schema)
    return cur


def hit_words(spans: Column) -> Column:
    """Words inside any of the spans (flat array of start, end, start, end ...)."""
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, 2 * i).alias("a"), F.get(spans, 2 * i + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], p["b"]).alias("upto"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, start, step, lambda s: s["n"]))
