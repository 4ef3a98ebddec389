"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes at eight positions.  Two fingerprints that differ
in at most ``MAX_BITS`` = 3 bits differ in at most three bytes, so they share at
least five positional bytes: that count is the filter.  The index posts each
distinct fingerprint under its bytes at three positions at once.  The eight
triples inside {0,1,2,3} and inside {4,5,6,7} suffice, because five shared
positions put three into one half; a posting is therefore 24 bits selective
and lists stay short as the number of fingerprints grows.  For every pair that
meets in a posting the shared positional bytes are tallied, pairs with fewer
than five are dropped, and the rest are verified by counting differing bits.

Only links that join what isn't joined yet leave a posting: a list is searched
breadth first against its unvisited members, so a group of ``m`` close copies
gives ``m - 1`` links and nearly linear work, never all pairs.  Texts with equal
fingerprints are one node from the start.

Edge cases: a null, empty or blank text has no words and fingerprint zero, and
links like any other; a text of fewer than three words is one shingle; a null
``doc_id`` gets a fingerprint and a component like any other but names no
component; repeated rows each get their row; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Positional bytes that two linked fingerprints share at least.
MIN_SHARED = 8 - MAX_BITS
#: Byte positions of a posting: every triple inside either half.
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]

#: Words are runs of other characters than these.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text."""
    text = text or ""
    words = WORDS.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        part = words[lo : lo + _CHUNK + SHINGLE - 1]
        if len(words) < SHINGLE:
            grams = [" ".join(words)]
        else:
            grams = map(" ".join, zip(part, part[1:], part[2:]))
        h = np.fromiter((digest(g.encode(), SEED) for g in grams), np.uint64)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = votes * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``carry`` and ``fp`` (the fingerprint's 64 bits as a long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(fingerprint(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, same), pa.array(fp, pa.int64())], names=[*same, "fp"])

    same = ["doc_id", *carry]
    schema = docs.select(*same, F.lit(0).cast("long").alias("fp")).schema
    return docs.select(*same, "text").mapInArrow(work, schema)


def _tally(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int8)
    for k in range(8):
        out += (x >> np.uint64(8 * k)) & np.uint64(255) == 0
    return out


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Index pairs that join all linked members of one posting list: count filter, then verification, breadth first."""
    links: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            x = fps[k] ^ fps[rest]
            near = _tally(x) >= MIN_SHARED
            near[near] = np.bitwise_count(x[near]) <= max_bits
            if near.any():
                got = rest[near].tolist()
                links += [(k, g) for g in got]
                queue += got
                rest = rest[~near]
    return links


def _postings(fps: DataFrame) -> DataFrame:
    """(``key``, ``fp``): every distinct fingerprint under each triple of positional bytes."""
    fp = F.col("fp")
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))
    key = lambda t, ps: F.lit(t << 24) + F.shiftleft(byte(ps[0]), 16) + F.shiftleft(byte(ps[1]), 8) + byte(ps[2])
    return fps.select("fp", F.explode(F.array(*[key(t, ps) for t, ps in enumerate(TRIPLES)])).alias("key"))


def _links_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links; a list that goes on in the next batch is carried over."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        a, b = [], []
        two = starts[ends - starts == 2]
        x = fp[two] ^ fp[two + 1]
        ok = (_tally(x) >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS)
        a += fp[two][ok].tolist()
        b += fp[two + 1][ok].tolist()
        for lo, hi in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            for i, j in spanning_links(fp[lo:hi]):
                a.append(int(fp[lo + i]))
                b.append(int(fp[lo + j]))
        return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["fa", "fb"])

    for batch in batches:
        key = np.r_[key, batch.column("key").to_numpy()]
        fp = np.r_[fp, batch.column("fp").to_numpy().view(np.uint64)]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield out(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield out(key, fp)


def near_duplicates(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``carry``, ``fp``, ``component_id`` (the smallest ``doc_id`` reachable over links) and ``root`` (a fingerprint that names the group, never null) of every row of ``docs``."""
    fps = written(fingerprints(docs, carry), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    links = written(
        _postings(nodes.select("fp")).repartition("key").sortWithinPartitions("key").mapInArrow(_links_of_runs, "fa long, fb long").distinct(),
        "fingerprint-links",
    )
    # components over the fingerprints themselves, so that documents without an id take part too
    roots = components(links.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", nodes.node.alias("least"), F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = member.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return fps.join(class_of, F.col("fp") == F.col("_fp")).select("doc_id", *carry, "fp", "component_id", "root")
