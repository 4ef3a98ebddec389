"""Suffix-array de-duplication: repeated 50-byte strings, by induced sorting in shards.

A string of ``LENGTH`` = 50 bytes holds 31 grams of 20 bytes; the one with the
least hash is its anchor.  Equal strings have equal anchors, so strings can be
dealt to shards by their anchor's hash, and neighbouring strings with one anchor
travel as one snippet of 50 to 80 bytes.

1. Documents are packed into compressed blocks, written to the shared folder.
2. Every block says which anchor hashes it holds (each once); the shards answer
   which of them occur twice or more anywhere.
3. Every block sends the distinct snippets of those anchors, each with the
   smallest ``doc_id`` of the block that holds it.
4. A shard builds the suffix array of its distinct snippets: suffixes are
   classified, leftmost smaller substrings sorted recursively, the array induced
   from them bucket by bucket in linear time, and permuted common prefixes
   computed at irreducible places.  Suffixes that agree in 50 bytes or more are
   one string; the smallest ``doc_id`` of any holder tells who may keep it.
5. Every block removes the bytes that the answers cover.

A passage that a third of all documents hold is one hash and one snippet for
each block, whatever the number of its copies.

Edge cases: null and empty texts have no bytes; texts below 50 bytes lose
nothing; equal ids aren't smaller, so repeated rows of one id keep what a single
row keeps; a document without an id neither loses bytes nor takes any; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
WIDEST = LENGTH + SPAN - 1
#: Bytes of text from which a block is closed.
BLOCK_BYTES = 8 << 20
#: No byte of UTF-8: pads snippets and separates them.
PAD = 0xFF
_CHUNK = 1 << 16
_MASK = np.uint64(0xFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(50).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = np.random.default_rng(51).integers(0, 2**63, WIDEST // 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> list[np.uint64]:
    out = [_BASE]
    while len(out) < n:
        out.append(out[-1] * out[-1])
    return out


with np.errstate(over="ignore"):
    _POW = _powers(5)  # base to the powers 1, 2, 4, 8, 16


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every 20-byte gram: 16 bytes by doubling, and 4 more."""
    h = _TABLE[data]
    four = h
    for k in range(4):
        n = 1 << k
        h = h[:-n] * _POW[k] + h[n:]
        if k == 1:
            four = h
    out = h[: len(four) - 16] * _POW[2] + four[16:]
    out ^= out >> np.uint64(29)
    return out * _BASE


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): runs of 50-byte strings with one anchor, by the places where the strings start.

    Only strings inside one of the documents [starts, ends) count.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(edge[:n], dtype=np.int8) > 0
    hashes, firsts, lasts = [], [], []
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        at = np.flatnonzero(inside[lo:hi])
        if not len(at):
            continue
        g = _gram_hashes(data[lo : hi + LENGTH - 1])
        key = (g & ~_MASK) | np.arange(len(g), dtype=np.uint64)
        m = key
        for k in range(4):
            m = np.minimum(m[: -(1 << k)], m[1 << k :])
        m = np.minimum(m[: hi - lo], m[15 : 15 + hi - lo])
        p = (m[at] & _MASK).astype(np.int64)
        # a run ends where the anchor changes (documents never share one: an anchor lies inside its string)
        new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        hashes.append(g[p[new]])
        firsts.append(at[new] + lo)
        lasts.append(at[np.r_[new[1:], len(at)] - 1] + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _deal(j: np.ndarray, c: np.ndarray, pend: list[list[np.ndarray]]) -> None:
    """Append the places ``j`` to the buckets of their symbols ``c``, in order."""
    if not len(j):
        return
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    cut = np.flatnonzero(c[1:] != c[:-1]) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(c)]):
        pend[c[a]].append(j[a:b])


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _places(n: int) -> type:
    """The type that places in a string of ``n`` symbols fit in."""
    return np.int32 if n < 2**31 - 2 else np.int64


def _induce(t: np.ndarray, symbols: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the sorted leftmost smaller suffixes ``lms`` induce: larger suffixes left to right, then smaller ones right to left.

    A bucket is handled at once; suffixes that its own members induce into it come in waves, one for each step of a run of equal symbols.
    """
    size = int(symbols[-1]) + 1
    by = np.searchsorted(t[lms], np.arange(size + 1))
    pend: list[list[np.ndarray]] = [[] for _ in range(size)]
    pend[t[-1]].append(np.array([len(t) - 1], lms.dtype))
    larger: dict[int, np.ndarray] = {}
    for c in symbols.tolist():
        seq = pend[c]
        cur = _join(seq)
        while len(cur):
            j = cur[cur > 0] - 1
            cur = j[t[j] == c]
            if len(cur):
                seq = [*seq, cur]
        larger[c] = own = _join(seq)
        both = np.concatenate([own, lms[by[c] : by[c + 1]]])
        j = both[both > 0] - 1
        up = t[j] > c
        _deal(j[up], t[j[up]], pend)
    pend = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in symbols[::-1].tolist():
        seq = pend[c]
        cur = _join(seq)
        while len(cur):
            j = cur[cur > 0] - 1
            cur = j[t[j] == c]
            if len(cur):
                seq = [*seq, cur]
        own = _join(seq)
        both = np.concatenate([own, larger[c][::-1]])
        j = both[both > 0] - 1
        down = t[j] < c
        _deal(j[down], t[j[down]], pend)
        out.append(own)
        out.append(larger[c][::-1])
    return np.concatenate(out)[::-1]


def _settled(first: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """``places`` in the order of their ``first`` keys, ties by the rank of the place after them.

    A tie is refined by what is known of the next place, again and again, so a run of places that wait for one another is settled step
    by step from its end.
    """
    rank = np.full(n + 1, -1, places.dtype)
    by = np.argsort(first, kind="stable")
    order, key = places[by], first[by]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(order)])
    rank[order] = np.repeat(head, size)
    live = np.flatnonzero(np.repeat(size > 1, size))
    while len(live):
        at = order[live]
        key = rank[at] * np.int64(n + 2) + rank[np.minimum(at + 1, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[live] = at
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(live)])
        rank[at] = np.repeat(live[head], size)
        live = live[np.repeat(size > 1, size)]
    return order


def _induce_at_once(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """:func:`_induce` for strings of many symbols, where a walk over all buckets would be too long.

    The larger suffixes follow from their symbol and the place of the next suffix, back from the sorted leftmost smaller ones; the
    smaller suffixes likewise from the larger ones.  In a bucket the larger stand before the smaller.
    """
    n = len(t)
    top = np.int64(n + 2)
    sort_of = 2 * t.astype(np.int64)
    known = np.zeros(n, np.int64)
    known[lms] = np.arange(1, len(lms) + 1)
    larger = np.flatnonzero(~smaller).astype(lms.dtype)
    places = np.concatenate([larger, lms])
    first = np.concatenate([sort_of[larger] * top, (sort_of[lms] + 1) * top + known[lms]])
    order = _settled(first, places, n)
    order = order[~smaller[order]]
    known[:] = 0
    known[order] = np.arange(1, len(order) + 1)
    rest = np.flatnonzero(smaller).astype(lms.dtype)
    places = np.concatenate([order, rest])
    first = np.concatenate([sort_of[order] * top + known[order], (sort_of[rest] + 1) * top])
    return _settled(first, places, n)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of symbols (the end counts as smaller than any symbol), by induced sorting."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=_places(n))
    symbols = np.unique(t)
    # a suffix is smaller than the next where the next different symbol is larger
    kind = _places(n)
    up = np.r_[t[1:] > t[:-1], False]
    apart = np.r_[t[1:] != t[:-1], True]
    smaller = up[np.minimum.accumulate(np.where(apart, np.arange(n, dtype=kind), kind(n))[::-1])[::-1]]
    # the same induction in two forms: bucket by bucket, or all places of a type at once where there are many buckets
    induce = (lambda at: _induce(t, symbols, at)) if len(symbols) <= 1024 else (lambda at: _induce_at_once(t, smaller, at))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(kind) + kind(1)
    if len(lms) > 1:
        first = induce(lms[np.argsort(t[lms], kind="stable")])
        mark = np.full(n, -1, kind)
        mark[lms] = np.arange(len(lms), dtype=kind)
        order = mark[first]
        order = order[order >= 0]
        # names: adjacent substrings (up to and with the next leftmost smaller place) are compared symbol by symbol
        size = np.r_[lms[1:] - lms[:-1] + 1, n - lms[-1] + 1]
        a, b = order[:-1], order[1:]
        same = size[a] == size[b]
        last = len(lms) - 1
        same &= (a != last) & (b != last)
        live, d = np.flatnonzero(same), 0
        while len(live):
            live = live[size[a[live]] > d]
            diff = t[lms[a[live]] + d] != t[lms[b[live]] + d]
            same[live[diff]] = False
            live = live[~diff]
            d += 1
        name = np.empty(len(lms), kind)
        name[order] = np.r_[0, np.cumsum(~same)]
        lms = lms[order] if name.max() == len(lms) - 1 else lms[suffix_array(name)]
    return induce(lms)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int, begin: np.ndarray) -> np.ndarray:
    """For every place its common prefix with the suffix before it in ``sa``, as far as ``most`` symbols matter.

    At an irreducible place (the symbols before both differ) the symbols are compared; each later place up to the next one has one less.
    A comparison ends after ``most`` symbols, so it starts again at every place of ``begin``: a value that was cut off there is carried
    no further than to the next such place.
    """
    n = len(t)
    phi = np.full(n, -1, sa.dtype)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n, dtype=sa.dtype)
    irreducible = (i == 0) | (phi <= 0) | (np.roll(phi, 1) < 0)
    at = i[~irreducible]
    irreducible[at] = t[at - 1] != t[phi[at] - 1]
    irreducible[begin] = True
    # eight symbols are compared at once, as one word with the first symbol lowest; beyond the end both sides differ in length
    word = np.concatenate([t, np.zeros(most + 15, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        word = word[:-k] | word[k:] << np.uint64(8 * k)
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(irreducible & (phi >= 0))
    other = phi[live]
    for d in range(0, most, 8):
        apart = word[live + d] ^ word[other + d]
        here = apart != 0
        low = apart[here]
        low &= ~low + np.uint64(1)
        common[live[here]] = d + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live, other = live[~here], other[~here]
        if not len(live):
            break
    common[live] = most
    np.minimum(common, np.minimum(most, n - np.maximum(i, phi)), out=common)
    lead = np.maximum.accumulate(np.where(irreducible, i, 0))
    return np.where(irreducible, common, np.maximum(common[lead] - (i - lead), 0))


def repeated_strings(snippets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal 50-byte strings in the rows of ``snippets``: (group of each string, its row * SPAN + place), in suffix order."""
    m = len(sizes)
    rows = np.full((m, WIDEST + 1), PAD, np.uint8)
    rows[:, :WIDEST] = snippets
    keep = np.arange(WIDEST + 1)[None, :] <= sizes[:, None]
    t = rows[keep]
    begin = np.r_[0, np.cumsum(sizes + 1)]
    sa = suffix_array(t)
    common = permuted_prefixes(t, sa, WIDEST + 1, begin[:-1])[sa]
    row = np.repeat(np.arange(m), sizes + 1)[sa]
    place = sa - begin[row]
    # strings that agree in 50 bytes are neighbours; a shorter common prefix anywhere between parts them
    group = np.cumsum(common < LENGTH)
    whole = place + LENGTH <= sizes[row]
    return group[whole], row[whole] * SPAN + place[whole]


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every snippet."""
    mixed = np.zeros(len(rows), np.uint64)
    words = rows.view(np.uint64)
    for k, w in enumerate(_WORDS):
        mixed = (mixed ^ (words[:, k] * w)) * _BASE
        mixed ^= mixed >> np.uint64(31)
    return mixed


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, number of each row among them): by hash, verified, and by content if two contents share a hash."""
    _, place, back = np.unique(_row_hashes(rows), return_index=True, return_inverse=True)
    if np.array_equal(rows[place][back], rows):
        return rows[place], back
    exact, back = np.unique(rows.view(f"V{WIDEST}").ravel(), return_inverse=True)
    return exact.view(np.uint8).reshape(-1, WIDEST), back


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's answer to each block: which of its hashes another block holds too, or the block itself twice."""
    parts = [np.frombuffer(x, np.uint8).reshape(-1, 7) for x in pdf.hashes]
    flat = np.zeros((sum(map(len, parts)), 8), np.uint8)
    flat[:, :6] = np.concatenate([p[:, :6] for p in parts])
    key = flat.view("<u8").ravel()
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = (count[inverse] > 1) | np.concatenate([p[:, 6] > 0 for p in parts])
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"block": pdf.block, "shard": pdf.shard, "mask": [np.packbits(x).tobytes() for x in np.split(twice, ends[:-1])]})


def _judged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's verdict on each block's snippets: a bit for every string that a smaller document holds."""
    zip_ = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(zip_.decompress(x), np.uint8).reshape(-1, WIDEST) for x in pdf.snippets]
    sizes = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf.sizes]).astype(np.int64)
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in pdf.docs])
    rows = np.concatenate(parts)
    distinct, back = _distinct(rows)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, back, docs)
    size = np.zeros(len(distinct), np.int64)
    size[back] = sizes
    group, cell = repeated_strings(distinct, size)
    first = np.full(len(distinct) * SPAN, np.iinfo(np.int64).max)
    if len(group):
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        low = np.minimum.reduceat(least[cell // SPAN], cut)
        first[cell] = np.repeat(low, np.diff(np.r_[cut, len(group)]))
    taken = np.zeros((len(rows), 32), bool)
    taken[:, :SPAN] = first.reshape(-1, SPAN)[back] < docs[:, None]
    bits = np.packbits(taken, axis=1, bitorder="little").view("<u4").ravel()
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"block": pdf.block, "shard": pdf.shard, "bits": [x.tobytes() for x in np.split(bits, ends[:-1])]})


class _Block:
    """A block's bytes, documents, and anchors by shard."""

    def __init__(self, z: bytes, ids: list, sizes: list, shards: int):
        self.ids = ids
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
        size = np.array(sizes, np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        named = np.array([x is not None for x in ids], bool)
        h, self.first, self.last = anchors(self.data, self.starts[named], self.ends[named])
        # the hashes of each shard, each once, in order; where each anchor's hash is
        self.hash, self.where = np.unique(h, return_inverse=True)
        self.twice = np.bincount(self.where, minlength=len(self.hash)) > 1
        self.shard = (self.hash % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(self.shard.astype(np.uint16) if shards <= 1 << 16 else self.shard, kind="stable")

    def by_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places in ``hash``)."""
        s = self.shard[self.order]
        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.r_[cut[1:], len(s)]):
            yield int(s[a]), self.order[a:b]

    def snippets(self, masks: dict[int, bytes]):
        """(rows, sizes, smallest document, shard, own row of each shared anchor, these anchors): the distinct snippets of shared anchors."""
        shared = np.zeros(len(self.hash), bool)
        for shard, at in self.by_shard():
            if shard in masks:
                shared[at] = np.unpackbits(np.frombuffer(masks[shard], np.uint8), count=len(at)).astype(bool)
        pick = np.flatnonzero(shared[self.where]) if len(self.where) else np.zeros(0, np.int64)
        first, size = self.first[pick], self.last[pick] - self.first[pick] + LENGTH
        room = np.concatenate([self.data, np.full(WIDEST, PAD, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(room, WIDEST)[first]
        rows[np.arange(WIDEST)[None, :] >= size[:, None]] = PAD
        _, own = _distinct(rows)
        place = np.zeros(int(own.max()) + 1 if len(own) else 0, np.int64)
        place[own] = np.arange(len(own))
        # documents are looked up by the string's first byte (empty ones share their start with the next)
        ids = np.array([np.iinfo(np.int64).max if x is None else x for x in self.ids], np.int64)
        doc = ids[np.searchsorted(self.ends, first, side="right")] if len(pick) else np.zeros(0, np.int64)
        least = np.full(len(place), np.iinfo(np.int64).max)
        np.minimum.at(least, own, doc)
        shard = self.shard[self.where[pick[place]]] if len(pick) else np.zeros(0, np.int64)
        return rows[place], size[place], least, shard, own, pick, doc


def _blocks_of(block_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids: list = []
        texts: list[bytes] = []
        total = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"block": [(part << 32) + seq], "ids": [ids], "sizes": [[len(x) for x in texts]], "z": [zip_.compress(b"".join(texts))]},
                pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("z", pa.binary())]),
            )

        for batch in batches:
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(k)
                texts.append((t.as_py() or "").encode())
                total += len(texts[-1])
                if total >= block_bytes:
                    yield out()
                    ids, texts, total, seq = [], [], 0, seq + 1
        if ids:
            yield out()

    return pack


def remove_repeats(docs: DataFrame, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row of ``docs``."""
    spark = docs.sparkSession
    n = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "suffix-blocks")
    schema = "block long, ids array<long>, sizes array<int>, z binary"
    docs.select("doc_id", "text").mapInArrow(_blocks_of(block_bytes), schema).write.option("compression", "none").parquet(path)
    blocks = spark.read.schema(schema).parquet(path)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block(r["z"], r["ids"], r["sizes"], n)
                shard, blob = [], []
                for s, at in b.by_shard():
                    rows = np.zeros((len(at), 7), np.uint8)
                    rows[:, :6] = b.hash[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
                    rows[:, 6] = b.twice[at]
                    shard.append(s)
                    blob.append(rows.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(shard), pa.int64()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], names=["block", "shard", "hashes"])

    masks = blocks.mapInArrow(hashes, "block long, shard int, hashes binary").groupBy("shard").applyInPandas(_shared, "block long, shard int, mask binary")
    masks = written(masks.groupBy("block").agg(F.collect_list(F.struct("shard", "mask")).alias("masks")), "suffix-masks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block(r["z"], r["ids"], r["sizes"], n)
                rows, size, least, shard, own, pick, doc = b.snippets({m["shard"]: m["mask"] for m in r["masks"]})
                order = np.argsort(shard, kind="stable")
                of = np.empty(len(order), np.int64)
                of[order] = np.arange(len(order))
                s = shard[order]
                cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
                out: dict[str, list] = {"block": [], "shard": [], "docs": [], "sizes": [], "snippets": []}
                for lo, hi in zip(cut, np.r_[cut[1:], len(s)]):
                    at = order[lo:hi]
                    for k, v in zip(out, (r["block"], int(s[lo]), least[at].tobytes(), size[at].astype(np.uint8).tobytes(), zip_.compress(rows[at].tobytes()))):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("docs", pa.binary()), ("sizes", pa.binary()), ("snippets", pa.binary())]))

    sent = blocks.join(masks, "block").select("block", "ids", "sizes", "z", "masks").mapInArrow(send, "block long, shard int, docs binary, sizes binary, snippets binary")
    verdicts = sent.groupBy("shard").applyInPandas(_judged, "block long, shard int, bits binary")
    verdicts = written(verdicts.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("verdicts")), "suffix-verdicts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block(r["z"], r["ids"], r["sizes"], n)
                gone = np.zeros(len(b.data) + 1, np.int32)
                if r["verdicts"]:
                    rows, size, least, shard, own, pick, doc = b.snippets({m["shard"]: m["mask"] for m in r["masks"]})
                    bits = np.zeros(len(shard), np.uint32)
                    order = np.argsort(shard, kind="stable")
                    got = {v["shard"]: v["bits"] for v in r["verdicts"]}
                    bits[order] = np.concatenate([np.frombuffer(got[k], np.uint32) for k in sorted(got)])
                    mine = bits[own]
                    # beside the block's smallest holder every other one loses the whole snippet
                    mine[doc > least[own]] = np.uint32(0x7FFFFFFF)
                    first, strings = b.first[pick], b.last[pick] - b.first[pick] + 1
                    # most snippets lose all their strings, which is one run; the others go string by string
                    every = (np.uint32(1) << strings.astype(np.uint32)) - np.uint32(1)
                    whole = mine & every == every
                    np.add.at(gone, first[whole], 1)
                    np.add.at(gone, first[whole] + strings[whole] - 1 + LENGTH, -1)
                    some = ~whole & (mine & every > 0)
                    first, strings, mine = first[some], strings[some], mine[some]
                    for k in range(SPAN):
                        at = first[(strings > k) & (mine >> np.uint32(k) & np.uint32(1) > 0)] + k
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + LENGTH, -1)
                covered = np.cumsum(gone[:-1]) > 0
                text = b.data
                cols: dict[str, list] = {"doc_id": b.ids, "kept": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
                for lo, hi in zip(b.starts, b.ends):
                    c = covered[lo:hi]
                    kept = text[lo:hi][~c].tobytes()
                    cols["kept"].append(kept)
                    cols["n_bytes"].append(int(hi - lo))
                    cols["n_removed"].append(int(hi - lo) - len(kept))
                    cols["n_spans"].append(int(np.count_nonzero(c[1:] & ~c[:-1]) + (c[0] if len(c) else 0)))
                    cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_pydict(cols, pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    both = masks.join(verdicts, "block", "left")
    return blocks.join(both, "block", "left").select("block", "ids", "sizes", "z", "masks", "verdicts").mapInArrow(remove, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
