"""SentencePiece encoding and decoding as a max-plus parallel scan.

The model in use is a byte-fallback BPE.  Its encoding of a text is the one
sequence of pieces in which every piece encodes as itself and every adjacent
pair encodes as that pair, so encoding is a path through a lattice: an edge
weighs 0 where a pair fits and minus infinity where it doesn't, and the best
path in the max-plus sense is the only one that is finite.  Every prefix of a
string has one finite path, so the lattice keeps one piece for each place.

A text from ``CHUNK`` characters is cut into chunks.  The state at a boundary is
the piece that covers the character before it (characters before, characters
beyond).  Every chunk yields a transfer matrix, kept sparse: which state at its
start reaches which state at its end.  The max-plus product is associative, so
the matrices of neighbouring chunks are combined in pairs, then pairs of pairs,
up to the whole text; on the way down each product's two states fix the state
between its halves.  Every chunk is then traced back by itself.

No piece joins a blank to what stands before it, so the path restarts at every
word.  The distinct words of a batch go through the lattice together, in numpy;
words met lately are remembered in a bounded table.

Edge cases: null and empty texts have no pieces and decode to an empty text; a
character that no piece knows becomes its UTF-8 bytes; U+2581 in a text reads as
a blank, as in the model itself (the one case that doesn't round-trip);
repeated rows and null ids each keep their row; extra columns are not read; an
empty table gives an empty result.  One text's ids are one row, so they must
fit in one task.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a text is cut into chunks.
CHUNK = 1 << 14
#: Words that a worker remembers.
CACHE = 400_000
#: Texts that go through the kernel together.
BATCH = 512
#: The model file is broadcast; larger ones are refused.
MAX_MODEL_BYTES = 16 << 20
BLANK = "\u2581"


def load_model(path: str = MODEL) -> dict:
    """What the kernel needs from a model file: pieces with scores, and ids of bytes."""
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, [0] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[p] = (i, sp.get_score(i))
    return {"pieces": pieces, "bytes": byte_ids, "key": hashlib.sha256(sp.serialized_model_proto()).hexdigest()}


State = tuple[int, int]  # characters before the boundary, characters beyond it; (0, 0): a text's start
Matrix = dict[State, dict[State, float]]


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices (an entry that's missing is minus infinity)."""
    out: Matrix = {}
    for i, row in a.items():
        best: dict[State, float] = {}
        for j, x in row.items():
            for k, y in b.get(j, {}).items():
                if x + y > best.get(k, float("-inf")):
                    best[k] = x + y
        if best:
            out[i] = best
    return out


class Table:
    """Whole numbers by key, looked up for many keys at once (open addressing)."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, (6 * len(keys)).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys, self.values = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            placed = free[self.keys[at[free]] == keys[free]]
            self.values[at[placed]] = values[placed]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) % self.size

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't there."""
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) % self.size
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Numbers(dict):
    """Numbers words as they come up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[k], begin[k] + 1 ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Coder:
    """The lattice kernel over one model."""

    def __init__(self, model: dict):
        self.pieces, self.byte_ids = model["pieces"], model["bytes"]
        self.longest = max(map(len, self.pieces))
        alphabet = sorted({c for p in self.pieces for c in p})
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece holds a blank after another character; words can't be cut")
        self.cut = "" if "\n" in alphabet else "\n"
        self._fits: dict[tuple[str, str], bool] = {}
        #: a piece that encodes as itself -> the two parts of its last merge
        self._parts: dict[str, tuple[str, str] | None] = {}
        own = [*alphabet, *sorted((p for p in self.pieces if len(p) > 1 and self.whole(p)), key=len)]
        self._number(own, alphabet)
        self._forget()
        spelt = {i: p.encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        n = 1 + max(spelt)
        self._spelt = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(n)), np.uint8)
        self._spelt_size = np.array([len(spelt.get(i, b"")) for i in range(n)], np.int64)
        self._spelt_begin = np.cumsum(self._spelt_size) - self._spelt_size

    def _number(self, own: list[str], alphabet: list[str]) -> None:
        """Tables over numbered pieces: characters first, then longer pieces; the last number is any unknown character."""
        number = {p: k for k, p in enumerate(own)}
        self.unknown = len(own)
        self._count = len(own) + 1
        order = {p: k for k, (p, _) in enumerate(sorted(self.pieces.items(), key=lambda x: -x[1][1]))}
        # pieces that share a score (runs of blanks do) have no one order; pairs with them are merged by definition
        often = Counter(x for p, (_, x) in self.pieces.items() if len(p) > 1)
        self._tied = np.array([*(len(p) > 1 and often[self.pieces[p][1]] > 1 for p in own), False])
        self._own = own
        self._length = np.array([*map(len, own), 1], np.int64)
        self._id = np.array([*(self.pieces[p][0] if p in self.pieces else -1 for p in own), -1], np.int32)
        # a merge tree's spines: when a piece was merged (-1: a character), and of what
        self._rank = np.array([*(order[p] if len(p) > 1 else -1 for p in own), -1], np.int64)
        sides = [self._parts[p] if len(p) > 1 else (p, p) for p in own]
        self._left = np.array([*(number[a] for a, _ in sides), self.unknown], np.int64)
        self._right = np.array([*(number[b] for _, b in sides), self.unknown], np.int64)
        if (~self._tied & (self._rank >= 0) & (np.maximum(self._rank[self._left], self._rank[self._right]) >= self._rank)).any():
            raise ValueError("a piece outranks its own parts; merges can't be told by rank")
        joins = [(number[p[:k]] * self._count + number[p[k:]], order[p]) for p in self.pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self._joins = Table(*np.array(joins, np.int64).reshape(-1, 2).T)
        # character codes, and the trie of the pieces' beginnings: (node, code) -> node; the piece that ends at a node
        self._code = np.full(0x110000, -1, np.int32)
        self._code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        nodes = dict(number)
        for p in own:
            for k in range(1, len(p)):
                nodes.setdefault(p[:k], len(nodes))
        self._width = len(alphabet)
        steps = [(nodes[p[:-1]] * self._width + number[p[-1]], k) for p, k in nodes.items() if len(p) > 1]
        self._trie = Table(*np.array(steps, np.int64).reshape(-1, 2).T)
        #: nodes from this number on are beginnings only
        self._n_pieces = len(own)

    def _forget(self) -> None:
        self._known = Numbers()
        self._word_ids, self._word_begin, self._word_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(self, s: str) -> list[str]:
        """BPE by definition: merge the best pair, the leftmost among equals, until none is a piece.  For short strings."""
        parts, pieces = list(s), self.pieces
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                got = pieces.get(parts[k] + parts[k + 1])
                if got and (best is None or got[1] > best):
                    best, at = got[1], k
            if at < 0:
                return parts
            if len(parts) == 2:
                self._parts[s] = parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, p: str) -> bool:
        """Is ``p`` a piece that encodes as itself?"""
        if len(p) == 1:
            return True
        if p not in self.pieces:
            return False
        if p not in self._parts and self.merged(p) != [p]:
            self._parts[p] = None
        return self._parts[p] is not None

    def fits(self, a: str, b: str) -> bool:
        """Does ``a`` before ``b`` encode as these two?"""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            got = self._fits[a, b] = self.merged(a + b) == [a, b]
        return got

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many numbered pairs.

        Time runs backwards along ``a``'s right spine and ``b``'s left spine: whichever side was merged last is taken apart, and two
        parts that touch must not be a piece that would have been merged before that.  Of equal merges the one further left comes first.
        """
        ok = np.ones(len(a), bool)
        tied = self._tied[a] | self._tied[b]
        for k in np.flatnonzero(tied).tolist():
            ok[k] = self.unknown in (a[k], b[k]) or self.fits(self._own[a[k]], self._own[b[k]])
        live = np.flatnonzero(~tied)
        a, b, limit = a[live], b[live], np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            joined = self._joins.get(a * self._count + b)
            clash = (joined >= 0) & (joined < limit)
            ok[live[clash]] = False
            ra, rb = self._rank[a], self._rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            last = ra > rb
            limit = np.where(last, ra, rb + 1)
            a, b = np.where(last, self._right[a], a), np.where(last, b, self._left[b])
        return ok

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one row, number of ids of each word); no piece leaves or enters a word.

        Forward: place by place, a piece is kept at its last character if it fits the piece kept before its first.  Back: from every
        word's end.
        """
        text = "".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = len(text)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        code = self._code[points].astype(np.int64)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(words)), size)
        offset = np.arange(n) - begin[owner]
        rest = size[owner] - offset
        # edges: (first character, last character, piece)
        piece = np.where(code >= 0, code, self.unknown)
        edges = [(np.arange(n), np.arange(n), piece)]
        at = np.flatnonzero((code >= 0) & (rest > 1))
        node = code[at]
        for k in range(1, self.longest):
            node = self._trie.get(np.where(code[at + k] >= 0, node * self._width + code[at + k], -2))
            ok = node >= 0
            at, node = at[ok], node[ok].astype(np.int64)
            here = node < self._n_pieces
            edges.append((at[here], at[here] + k, node[here]))
            ok = rest[at] > k + 1
            at, node = at[ok], node[ok]
            if not len(at):
                break
        first, last, piece = (np.concatenate(x) for x in zip(*edges))
        order = np.argsort(offset[first].astype(np.uint16) if size.max() < 1 << 16 else offset[first], kind="stable")
        first, last, piece = first[order], last[order], piece[order]
        bounds = np.searchsorted(offset[first], np.arange(int(size.max()) + 1))
        kept = np.full(n, -1, np.int64)
        kept[last[: bounds[1]]] = piece[: bounds[1]]
        for lo, hi in zip(bounds[1:-1].tolist(), bounds[2:].tolist()):
            p = piece[lo:hi]
            ok = self.fit(kept[first[lo:hi] - 1], p)
            kept[last[lo:hi][ok]] = p[ok]
        if (kept < 0).any():
            raise AssertionError("a place that no path reaches")
        on_path = np.zeros(n, bool)
        cur = (begin + size - 1)[size > 0]
        while len(cur):
            on_path[cur] = True
            cur = cur[offset[cur] >= self._length[kept[cur]]]
            cur = cur - self._length[kept[cur]]
        ends = np.flatnonzero(on_path)
        ids = self._id[kept[ends]]
        count = np.ones(len(ends), np.int64)
        odd = ids < 0
        if odd.any():
            c = points[ends[odd]]
            count[odd] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            raw = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids = np.repeat(ids, count)
            ids[np.repeat(odd, count)] = np.array(self.byte_ids, np.int32)[raw]
        return ids, np.bincount(owner[ends], weights=count, minlength=len(words)).astype(np.int64)

    def split(self, s: str) -> list[str]:
        """The words of a prepared text (and empty strings): no piece crosses from one to the next."""
        s = s.replace(BLANK, " " + BLANK)
        gap, run = f"{BLANK} {BLANK}", BLANK + BLANK
        while gap in s:
            s = s.replace(gap, run)
        if self.cut:
            s = s.replace(self.cut, f" {self.cut} ")
        return s.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one row, number of ids of each); texts are prepared, or parts of such between words."""
        if len(self._known) > CACHE:
            self._forget()
        had, number = len(self._known), self._known.__getitem__
        flat: list[int] = []
        ends = []
        for t in texts:
            flat += map(number, self.split(t))
            ends.append(len(flat))
        if len(self._known) > had:
            ids, size = self.lattice(list(islice(self._known, had, None)))
            self._word_begin = np.concatenate([self._word_begin, len(self._word_ids) + np.cumsum(size) - size])
            self._word_ids, self._word_size = np.concatenate([self._word_ids, ids]), np.concatenate([self._word_size, size])
        words = np.array(flat, np.int64)
        size = self._word_size[words]
        upto = np.r_[0, np.cumsum(size)][np.array([0, *ends], np.int64)]
        return self._word_ids[spread(self._word_begin[words], size)], np.diff(upto)

    def spell(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """What runs of ids spell, a text's own first blank included."""
        size = self._spelt_size[ids]
        raw = self._spelt[spread(self._spelt_begin[ids], size)].tobytes()
        upto = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[a:b].decode("utf-8", "replace").replace(BLANK, " ") for a, b in zip(upto, upto[1:])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts that runs of ids spell."""
        return [s.removeprefix(" ") for s in self.spell(ids, counts)]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            got = self.pieces.get(p)
            if got:
                out.append(got[0])
            else:
                out.extend(self.byte_ids[b] for b in p.encode())
        return out

    def forward(self, s: str, init: dict[int, dict[int, int]], lo: int, hi: int) -> list[dict[int, int]]:
        """nodes[i]: start of a piece that ends at i -> the set (as bits) of initial states from which it's reached.

        ``init`` holds the initial nodes (start -1: nothing before).  Pieces start in [lo, hi) and may end beyond ``hi``.
        """
        nodes: list[dict[int, int]] = [{} for _ in range(len(s) + 1)]
        for i, of in init.items():
            nodes[i].update(of)
        for j in range(lo, hi):
            prev = nodes[j]
            if not prev:
                continue
            for n in range(1, min(self.longest, len(s) - j) + 1):
                p = s[j : j + n]
                if not self.whole(p):
                    continue
                bits = 0
                for start, mask in prev.items():
                    if start < 0 or self.fits(s[start:j], p):
                        bits |= mask
                if bits:
                    nodes[j + n][j] = nodes[j + n].get(j, 0) | bits
        return nodes

    def back(self, s: str, nodes: list[dict[int, int]], end: int, start: int, lo: int) -> list[str]:
        """The pieces of the path that ends with s[start:end], back to ``lo``."""
        out = []
        while start >= lo:
            out.append(s[start:end])
            before = [x for x in nodes[start] if x < 0 or self.fits(s[x:start], s[start:end])]
            if len(before) != 1:
                raise AssertionError(f"{len(before)} paths end before character {start}")
            start, end = before[0], start
        return out[::-1]

    def breaks(self, s: str, lo: int, hi: int) -> tuple[int, int]:
        """The first and the last place in [lo, hi] that no piece crosses; (-1, -1) without one."""

        def free(k: int) -> bool:
            return 0 < k < len(s) and ((s[k] == BLANK and s[k - 1] != BLANK) or (bool(self.cut) and self.cut in s[k - 1 : k + 1]))

        first = next((k for k in range(lo, hi + 1) if free(k)), -1)
        return (first, next(k for k in range(hi, lo - 1, -1) if free(k))) if first >= 0 else (-1, -1)

    def states_in(self, s: str, lo: int) -> list[State]:
        """States possible at boundary ``lo``: pieces that cover the character before it."""
        if lo == 0:
            return [(0, 0)]
        return [(lo - a, b - lo) for a in range(max(0, lo - self.longest), lo) for b in range(lo, min(len(s), a + self.longest) + 1) if self.whole(s[a:b])]

    def _init(self, states: list[State], lo: int) -> dict[int, dict[int, int]]:
        init: dict[int, dict[int, int]] = {}
        for k, (x, o) in enumerate(states):
            init.setdefault(lo + o, {})[lo - x if x else -1] = 1 << k
        return init

    def transfer(self, s: str, lo: int, hi: int) -> Matrix:
        """The transfer matrix of s[lo:hi]; ``s`` also holds the characters around it."""
        states = self.states_in(s, lo)
        first, last = self.breaks(s, lo, hi)
        if first < 0:
            nodes = self.forward(s, self._init(states, lo), lo, hi)
            ends = [((hi - a, b - hi), bits) for b in range(hi, len(s) + 1) for a, bits in nodes[b].items() if lo <= a < hi]
            return {st: row for k, st in enumerate(states) if (row := {e: 0.0 for e, bits in ends if bits >> k & 1})}
        # the path restarts at a break: head states that reach the first, times states reached from the last
        if first > lo:
            nodes = self.forward(s[:first], self._init([x for x in states if lo + x[1] <= first], lo), lo, first)
            kept = [x for x in states if lo + x[1] <= first]
            bits = 0
            for x in nodes[first].values():
                bits |= x
            heads = [st for k, st in enumerate(kept) if bits >> k & 1]
        else:
            heads = [st for st in states if st[1] == 0]
        if last < hi:
            nodes = self.forward(s, {last: {-1: 1}}, last, hi)
            tails = {(hi - a, b - hi): 0.0 for b in range(hi, len(s) + 1) for a in nodes[b] if last <= a < hi}
        else:
            # a break at the boundary itself: any piece that ends here and is reached from the break before
            prior = self.breaks(s, lo, hi - 1)[1]
            if prior < 0:
                nodes = self.forward(s[:hi], self._init(states, lo), lo, hi)
                return {st: row for k, st in enumerate(states) if (row := {(hi - a, 0): 0.0 for a, bits in nodes[hi].items() if lo <= a and bits >> k & 1})}
            nodes = self.forward(s[:hi], {prior: {-1: 1}}, prior, hi)
            tails = {(hi - a, 0): 0.0 for a in nodes[hi] if a >= prior}
        return {h: dict(tails) for h in heads} if tails else {}

    def ends(self, s: str, lo: int, hi: int, begin: State, end: State) -> tuple[list[int], str, list[int]]:
        """The pieces that start in [lo, hi), given the states at both boundaries: ids before the first break, the string up to the last break, ids beyond it."""
        at = lo + begin[1]
        first, last = self.breaks(s, at, hi - end[0])
        if first < 0:
            nodes = self.forward(s, self._init([begin], lo), at, hi)
            return self.ids(self.back(s, nodes, hi + end[1], hi - end[0], at)), "", []
        head: list[int] = []
        if first > at:
            nodes = self.forward(s[:first], self._init([begin], lo), at, first)
            (start,) = [a for a in nodes[first] if a >= at]
            head = self.ids(self.back(s, nodes, first, start, at))
        nodes = self.forward(s, {last: {-1: 1}}, last, hi)
        return head, s[first:last], self.ids(self.back(s, nodes, hi + end[1], hi - end[0], last))

    def between(self, chunks: list[tuple[str, int, int, State, State]]) -> list[np.ndarray]:
        """Ids of the pieces that start in each chunk, given its string, its place in that and the states at both boundaries."""
        parts = [self.ends(*c) for c in chunks]
        inner, counts = self.encode([x[1] for x in parts])
        runs = np.split(inner, np.cumsum(counts)[:-1])
        return [np.concatenate([np.array(a, np.int32), b, np.array(c, np.int32)]) for (a, _, c), b in zip(parts, runs)]


def prepared(text: str | None) -> str:
    """A text as the lattice sees it: a blank in front, blanks as U+2581."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def scan(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """Both boundary states of every chunk of one text, from its chunks' matrices in order.

    Up: products of neighbours, level by level.  Down: the best state between a product's two factors, given the states at its ends.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([compose(*below[k : k + 2]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    ends = [s for s in levels[-1][0].get((0, 0), {}) if s[1] == 0]
    if len(ends) != 1:
        raise AssertionError(f"{len(ends)} paths through a text")
    states = [((0, 0), ends[0])]
    for below in reversed(levels[:-1]):
        halves = []
        for k, (a, b) in enumerate(states):
            if 2 * k + 1 == len(below):
                halves.append((a, b))
                continue
            left, right = below[2 * k], below[2 * k + 1]
            between = [(x + right[s][b], s) for s, x in left[a].items() if b in right.get(s, {})]
            if len(between) != 1:
                raise AssertionError(f"{len(between)} states between two chunks")
            halves += [(a, between[0][1]), (between[0][1], b)]
        states = halves
    return states


_BASE = 1 << 10


def _pack(m: Matrix) -> list[int]:
    return [x for (a, b), row in m.items() for c, d in row for x in (a * _BASE + b, c * _BASE + d)]


def _unpack(flat) -> Matrix:
    out: Matrix = {}
    for i, o in zip(flat[::2], flat[1::2]):
        out.setdefault(divmod(int(i), _BASE), {})[divmod(int(o), _BASE)] = 0.0
    return out


_CODERS: dict[str, Coder] = {}


def coder_of(model: dict) -> Coder:
    """The worker's coder of a model, kept from task to task."""
    if model["key"] not in _CODERS:
        _CODERS.clear()
        _CODERS[model["key"]] = Coder(model)
    return _CODERS[model["key"]]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """All rows of one key at a time, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(key)[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_CHUNKS = "uid long, doc_id long, k int, z binary, lo int, hi int"
_ENCODED = "doc_id long, ids array<int>, decoded string, round_trip boolean"


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``ids`` (array of int), ``decoded`` (the text that the ids spell) and ``round_trip`` (it is the row's text) of every row of ``docs``.

    Ids are decoded by the worker that has them, which spares a way of every text to and fro.  Only texts of more than one chunk are
    shuffled: once as compressed chunks, to meet their states, and once as ids.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_model(model))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")

    def one_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, counts = coder.encode([prepared(t) for t in texts])
                decoded = coder.decode(ids, counts)
                same = [a == b for a, b in zip(texts, decoded)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, counts), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "decoded", "round_trip"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, zip_ = coder_of(shared.value).longest, zstandard.ZstdCompressor(level=3)
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("z", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])
        for batch in batches:
            for uid, doc, text in zip(*(batch.column(c) for c in ("uid", "doc_id", "text"))):
                s = " " + text.as_py()
                n = -(-len(s) // chunk)
                edges = [len(s) * k // n for k in range(n + 1)]
                for g in range(0, n, 16):
                    rows = []
                    for k in range(g, min(n, g + 16)):
                        a, b = edges[k], edges[k + 1]
                        left, right = max(0, a - margin), min(len(s), b + margin)
                        rows.append({"uid": uid.as_py(), "doc_id": doc.as_py(), "k": k, "z": zip_.compress(s[left:right].encode()), "lo": a - left, "hi": b - left})
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict], list[str]]]:
        zip_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = part.to_pylist()
                yield part, rows, [zip_.decompress(r["z"]).decode() for r in rows]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for part, rows, texts in chunks_of(batches):
            flat = [_pack(coder.transfer(s.replace(" ", BLANK), r["lo"], r["hi"])) for r, s in zip(rows, texts)]
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("k"), pa.array(flat, pa.list_(pa.int32()))], names=["uid", "k", "m"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "uid"):
            io = [[a * _BASE + b, c * _BASE + d] for (a, b), (c, d) in scan([_unpack(m) for m in run.column("m").to_pylist()])]
            yield pa.RecordBatch.from_arrays([run.column("uid"), run.column("k"), pa.array(io, pa.list_(pa.int32()))], names=["uid", "k", "io"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, zip_ = coder_of(shared.value), zstandard.ZstdCompressor(level=3)
        for part, rows, texts in chunks_of(batches):
            for r in rows:
                r["begin"], r["end"] = (divmod(x, _BASE) for x in r["io"])
            own = coder.between([(s.replace(" ", BLANK), r["lo"], r["hi"], r["begin"], r["end"]) for r, s in zip(rows, texts)])
            counts = np.array([len(x) for x in own], np.int64)
            spelt = coder.spell(np.concatenate(own), counts)
            same = [got == s[r["lo"] + r["begin"][1] : r["hi"] + r["end"][1]] for got, s, r in zip(spelt, texts, rows)]
            z = [zip_.compress(x.astype("<i4").tobytes()) for x in own]
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), part.column("k"), pa.array(z, pa.binary()), pa.array(same, pa.bool_())], names=["uid", "doc_id", "k", "z", "same"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, zip_ = coder_of(shared.value), zstandard.ZstdDecompressor()
        for run in _runs(batches, "uid"):
            ids = np.concatenate([np.frombuffer(zip_.decompress(z), "<i4") for z in run.column("z").to_pylist()])
            counts = np.array([len(ids)])
            same = all(run.column("same").to_pylist())
            yield pa.RecordBatch.from_arrays([run.column("doc_id").slice(0, 1), _lists(ids, counts), pa.array(coder.decode(ids, counts), pa.string()), pa.array([same], pa.bool_())], names=["doc_id", "ids", "decoded", "round_trip"])

    one = docs.where(F.coalesce(F.length("text"), F.lit(0)) < chunk).mapInArrow(one_chunk, _ENCODED)
    # a row number keeps a text's chunks together; the written table fixes it
    path = new_path(spark, "chunks")
    docs.where(F.length("text") >= chunk).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut, _CHUNKS).write.option("compression", "none").parquet(path)
    chunks = spark.read.schema(_CHUNKS).parquet(path)
    found = chunks.select("uid", "k", "z", "lo", "hi").mapInArrow(matrices, "uid long, k int, m array<int>").repartition(parts, "uid").sortWithinPartitions("uid", "k").mapInArrow(states, "uid long, k int, io array<int>")
    traced = chunks.join(found, ["uid", "k"]).select("uid", "doc_id", "k", "z", "lo", "hi", "io").mapInArrow(trace, "uid long, doc_id long, k int, z binary, same boolean")
    return one.unionByName(traced.repartition(parts, "uid").sortWithinPartitions("uid", "k").mapInArrow(join, _ENCODED))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``decoded``, the text that the ids spell; null ids spell an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                ids = part.column("ids")
                out = coder.decode(ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(out, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded string")
