"""Byte-level BPE encoding and decoding, with pre-tokenisation by associative scans.

The pre-tokenisation pattern of the rank files is a small automaton. Every code point gets a class
from a table (letter, number, white space, other), which its next two neighbours refine (last space
of a run, apostrophe before a contraction). A class is a function from state to state; the
functions that arise by composing them are few, so a composition is a look-up in a table and the
states of all positions come from a blocked prefix scan over function numbers, without any regular
expression. The slices between the found starts are merged by rank with a cache of slices, which is
looked up for all slices of a group of texts at once, by keys of two words that hold a slice of up to
15 bytes whole; those that are not in the cache are merged side by side, one pair of each slice a round.

``encode`` keeps for every token its byte offset in the text; ``decode`` writes every token's bytes
to that offset. The rank file is read by the driver and broadcast (its size is checked).

Null texts are empty: no tokens. A text of any length is whole in one row. Repeated rows stay. Other
columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, id_type, prepare

RANKS = "byte_bpe_50k.tiktoken"
MAX_RANK_FILE = 64 << 20
GROUP_CHARS = 1 << 18
BLOCK = 256
CACHE = 1 << 20
#: Slices of a group that are looked up at once, the longest with a key of two words, the longest that are kept.
SLICES = 1 << 16
KEY_BYTES = 15
KEPT_BYTES = 64
HEAP_FROM = 80
WIDTHS = (8, 16, 32, HEAP_FROM)
MERGE_ROWS = 4096

# Classes of code points, and states of the automaton: what the token so far is.
RESET, LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, LAST, PREFIX = range(9)
ENDED, LETTERS, NUMBERS, OTHERS, SPACES, PREFIXED, ONE_MORE, TWO_MORE = range(8)


class PairTable:
    """The id of two neighbouring ids together, for arrays: open addressing with linear probing."""

    def __init__(self, pairs: dict[int, int], none: int):
        self.none = none
        packed = np.fromiter(pairs, np.int64, len(pairs))
        bits = max(4, 2 + len(pairs).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1), np.full(1 << bits, none, np.int32)
        values, slot = np.fromiter(pairs.values(), np.int32, len(pairs)), self.slots(packed)
        while len(packed):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = packed[put], values[put]
            left = np.ones(len(packed), bool)
            left[put] = False
            packed, values, slot = packed[left], values[left], (slot[left] + 1) & self.mask

    def slots(self, packed: np.ndarray) -> np.ndarray:
        x = packed.view(np.uint64)
        return (((x ^ (x >> np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        packed = a << 32 | b
        slot = self.slots(packed)
        held = self.keys[slot]
        out = np.where(held == packed, self.values[slot], self.none)
        left = np.flatnonzero((held != packed) & (held >= 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & self.mask
            held, wanted = self.keys[at], packed[left]
            own = held == wanted
            out[left[own]] = self.values[at[own]]
            left = left[~own & (held >= 0)]
        return out


_KEY_MASKS = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(KEY_BYTES + 1)], np.uint64).T.copy()


def keys(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each slice of data that begins at ``at``: its bytes, and in the last byte its size
    (KEY_BYTES at most). data goes on for 16 bytes or more behind every beginning."""
    words = np.ndarray((len(data) - 15,), "V16", data, 0, (1,))[at].view(np.uint64).reshape(-1, 2)
    return words[:, 0] & _KEY_MASKS[0][size], words[:, 1] & _KEY_MASKS[1][size] | size.astype(np.uint64) << np.uint64(56)


class Slices:
    """A cache of slices' ids. Slices with a key are looked up for arrays, by open addressing with
    linear probing; those with more bytes are in a dict."""

    def __init__(self) -> None:
        bits = int(1.5 * (CACHE // 2 + SLICES)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)  # high is 0 where free
        self.spans = np.zeros(1 << bits, np.uint32)  # place in ids << 4 | number of ids
        self.ids, self.used, self.n = np.empty(1 << 12, np.uint32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def __len__(self) -> int:
        return self.n + len(self.long)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        return (((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slices' spans; 0: absent."""
        slot = self.slots(low, high)
        held = self.high[slot]
        own = (held == high) & (self.low[slot] == low)
        out = np.where(own, self.spans[slot], np.uint32(0))
        left = np.flatnonzero(~own & (held != 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & self.mask
            held = self.high[at]
            own = (held == high[left]) & (self.low[at] == low[left])
            out[left[own]] = self.spans[at[own]]
            left = left[~own & (held != 0)]
        return out

    def append(self, ids: np.ndarray) -> int:
        """The place of ids, which are kept till ``used`` is set back."""
        begin, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            grown = np.empty(2 * self.used, np.uint32)
            grown[:begin] = self.ids[:begin]
            self.ids = grown
        self.ids[begin : self.used] = ids
        return begin

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds slices, each once and absent before, with their ids in a row; returns their spans."""
        spans = ((self.append(ids) + np.cumsum(counts) - counts) << 4 | counts).astype(np.uint32)
        self.n += len(low)
        slot, todo = self.slots(low, high), np.arange(len(low))
        while len(todo):
            free = todo[self.high[slot[todo]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            at = slot[put]
            self.low[at], self.high[at], self.spans[at] = low[put], high[put], spans[put]
            left = np.ones(len(low), bool)
            left[put] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
        return spans


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, counts of them."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _step(cls: int, state: int) -> tuple[int, bool]:
    """The next state, and if a token starts here."""
    if cls == RESET:
        return ENDED, False
    if cls == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return ENDED, False
        return LETTERS, state not in (LETTERS, PREFIXED)
    if cls == NUMBER:
        return NUMBERS, state not in (NUMBERS, PREFIXED)
    if cls == SPACE:
        return SPACES, state != SPACES
    if cls == LAST:
        return ENDED, True
    if cls == PREFIX:
        return PREFIXED, True
    if state in (OTHERS, PREFIXED):
        return OTHERS, False
    return {OTHER: OTHERS, SHORT: ONE_MORE, LONG: TWO_MORE}[cls], True


class Scanner:
    """Tables of the automaton: the monoid of its transition functions, and where tokens start."""

    def __init__(self) -> None:
        import regex

        gen = [tuple(_step(c, s)[0] for s in range(8)) for c in range(9)]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *gen]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in gen:
                if (h := tuple(g[x] for x in f)) not in known:
                    known[h] = len(known)
                    todo.append(h)
        names = list(known)
        self.of_class = np.array([known[g] for g in gen], np.uint8)
        self.compose = np.array([[known[tuple(g[x] for x in f)] for g in names] for f in names], np.uint8)
        self.apply = np.array(names, np.uint8)
        self.starts = np.array([[_step(c, s)[1] for s in range(8)] for c in range(9)])
        every, self.table = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), np.full(0x110000, OTHER, np.uint8)
        for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
                self.table[a:b] = cls

    def scan(self, fs: np.ndarray) -> np.ndarray:
        """Function numbers of all prefixes: blocks side by side, then the blocks' totals, then both."""
        n = len(fs)
        if n <= BLOCK:
            out = np.empty_like(fs)
            x = 0
            for i, f in enumerate(fs.tolist()):
                x = out[i] = self.compose[x, f]
            return out
        blocks = -(-n // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.uint8)
        padded[:n] = fs
        at = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        flat, width = self.compose.ravel(), np.intp(self.compose.shape[1])
        for j in range(1, BLOCK):
            at[j] = flat[at[j - 1] * width + at[j]]
        before = np.zeros(blocks, np.uint8)
        before[1:] = self.scan(at[-1])[:-1]
        return np.ascontiguousarray(flat[before * width + at].T).ravel()[:n]

    def classes(self, points: np.ndarray, resets: np.ndarray) -> np.ndarray:
        cls = self.table[points]
        cls[resets] = RESET
        after = np.append(cls[1:], RESET)
        last = (cls == SPACE) & (after != SPACE) & (after != RESET)
        quote = np.flatnonzero(points == ord("'"))
        cls[last] = np.where(points[last] == 32, PREFIX, LAST)
        if len(quote):
            ahead = np.append(points, [0, 0])
            a, b = ahead[quote + 1], ahead[quote + 2]
            cls[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
            two = [a == ord(x[0]) for x in ("re", "ve", "ll")], [b == ord(x[1]) for x in ("re", "ve", "ll")]
            cls[quote[np.logical_or.reduce([x & y for x, y in zip(*two)])]] = LONG
        return cls

    def boundaries(self, points: np.ndarray, resets: np.ndarray) -> np.ndarray:
        """Where tokens start, resets included: positions of texts' separators."""
        cls = self.classes(points, resets)
        states = np.zeros(len(cls), np.uint8)
        states[1:] = self.apply[self.scan(self.of_class[cls])[:-1], ENDED]
        start = self.starts[cls, states]
        start[resets] = True
        return np.flatnonzero(start)


class Codec:
    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.size = 1 + max(self.ranks.values())
        tokens: list[bytes] = [b""] * self.size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.packed = [r.to_bytes(4, "little") for r in range(self.size)]
        self.cache, self.older = Slices(), Slices()

    @cached_property
    def scanner(self) -> Scanner:
        return Scanner()

    @cached_property
    def single(self) -> list[int]:
        return [self.ranks[bytes([b])] for b in range(256)]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Two neighbours' ids in one number: the id of both together."""
        of = self.ranks.get
        return {a << 32 | b: r for t, r in self.ranks.items() for k in range(1, len(t)) if (a := of(t[:k])) is not None and (b := of(t[k:])) is not None}

    @cached_property
    def table(self) -> PairTable:
        return PairTable(self.pairs, self.size)

    @cached_property
    def of_bytes(self) -> np.ndarray:
        """The id of each two bytes."""
        out = np.full(1 << 16, self.size, np.int32)
        for t, r in self.ranks.items():
            if len(t) == 2:
                out[t[0] << 8 | t[1]] = r
        return out

    def merge_side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of slices that are no tokens, of at most HEAP_FROM bytes: in each round every slice
        merges its pair of lowest rank, leftmost first. Its ids are a linked list in a row of a matrix,
        which ends with ``none``."""
        n, none, sizes = len(pieces), self.size, np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max()) + 1
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, np.array(self.single)[raw], none).ravel()
        ranks = np.full((n, width), none, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.of_bytes[raw[:, :-1].astype(np.intp) << 8 | raw[:, 1:]], none)
        flat = ranks.ravel()
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        live = np.arange(n)
        while True:
            own = ranks[live]
            low = own.argmin(1)
            m = own[np.arange(len(live)), low].astype(np.int64)
            more = m < none
            live, m = live[more], m[more]
            if not len(live):
                break
            i = live * width + low[more]
            j, h = after[i], before[i]  # before a row's first: the end of the row above
            k = after[j]
            ids[i], ids[j], flat[j] = m, -1, none
            after[i], before[k] = k, i
            both = self.table.find(np.r_[m, ids[h]], np.r_[ids[k], m])
            flat[i], flat[h] = both[: len(i)], both[len(i) :]
        kept = (ids >= 0) & (ids < none)
        data = ids[kept].astype("<u4").tobytes()
        stop = (4 * np.cumsum(kept.reshape(n, width).sum(1))).tolist()
        return [data[a:b] for a, b in zip([0, *stop], stop)]

    def merge_all(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """merge() of each."""
        of, packed, out = self.ranks.get, self.packed, {}
        rest: list[list[bytes]] = [[] for _ in WIDTHS]
        for p in pieces:
            if (r := of(p)) is not None:
                out[p] = packed[r]
            elif len(p) > HEAP_FROM:
                out[p] = self.merge_long(p)
            else:
                rest[bisect.bisect_left(WIDTHS, len(p))].append(p)
        for some in rest:
            for a in range(0, len(some), MERGE_ROWS):
                part = some[a : a + MERGE_ROWS]
                out.update(zip(part, self.merge_side_by_side(part)))
        return out

    def merge(self, piece: bytes) -> bytes:
        """The ids of a slice: the pair of lowest rank, leftmost first, is merged until none is left."""
        if (r := self.ranks.get(piece)) is not None:
            return self.packed[r]
        if len(piece) > HEAP_FROM:
            return self.merge_long(piece)
        ids, pair, none = [self.single[b] for b in piece], self.pairs.get, self.size
        found = [pair(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (m := min(found)) != none:
            i = found.index(m)
            ids[i : i + 2] = (m,)
            del found[i]
            if i:
                found[i - 1] = pair(ids[i - 1] << 32 | m, none)
            if i < len(found):
                found[i] = pair(m << 32 | ids[i + 1], none)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge_long(self, piece: bytes) -> bytes:
        """The same in n log n steps, with a heap of pairs."""
        n, ranks = len(piece), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue
            k = after[j]
            after[i], end[i], end[j] = k, stop, 0
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.packed[ranks[piece[i : end[i]]]])
            i = after[i]
        return b"".join(out)

    def merge_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slices in a row, and how many each has."""
        of = self.merge_all(pieces)
        found = [of[p] for p in pieces]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2

    def spans_of_keys(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The spans in the cache of slices with keys; what it hasn't is taken from the older half or merged."""
        spans = self.cache.find(low, high)
        absent = np.flatnonzero(spans == 0)
        if not len(absent):
            return spans
        by_key = absent[np.lexsort((low[absent], high[absent]))]
        a, b = low[by_key], high[by_key]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b = a[first], b[first]
        old = self.older.find(a, b)
        own = np.zeros(len(a), np.uint32)
        if (again := old != 0).any():
            counts = (old[again] & 15).astype(np.int64)
            own[again] = self.cache.add(a[again], b[again], self.older.ids[spread(old[again] >> 4, counts)], counts)
        if (new := ~again).any():
            a, b = a[new], b[new]
            raw, size = np.column_stack([a, b]).tobytes(), (b >> np.uint64(56)).tolist()
            own[new] = self.cache.add(a, b, *self.merge_new([raw[i : i + n] for i, n in zip(range(0, len(raw), 16), size)]))
        spans[by_key] = own[np.cumsum(first) - 1]
        return spans

    def places_of_long(self, pieces: list[bytes]) -> dict[bytes, tuple[int, int]]:
        """The same for longer slices; those above KEPT_BYTES are not kept."""
        cache, older, wanted = self.cache, self.older, set(pieces)
        for p in wanted:
            if p not in cache.long and (held := older.long.get(p)) is not None:
                cache.long[p] = cache.append(older.ids[held[0] : held[0] + held[1]]), held[1]
        new = sorted((p for p in wanted if p not in cache.long), key=len)  # what isn't kept is last
        ids, counts = self.merge_new(new)
        begin = cache.append(ids) + np.cumsum(counts) - counts
        places = dict(zip(new, zip(begin.tolist(), counts.tolist())))
        cache.long.update((p, x) for p, x in places.items() if len(p) <= KEPT_BYTES)
        return {p: places.get(p) or cache.long[p] for p in wanted}

    def ids_of(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slices of data in a row, and how many each has."""
        if len(self.cache) > CACHE // 2:  # what is used again comes back from the older half
            self.cache, self.older = Slices(), self.cache
        long = np.flatnonzero(size > KEY_BYTES)
        if not len(long):
            spans = self.spans_of_keys(*keys(data, at, size))
            begin, counts = spans >> 4, (spans & 15).astype(np.int64)
            return self.cache.ids[spread(begin, counts)], counts
        short = np.flatnonzero(size <= KEY_BYTES)
        begin, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        spans = self.spans_of_keys(*keys(data, at[short], size[short]))
        begin[short], counts[short] = spans >> 4, spans & 15
        pieces = [data[i : i + n].tobytes() for i, n in zip(at[long].tolist(), size[long].tolist())]
        places = self.places_of_long(pieces)
        begin[long], counts[long] = np.array([places[p] for p in pieces]).T
        out = self.cache.ids[spread(begin, counts)]
        if (kept := [x for p, x in places.items() if len(p) > KEPT_BYTES]):
            self.cache.used = min(kept)[0]
        return out, counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin and the last one's end."""
        joined = "\0" + "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        resets = np.r_[0, np.cumsum(chars + 1)]
        starts = self.scanner.boundaries(points, resets)
        data = np.frombuffer(joined.encode() + bytes(16), np.uint8)
        at = starts
        if len(data) - 16 != len(points):
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(width) - width)[starts]
        cuts = np.searchsorted(starts, resets)
        size = np.diff(at, append=len(data) - 16)
        at, size = np.delete(at, cuts), np.delete(size, cuts)
        parts = [self.ids_of(data, at[a : a + SLICES], size[a : a + SLICES]) for a in range(0, len(at), SLICES)]
        ids, counts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
        return ids, np.r_[0, np.cumsum(counts)][cuts - np.arange(len(cuts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, cuts = self.encode_all(texts)
        data, stop = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
        return [data[a:b] for a, b in zip(stop, stop[1:])]

    def offsets_all(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The byte offset of each token in its text."""
        size = self.length[ids]
        before = np.cumsum(size) - size
        return (before - np.repeat(np.append(before, 0)[cuts[:-1]], np.diff(cuts))).astype(np.uint32)

    def offsets(self, ids: bytes) -> bytes:
        """The byte offset of each token."""
        at = np.frombuffer(ids, "<u4")
        return self.offsets_all(at, np.array([0, len(at)])).astype("<u4").tobytes()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' bytes in a row, and where each text's begin and the last one's end."""
        size, counts = self.length[ids], np.diff(cuts)
        stops = np.zeros(len(counts), np.int64)
        if len(ids):
            stops[counts > 0] = np.maximum.reduceat(offsets + size, cuts[:-1][counts > 0])
        stop = np.r_[0, np.cumsum(stops)]
        out = np.zeros(int(stop[-1]), np.uint8)
        to = offsets + np.repeat(stop[:-1], counts)
        out[spread(to, size)] = self.blob[spread(self.begin[ids], size)]
        return out, stop

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        return self.decode_all(at, np.frombuffer(offsets, "<u4"), np.array([0, len(at)]))[0].tobytes()


_codecs: dict[int, Codec] = {}


def release() -> None:
    _codecs.clear()


def codec(rank_file: bytes) -> Codec:
    enter("bpe")
    key = hash(rank_file)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file)
    return _codecs[key]


def read_ranks(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return data


def groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_CHARS."""
    a = chars = 0
    for i, n in enumerate(sizes):
        if chars and chars + n > GROUP_CHARS:
            yield a, i
            a, chars = i, 0
        chars += n
    if a < len(sizes):
        yield a, len(sizes)


def lengths(column: pa.Array) -> list[int]:
    """Of strings or binaries, in units of the column; null: 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary of each values[cuts[k] : cuts[k + 1]]."""
    stop = cuts * values.itemsize
    if stop[-1] >= 1 << 31:
        return pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(values)])


def encode(docs: DataFrame, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, offsets): both little-endian unsigned 32-bit integers, one for each token."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for a, b in groups(lengths(batch.column(1))):
                ids, cuts = c.encode_all([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), binaries(ids, cuts), binaries(c.offsets_all(ids, cuts), cuts)], ["doc_id", "ids", "offsets"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, ids binary, offsets binary")


def decode(encoded: DataFrame, rank_path: str | None = None) -> DataFrame:
    """encoded's doc_id and ids, and the decoded bytes."""
    spark = prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for a, b in groups(lengths(batch.column(1))):
                part = batch.slice(a, b - a)
                decoded = [c.decode(i.as_py(), o.as_py()) for i, o in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids", "offsets")
    return rows.mapInArrow(run, f"doc_id {id_type(encoded)}, ids binary, decoded binary")


def round_trip(docs: DataFrame, rank_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, offsets, decoded): encode and decode in one pass, with one Python process a task."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for a, b in groups(lengths(batch.column(1))):
                ids, cuts = c.encode_all([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                offsets = c.offsets_all(ids, cuts)
                decoded = binaries(*c.decode_all(ids, offsets, cuts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), binaries(ids, cuts), binaries(offsets, cuts), decoded], ["doc_id", "ids", "offsets", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, ids binary, offsets binary, decoded binary")


def digests(docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of an exact round trip."""
    both = round_trip(docs, rank_path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
