"""External induced sorting of a text's suffixes, with their common prefixes.

Suffixes that begin at a local minimum (LMS) are put in order first: their
substrings up to the next minimum are sorted by one induction and named, and
the names in text order are a reduced text, whose suffixes are sorted the same
way, level by level, until a level fits in memory. The level's order and common
prefixes, the latter stretched from names to symbols, seed a second induction,
which carries them to all suffixes: a scan in ascending order hands each suffix
of type L to the priority queue under its first symbol, a scan in descending
order each of type S. An entry of the queue is a place and its common prefix
with the entry before it of the same symbol, which is one more than the least
over the scanned entries between the two that induced them.

Queues, sorted streams, the text and arrays of its size are blocks in memory up
to a limit, and blocks of unlinked scratch files of the worker beyond it; a
queue spills as a run sorted by symbol, and runs are read again from their
heads. Nothing else reads those files, and they end with the worker.

Order and common prefixes count up to a depth, the length of text that is
looked for.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries of each structure that stay in memory, and entries handled at once.
IN_MEMORY = 4_000_000
BLOCK = 1 << 18


class Scratch:
    """Room for one text: a file that grows by blocks, and arrays that are mapped where they are large."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.block, self.file = limit, max(1, min(BLOCK, limit)), None

    def write(self, array: np.ndarray) -> tuple[int, int, np.dtype]:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        array.tofile(self.file)
        return at, len(array), array.dtype

    def read(self, kept: tuple[int, int, np.dtype], start: int, end: int) -> np.ndarray:
        self.file.seek(kept[0] + start * kept[2].itemsize)
        return np.fromfile(self.file, dtype=kept[2], count=end - start)

    def array(self, n: int, kind: type) -> np.ndarray:
        return np.zeros(n, dtype=kind) if n <= self.limit else np.memmap(tempfile.TemporaryFile(), dtype=kind, mode="w+", shape=(n,))


class Growing:
    """An array that is appended to, in memory or in a file of its own."""

    def __init__(self, scratch: Scratch, kind: type):
        self.scratch, self.kind, self.parts, self.held, self.n, self.file = scratch, np.dtype(kind), [], 0, 0, None

    def add(self, array: np.ndarray) -> None:
        self.parts.append(np.asarray(array, dtype=self.kind))
        self.held += len(array)
        self.n += len(array)
        if self.held > self.scratch.limit:
            self._flush()

    def _flush(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for p in self.parts:
            p.tofile(self.file)
        self.parts, self.held = [], 0

    def done(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        self._flush()
        self.file.flush()
        return np.memmap(self.file, dtype=self.kind, mode="r+", shape=(self.n,))


class Stream:
    """Sorted entries (place, common prefix), written once and read in blocks either way."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.parts, self.spilled = scratch, 0, [], []

    def add(self, place: np.ndarray, lcp: np.ndarray) -> None:
        if len(place):
            self.parts.append((place, lcp))
            self.held += len(place)
            if self.held > self.scratch.limit:
                self.spilled += [(self.scratch.write(p), self.scratch.write(x)) for p, x in self._whole()]
                self.parts, self.held = [], 0

    def _whole(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The parts in memory, small ones put together."""
        if not self.parts:
            return []
        place, lcp = np.concatenate([p for p, _ in self.parts]), np.concatenate([x for _, x in self.parts])
        step = self.scratch.block
        return [(place[k : k + step], lcp[k : k + step]) for k in range(0, len(place), step)]

    def blocks(self, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        here = self._whole()
        self.parts = here
        for kept in reversed([*self.spilled, *here]) if backward else [*self.spilled, *here]:
            if isinstance(kept[0], np.ndarray):
                yield kept
            else:
                yield self.scratch.read(kept[0], 0, kept[0][1]), self.scratch.read(kept[1], 0, kept[1][1])


class _Run:
    """A spilled part of a queue, sorted by key."""

    def __init__(self, scratch: Scratch, key: np.ndarray, place: np.ndarray, lcp: np.ndarray):
        self.scratch, self.kept, self.n = scratch, [scratch.write(x) for x in (key, place, lcp)], len(key)
        self.at = self.base = 0
        self.buffer: list[np.ndarray] = []
        self._fill()

    def _fill(self) -> None:
        self.base += self.at
        end = min(self.n, self.base + self.scratch.block)
        self.at, self.buffer = 0, [self.scratch.read(k, self.base, end) for k in self.kept] if self.base < self.n else []

    def head(self) -> int | None:
        return int(self.buffer[0][self.at]) if self.buffer else None

    def take(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """The next entries of key; more of them may follow."""
        end = int(np.searchsorted(self.buffer[0], key, side="right"))
        out = self.buffer[1][self.at : end], self.buffer[2][self.at : end]
        self.at = end
        if end == len(self.buffer[0]):
            self._fill()
        return out


class Queue:
    """A disk-backed priority queue of (key, place, common prefix). Least keys leave first, entries of one key as they came."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.heap, self.runs = scratch, 0, [], []
        self.own: dict[int, list] = {}

    def push(self, key: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> None:
        """Entries sorted by key."""
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])).tolist()
        for k, s, e in zip(key[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
            if k not in self.own:
                self.own[k] = []
                heapq.heappush(self.heap, k)
            self.own[k].append((place[s:e], lcp[s:e]))
        self.held += len(key)
        if self.held > self.scratch.limit:
            self._spill()

    def _spill(self) -> None:
        parts = [(k, p, x) for k in sorted(self.own) for p, x in self.own[k]]
        key = np.repeat(np.array([k for k, _, _ in parts], dtype=np.int64), [len(p) for _, p, _ in parts])
        self.runs.append(_Run(self.scratch, key, np.concatenate([p for _, p, _ in parts]), np.concatenate([x for _, _, x in parts])))
        self.own, self.heap, self.held = {}, [], 0

    def least(self) -> int | None:
        heads = [h for r in self.runs if (h := r.head()) is not None]
        if self.heap:
            heads.append(self.heap[0])
        return min(heads) if heads else None

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """The next entries of the least key."""
        for r in self.runs:
            if r.head() == key:
                out = r.take(key)
                self.runs = [x for x in self.runs if x.buffer]
                return out
        heapq.heappop(self.heap)
        parts = self.own.pop(key)
        out = np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])
        self.held -= len(out[0])
        return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, known: np.ndarray | None = None) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to depth, of which known symbols are given to be equal."""
    out = np.zeros(len(a), dtype=np.int64) if known is None else np.minimum(known, depth).astype(np.int64)
    live, last, step = np.flatnonzero(out < depth), len(text) - 1, np.arange(8)
    a, b = a.astype(np.int64), b.astype(np.int64)
    while len(live):
        x = text[np.minimum((a[live] + out[live])[:, None] + step, last)]
        y = text[np.minimum((b[live] + out[live])[:, None] + step, last)]
        differ = x != y
        some = differ.any(axis=1)
        out[live] += np.where(some, differ.argmax(axis=1), len(step))
        live = live[~some & (out[live] < depth)]
    return np.minimum(out, depth).astype(np.uint8)


def lms_places(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Places of the suffixes that are less than the one before and the one after, ascending; text's last entry is the unique least."""
    n, found = len(text), Growing(scratch, np.int64)
    following, right = -1, True  # the symbol after the block and whether its suffix is of type S
    first_is_s = False
    for end in range(n, 0, -scratch.block):
        at = max(0, end - scratch.block)
        x = text[at:end].astype(np.int64)
        after = np.append(x[1:], following)
        said = np.where(x < after, 1, np.where(x > after, 0, -1))
        if end == n:
            said[-1] = 1
        back = said[::-1]
        place = np.maximum.accumulate(np.where(back >= 0, np.arange(len(back)), -1))
        s = np.where(place >= 0, back[place], int(right))[::-1].astype(bool)
        # The first of the block to the right is decided here, by the last of this one.
        if end < n and first_is_s and not s[-1]:
            found.add(np.array([end]))
        found.add((np.flatnonzero(s[1:] & ~s[:-1]) + 1 + at)[::-1])
        first_is_s = right = bool(s[0])
        following = int(x[0])
    down = found.done()
    out = scratch.array(len(down), np.int32 if n < 1 << 31 else np.int64)
    for k in range(0, len(down), scratch.block):
        part = down[k : k + scratch.block]
        out[len(down) - k - len(part) : len(down) - k] = part[::-1]
    return out


class _Ranges:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), dtype=np.int64)
        kind = np.frexp(end - start)[1] - 1
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            out[own] = np.minimum(self.levels[k][start[own]], self.levels[k][end[own] - (1 << k)])
        return out


class _Inducer:
    """Hands on what a batch of suffixes, in scan order, induces of one type."""

    def __init__(self, text: np.ndarray, symbols: int, queue: Queue, scratch: Scratch, depth: int, ascending: bool):
        self.text, self.queue, self.depth, self.ascending, self.top = text, queue, depth, ascending, symbols - 1
        #: When a symbol last got an entry, counted in scanned entries; -1: it got none.
        self.last = scratch.array(symbols, np.int64)
        self.last[:] = -1
        self.scanned = 0
        #: Entries whose common prefix is less than all later ones'; at most depth + 1.
        self.index, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, symbol: int, place: np.ndarray, lcp: np.ndarray, all_of_type: bool) -> None:
        """lcp: with the suffix scanned before. all_of_type: the batch is of the type that is induced, so equal symbols count."""
        step = self.queue.scratch.block
        for k in range(0, len(place), step):
            self._hand(symbol, place[k : k + step], lcp[k : k + step], all_of_type)

    def _hand(self, symbol: int, place: np.ndarray, lcp: np.ndarray, all_of_type: bool) -> None:
        ok = np.flatnonzero(place > 0)
        before = self.text[place[ok] - 1].astype(np.int64)
        wanted = before > symbol if self.ascending else before < symbol
        if all_of_type:
            wanted |= before == symbol
        ok, before = ok[wanted], before[wanted]
        key = before if self.ascending else self.top - before
        order = np.argsort(key, kind="stable")
        ok, key, before = ok[order], key[order], before[order]
        got = np.zeros(len(ok), dtype=np.uint8)
        if self.depth:
            if len(ok):
                new = np.ones(len(ok), dtype=bool)
                new[1:] = key[1:] != key[:-1]
                start = np.where(new, 0, np.concatenate(([0], ok[:-1] + 1)))
                low = _Ranges(lcp).least(start, ok + 1)
                first = np.flatnonzero(new)
                last = self.last[before[first]]
                if len(self.index):
                    k = np.searchsorted(self.index, last, side="right")
                    earlier = np.where(k < len(self.index), self.value[np.minimum(k, len(self.index) - 1)], self.depth)
                    low[first] = np.minimum(low[first], earlier)
                low[first] = np.where(last < 0, -1, low[first])
                got = np.minimum(low + 1, self.depth).astype(np.uint8)
                ends = np.append(first[1:], len(ok)) - 1
                self.last[before[ends]] = self.scanned + ok[ends]
            tail = np.minimum.accumulate(lcp[::-1])[::-1]
            record = np.ones(len(lcp), dtype=bool)
            record[:-1] = lcp[:-1] < tail[1:]
            stay = self.value < tail[0]
            self.index = np.concatenate([self.index[stay], np.flatnonzero(record) + self.scanned])
            self.value = np.concatenate([self.value[stay], lcp[record].astype(np.int64)])
            self.scanned += len(lcp)
        if len(ok):
            self.queue.push(key, place[ok] - 1, got)


class _BySymbol:
    """Pieces of one first symbol each of a stream of sorted entries, looked at one ahead."""

    def __init__(self, text: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], backward: bool = False):
        self.pieces = self._cut(text, blocks, backward)
        self.next = next(self.pieces, None)

    @staticmethod
    def _cut(text: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], backward: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for place, lcp in blocks:
            symbol = text[place]
            cuts = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(place)])).tolist()
            pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
            for s, e in reversed(pieces) if backward else pieces:
                yield int(symbol[s]), place[s:e], lcp[s:e]

    @property
    def symbol(self) -> int | None:
        return None if self.next is None else self.next[0]

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        _, place, lcp = self.next
        self.next = next(self.pieces, None)
        return place, lcp


def _induce(text: np.ndarray, symbols: int, seeds: Iterator[tuple[np.ndarray, np.ndarray]], scratch: Scratch, depth: int) -> tuple[Stream, Stream]:
    """L-type suffixes ascending and S-type suffixes descending; depth 0: common prefixes are left out. seeds: LMS suffixes by first symbol."""
    larger, smaller = Stream(scratch), Stream(scratch)

    def edge(a: np.ndarray | None, b: np.ndarray) -> int:
        return int(common_prefix(text, a, b, depth)[0]) if depth and a is not None and len(a) else 0

    queue, own = Queue(scratch), _BySymbol(text, seeds)
    hand = _Inducer(text, symbols, queue, scratch, depth, True)
    while (c := min([x for x in (queue.least(), own.symbol) if x is not None], default=None)) is not None:
        last = None
        while queue.least() == c:
            place, lcp = queue.pop(c)
            larger.add(place, lcp)
            hand(c, place, lcp, True)
            last = place[-1:]
        fresh = True
        while own.symbol == c:
            place, lcp = own.pop()
            if fresh:
                lcp = lcp.copy()
                lcp[0] = edge(last, place[:1])
                fresh = False
            hand(c, place, lcp, False)
    queue, own = Queue(scratch), _BySymbol(text, larger.blocks(backward=True), backward=True)
    hand = _Inducer(text, symbols, queue, scratch, depth, False)
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    queue.push(np.array([symbols - 1]), np.array([len(text) - 1], kind), np.zeros(1, np.uint8))
    while True:
        waiting = queue.least()
        c = max([x for x in (None if waiting is None else symbols - 1 - waiting, own.symbol) if x is not None], default=None)
        if c is None:
            break
        last = None
        while queue.least() == symbols - 1 - c:
            place, lcp = queue.pop(symbols - 1 - c)
            smaller.add(place, lcp)
            hand(c, place, lcp, True)
            last = place[-1:]
        carried = None
        while own.symbol == c:
            # An entry's prefix is with its smaller neighbour; in descending order it is the one before's.
            place, lcp = own.pop()
            first = edge(last, place[-1:]) if carried is None else carried
            carried = int(lcp[0])
            hand(c, place[::-1], np.concatenate(([first], lcp[:0:-1])).astype(np.uint8), False)
    return larger, smaller


def _merged(text: np.ndarray, larger: Stream, smaller: Stream, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes ascending, each with its common prefix with the one before."""
    low, up = _BySymbol(text, larger.blocks()), _BySymbol(text, smaller.blocks(backward=True), backward=True)
    while (c := min([x for x in (low.symbol, up.symbol) if x is not None], default=None)) is not None:
        last = None
        while low.symbol == c:
            place, lcp = low.pop()
            yield place, lcp
            last = place[-1:]
        carried = None
        while up.symbol == c:
            place, lcp = up.pop()
            if carried is None:
                carried = int(common_prefix(text, last, place[-1:], depth)[0]) if last is not None and depth else 0
            yield place[::-1], np.concatenate(([carried], lcp[:0:-1])).astype(np.uint8)
            carried = int(lcp[0])


def _doubling(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A level that fits in memory: the order of its suffixes, and common prefixes in names, both counted up to depth."""
    ranks, k, n = [names.astype(np.int64)], 1, len(names)
    while k < depth and int(ranks[-1].max()) + 1 < n:
        rank = ranks[-1]
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        ranks.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].reshape(-1))
        k *= 2
    order = np.argsort(ranks[-1], kind="stable")
    both = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for j in range(len(ranks) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = ranks[j][a[same]] == ranks[j][b[same]]
        a, b = a + (same << j), b + (same << j)
        both[1:] += same << j
    return order, both


def _name(text: np.ndarray, lms: np.ndarray, ordered: Iterator[np.ndarray], scratch: Scratch) -> tuple[np.ndarray, int]:
    """The reduced text: a name for each LMS substring, in text order, and how many names there are."""
    out, name, before = scratch.array(len(lms), np.int64), -1, None
    last = len(lms) - 1
    for place in ordered:
        at = np.searchsorted(lms, place)
        size = lms[np.minimum(at + 1, last)].astype(np.int64) - place + 1
        a = place if before is None else np.concatenate([before[0], place])
        n = size if before is None else np.concatenate([before[1], size])
        new = np.ones(len(a), dtype=bool)
        alike = np.flatnonzero(n[1:] == n[:-1])
        live, done = alike, np.zeros(len(alike), dtype=np.int64)
        step = np.arange(8)
        while len(live):
            offset = done[:, None] + step
            inside = offset < n[live][:, None]
            x, y = (text[np.minimum(a[live + d][:, None] + offset, len(text) - 1)] for d in (0, 1))
            same = ((x == y) | ~inside).all(axis=1)
            ended = same & (done + 8 >= n[live])
            new[live[ended] + 1] = False
            stay = same & ~ended
            live, done = live[stay], done[stay] + 8
        own = new if before is None else new[1:]
        said = name + np.cumsum(own)
        out[at] = said
        name, before = int(said[-1]), (a[-1:], n[-1:])
    return out, name + 1


def suffix_order(text: np.ndarray, symbols: int, depth: int, scratch: Scratch | None = None, levels: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields the suffixes in order, in blocks, and each one's common prefix with the one before.

    text: symbols below symbols, whose last is 0 and the only 0. Order and prefixes count up to depth, at most 255.
    levels gets the lengths of the texts that are sorted by induction.
    """
    scratch = scratch or Scratch()
    if levels is not None:
        levels.append(len(text))
    lms, step = lms_places(text, scratch), scratch.block

    def unsorted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # By first symbol, which is all that the first induction needs: through a queue, as there may be many.
        queue = Queue(scratch)
        for k in range(0, len(lms), step):
            place = np.asarray(lms[k : k + step])
            key = text[place].astype(np.int64)
            order = np.argsort(key, kind="stable")
            queue.push(key[order], place[order], np.zeros(len(place), np.uint8))
        while (c := queue.least()) is not None:
            yield queue.pop(c)

    def is_lms(place: np.ndarray) -> np.ndarray:
        place = place[place > 0]
        return place[text[place - 1] > text[place]]

    if len(text) == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.uint8)
        return
    _, smaller = _induce(text, symbols, unsorted(), scratch, 0)
    ordered = (found for place, _ in smaller.blocks(backward=True) if len(found := is_lms(place[::-1])))
    names, n_names = _name(text, lms, ordered, scratch)
    del smaller
    if n_names == len(names):
        order = scratch.array(len(names), np.int64)
        for k in range(0, len(names), step):
            order[names[k : k + step]] = np.arange(k, min(k + step, len(names)))
        sorted_names = ((order[k : k + step], np.zeros(len(order[k : k + step]), np.uint8)) for k in range(0, len(order), step))
    elif len(names) <= scratch.limit:
        order, both = _doubling(np.asarray(names), depth)
        sorted_names = [(order[k : k + step], both[k : k + step]) for k in range(0, len(order), step)]
    else:
        stream = Stream(scratch)
        for place, both in suffix_order(names, n_names, depth, scratch, levels):
            stream.add(place, both)
        sorted_names = stream.blocks()

    def seeds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        before = None
        for at, both in sorted_names:
            place = lms[at]
            a = np.concatenate([place[:1] if before is None else before, place[:-1]])
            known = lms[np.minimum(at + both.astype(np.int64), len(lms) - 1)].astype(np.int64) - place
            lcp = common_prefix(text, a, place, depth, known)
            if before is None:
                lcp[0] = 0
            yield place, lcp
            before = place[-1:]

    larger, smaller = _induce(text, symbols, seeds(), scratch, depth)
    yield from _merged(text, larger, smaller, depth)
