"""External induced suffix sorting with common-prefix values.

A suffix is of type S if it is smaller than the next suffix, else L; a star is an S after an L. Sorted stars induce
the order of all L suffixes in one ascending scan, and these that of all S suffixes in one descending scan: the
suffix before the one scanned joins the queue of its first character. Every entry carries its common-prefix length with
its queue's previous entry: one more than the least value scanned since that entry.

The queues make a priority queue of (character, time of entry). Characters share a page while they are rare, and pages
a group; a page that is reached is put in order, and scanned as far as nothing that it induces into itself must come first. So
a text may have any number of characters. The stars' substrings, from each to the next, are ranked, their ranks make a
shorter text, and the procedure recurs on that; the prefixes found there, in ranks, tell where the comparison of two stars starts.

Tuples (position, prefix) of queues, of the L suffixes and of the stars are streams: beyond a byte budget they go to
files in a folder that a task is given. In memory are the text, the types and runs of its suffixes (two bytes each), and the
stars' positions and ranks."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: Common prefixes are told up to this length.
MOST = 255
CHUNK = 1 << 16
#: Pages of more than one character hold about so many suffixes, or the root of the text's length.
LEAST_PAGE = 256
#: A group holds the entries of about so many pages.
GROUP = 64

Tuples = tuple[np.ndarray, np.ndarray]


class Disk:
    """Keeps the tuples of a sort in memory up to a budget of bytes, beyond it in files of a folder of its own (a URL)."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget, self.held, self.written = f"{folder}/{uuid.uuid4().hex}", budget, 0, 0
        self.spools: set[Spool] = set()
        self.store, self.files = None, {}

    def grown(self, n: int) -> None:
        self.held += n
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.store is None:
            self.store, self.folder = fs.FileSystem.from_uri(self.folder)
            self.store.create_dir(self.folder)
        path, at = f"{self.folder}/{len(self.files)}", 0
        with self.store.open_output_stream(path) as out:
            for spool in self.spools:
                if spool.fresh:
                    position, prefix = _joined(spool.fresh)
                    out.write(position.tobytes())
                    out.write(prefix.tobytes())
                    spool.old.append((path, at, len(position)))
                    spool.fresh.clear()
                    at += 9 * len(position)
        self.files[path] = self.store.open_input_file(path)
        self.written += at
        self.held = 0

    def read(self, path: str, at: int, n: int, some: slice) -> Tuples:
        file, (a, z, _) = self.files[path], some.indices(n)
        file.seek(at + 8 * a)
        position = np.frombuffer(file.read(8 * (z - a)), np.int64)
        file.seek(at + 8 * n + a)
        return position, np.frombuffer(file.read(z - a), np.uint8)

    def __enter__(self) -> Disk:
        return self

    def __exit__(self, *_) -> None:
        for file in self.files.values():
            file.close()
        if self.store is not None:
            self.store.delete_dir(self.folder)


def _joined(parts: list[Tuples] | deque) -> Tuples:
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


class Spool:
    """Tuples in the order of their entry: written parts, then those in memory."""

    def __init__(self, disk: Disk):
        self.disk, self.old, self.fresh = disk, deque(), deque()
        disk.spools.add(self)

    def add(self, position: np.ndarray, prefix: np.ndarray) -> None:
        if len(position):
            self.fresh.append((position, prefix))
            self.disk.grown(9 * len(position))

    def some(self) -> Tuples | None:
        """The oldest tuples, about CHUNK of them."""
        if self.old:
            path, at, n = self.old.popleft()
            if n <= 2 * CHUNK:
                return self.disk.read(path, at, n, slice(None))
            self.old.appendleft((path, at, n))
            return self._slice()
        parts, n = [], 0
        while self.fresh and n < CHUNK:
            parts.append(self.fresh.popleft())
            n += len(parts[-1][0])
        self.disk.held -= 9 * n
        return _joined(parts) if parts else None

    _begun = 0

    def _slice(self) -> Tuples:
        path, at, n = self.old[0]
        a, z = self._begun, min(self._begun + CHUNK, n)
        self._begun = z
        if z == n:
            self.old.popleft()
            self._begun = 0
        return self.disk.read(path, at, n, slice(a, z))

    def backwards(self) -> Iterator[Tuples]:
        """All tuples, the latest first; a prefix is told with the one that comes before it in this direction."""
        carried = np.zeros(1, np.uint8)
        for position, prefix in self._from_the_end():
            yield position[::-1], np.concatenate([carried, prefix[:0:-1]])
            carried = prefix[:1]
        self.close()

    def _from_the_end(self) -> Iterator[Tuples]:
        while self.fresh or self.old:
            parts, n = [], 0
            while self.fresh and n < CHUNK:
                parts.append(self.fresh.pop())
                n += len(parts[-1][0])
            if parts:
                self.disk.held -= 9 * n
                yield _joined(parts[::-1])
                continue
            path, at, n = self.old.pop()
            for z in range(n, 0, -CHUNK):
                yield self.disk.read(path, at, n, slice(max(z - CHUNK, 0), z))

    def close(self) -> None:
        self.disk.spools.discard(self)


class PageQueue:
    """FIFO queues of pages, which are reached in order. Entries of pages not reached wait with their group."""

    def __init__(self, weight: np.ndarray, heavy: np.ndarray, least: int, disk: Disk):
        self.disk = disk
        self.group = _numbered(weight, heavy, least * GROUP)
        self.alone = np.bincount(self.group) == 1
        self.groups = [Spool(disk) for _ in self.alone]
        self.reached, self.pages = -1, {}

    def push(self, page: np.ndarray, position: np.ndarray, prefix: np.ndarray) -> None:
        """page: in order, none before the one reached."""
        group = self.group[page]
        own = int(group.searchsorted(self.reached, "right"))
        if own and not self.alone[self.reached]:
            for a, z in _edges(page[:own]):
                p = int(page[a])
                if p not in self.pages:
                    self.pages[p] = Spool(self.disk)
                self.pages[p].add(position[a:z], prefix[a:z])
        else:
            own = 0
        for a, z in _edges(group[own:]):
            self.groups[group[own + a]].add(position[own + a : own + z], prefix[own + a : own + z])

    def reach(self, page: int, page_of) -> None:
        g = int(self.group[page])
        if g == self.reached:
            return
        self.reached = g
        for spool in self.pages.values():
            spool.close()
        self.pages = {}
        if not self.alone[g]:
            parts = []
            while (part := self.groups[g].some()) is not None:
                parts.append(part)
            if parts:
                position, prefix = _joined(parts)
                page = page_of(position)
                order = np.argsort(page, kind="stable")
                self.push(page[order], position[order], prefix[order])

    def some(self, page: int) -> Tuples | None:
        g = self.group[page]
        spool = self.groups[g] if self.alone[g] else self.pages.get(page)
        return spool.some() if spool else None

    def empty(self, page: int) -> bool:
        g = self.group[page]
        spool = self.groups[g] if self.alone[g] else self.pages.get(page)
        return not spool or not (spool.old or spool.fresh)

    def close(self) -> None:
        for spool in [*self.groups, *self.pages.values()]:
            spool.close()


def _edges(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal numbers."""
    if not len(x):
        return iter(())
    cuts = ((x[1:] != x[:-1]).nonzero()[0] + 1).tolist()
    return zip([0, *cuts], [*cuts, len(x)], strict=True)


def _numbered(weight: np.ndarray, heavy: np.ndarray, most: int) -> np.ndarray:
    """Neighbours share a number while they weigh about `most`; heavy ones are alone."""
    at = (np.cumsum(weight) - weight) // most
    return np.cumsum(np.concatenate([[False], (at[1:] != at[:-1]) | heavy[1:] | heavy[:-1]]))


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last one is."""
    n = len(text)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    smaller = np.ones(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    at = np.where(differs, np.arange(n), n)
    return smaller[np.minimum.accumulate(at[::-1])[::-1]]


def _runs(text: np.ndarray) -> np.ndarray:
    """How long each suffix's run of its first character is, up to MOST."""
    n = len(text)
    ends = np.flatnonzero(np.concatenate([text[:-1] != text[1:], [True]]))
    return np.minimum(np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) + 1, MOST).astype(np.uint8)


class _Scan:
    """One induction over a stream of given tuples in order (stars ascending, L suffixes descending): an iterator of (position,
    prefix, queued) of all that is scanned, in order, a prefix told with the suffix before. Characters count from the
    scan's start: in a descending scan the largest is 0."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, runs: np.ndarray, characters: int, given: Iterator[Tuples], up: bool, disk: Disk):
        self.text, self.kind, self.runs, self.top, self.up = text, kind, runs, characters - 1, up
        self.given, self.ahead = given, None
        weight = np.bincount(text, minlength=characters)
        weight = weight if up else weight[::-1]
        least = max(LEAST_PAGE, int(len(text) ** 0.5))
        heavy = weight > least
        self.page = _numbered(weight, heavy, least)
        self.starts = np.append(np.flatnonzero(np.diff(self.page, prepend=-1)), characters)
        self.queue = PageQueue(np.add.reduceat(weight, self.starts[:-1]), heavy[self.starts[:-1]], least, disk)
        # Of a queue's last entry: the part that it came in, and the least value scanned behind it there; latest: the last part with so small a value.
        self.high, self.when = np.zeros(characters, np.uint8), np.zeros(characters, np.int32)
        self.latest, self.part = np.zeros(MOST + 1, np.int32), 0
        self.seen = np.zeros(characters, bool)
        self.none = 2 * characters
        self.key, self.last = np.array([-2]), -1  # character (twice, one more if given) and position of what was scanned last

    def code(self, position: np.ndarray) -> np.ndarray:
        return self.text[position].astype(np.int64) if self.up else self.top - self.text[position].astype(np.int64)

    def _given_below(self, character: int) -> Iterator[Tuples]:
        while True:
            if self.ahead is None:
                position, prefix = next(self.given, (None, None))
                if position is None:
                    return
                self.ahead = position, prefix, self.code(position)
            position, prefix, codes = self.ahead
            k = int(np.searchsorted(codes, character))
            self.ahead = (position[k:], prefix[k:], codes[k:]) if k < len(position) else None
            if k:
                yield position[:k], prefix[:k]
            if self.ahead is not None:
                return

    def _run(self, position: int, prefix: int) -> Tuples:
        """The one suffix in a character's queue and those that it induces there: the run of the character before it."""
        c, start = self.text[position], position
        while start and self.text[start - 1] == c:
            before = self.text[max(start - CHUNK, 0) : start][::-1] != c
            start -= int(np.argmax(before)) if before.any() else len(before)
        first = min(prefix, int(self.since(self.code(np.array([position])))[0]))
        steps = np.minimum(first + np.arange(1, position - start + 1), MOST).astype(np.uint8)
        return np.arange(position, start - 1, -1), np.append(np.uint8(prefix), steps)

    def since(self, queue: np.ndarray) -> np.ndarray:
        """The least value scanned since each queue's last entry."""
        return np.minimum(self.high[queue], self.latest.searchsorted(self.when[queue], "right")).astype(np.uint8)

    def _targets(self, position: np.ndarray) -> np.ndarray:
        """Twice the character whose queue the suffix before each is induced into, or self.none."""
        ahead = position - 1
        return np.where((self.kind[ahead] != self.up) & (position > 0), 2 * self.code(ahead), self.none)

    def _feed(self, position: np.ndarray, prefix: np.ndarray, key: np.ndarray, run: bool = False, targets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scans suffixes and queues those before them; of a run, that before its start. key: twice the character, one more where
        given; a single key is that of all. targets: _targets(position), if known."""
        prefix, n = prefix.copy(), len(position)
        # A character's first has nothing in common with the one before; where queued ones meet given ones, runs decide.
        before = np.concatenate([self.key, key[:-1]])
        changed = (before != key).nonzero()[0]
        if len(changed):
            prefix[changed] = 0
            meets = changed[before[changed] >> 1 == key[changed] >> 1]
            prefix[meets] = np.minimum(self.runs[position[meets]], self.runs[np.where(meets > 0, position[meets - 1], self.last)])
        self.key, self.last = key[-1:], int(position[-1])
        queued = key & 1 == 0 if len(key) == n else np.full(n, key[0] & 1 == 0)
        if run:
            targets = np.full(n, self.none)
            targets[-1:] = self._targets(position[-1:])
        elif targets is None:
            targets = self._targets(position)
        picked = (targets != self.none).nonzero()[0]
        low, m = int(key[0]) >> 1, len(picked)
        if m:
            target = targets[picked] >> 1
            order = target.argsort(kind="stable")
            at, target = picked[order], target[order]
            first = np.ones(m, bool)
            np.not_equal(target[1:], target[:-1], out=first[1:])
            opens = first.nonzero()[0]
            entered, begin = target[opens], np.zeros(m, np.int64)
            begin[1:] = at[:-1] + 1
            least = _least(prefix, begin, at, first)
            least[opens] = np.minimum(np.minimum.accumulate(prefix)[at[opens]], self.since(entered))
            least = np.minimum(least, MOST - 1) + np.uint8(1)
            least[opens[~self.seen[entered]]] = 0
            self.queue.push(self.page[target], position[at] - 1, least)
            # The least value behind a queue's last entry here.
            behind = np.full(n + 1, MOST, np.uint8)
            np.minimum.accumulate(prefix[::-1], out=behind[n - 1 :: -1])
            high = behind[at[np.concatenate([opens[1:] - 1, [m - 1]])] + 1]
        self.part += 1
        self.latest[prefix.min() :] = self.part
        if run:
            self.high[low], self.when[low] = prefix[-1], self.part
        if m:
            self.high[entered], self.when[entered] = high, self.part
            self.seen[entered] = True
        return position, prefix, queued

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for page, (start, end) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            self.queue.reach(page, lambda position: self.page[self.code(position)])
            if end - start > 1:
                yield from self._mixed(page, end)
                continue
            while (part := self.queue.some(page)) is not None:
                run = len(part[0]) == 1 and self.queue.empty(page)
                yield self._feed(*(self._run(int(part[0][0]), int(part[1][0])) if run else part), np.array([2 * start]), run)
            for part in self._given_below(end):
                yield self._feed(*part, np.array([2 * start + 1]))
        self.queue.close()

    def _entered(self, page: int) -> Tuples:
        parts = []
        while (part := self.queue.some(page)) is not None:
            parts.append(part)
        return _joined(parts)

    def _mixed(self, page: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A page of several characters: of each, queued suffixes come before given ones."""
        position, prefix = self._entered(page)
        told = _joined(list(self._given_below(end)))
        key = np.concatenate([2 * self.code(position), 2 * self.code(told[0]) + 1])
        position, prefix = np.concatenate([position, told[0]]), np.concatenate([prefix, told[1]])
        order = key.argsort(kind="stable")
        key, position, prefix = key[order], position[order], prefix[order]
        targets = self._targets(position)
        while len(key):
            # What is induced into this page comes behind the queued ones of its character: up to there the order is final.
            late = key[1:] > np.minimum.accumulate(targets)[:-1]
            n = int(late.argmax()) + 1 if late.any() else len(key)
            if n == 1 and targets[0] == key[0]:
                yield self._feed(*self._run(int(position[0]), int(prefix[0])), key[:1], True)
            else:
                yield self._feed(position[:n], prefix[:n], key[:n], targets=targets[:n])
            key, position, prefix, targets = key[n:], position[n:], prefix[n:], targets[n:]
            more = self._entered(page)
            if len(more[0]):
                key = np.concatenate([key, 2 * self.code(more[0])])
                order = key.argsort(kind="stable")
                key, position, prefix, targets = key[order], np.concatenate([position, more[0]])[order], np.concatenate([prefix, more[1]])[order], np.concatenate([targets, self._targets(more[0])])[order]


def _least(values: np.ndarray, a: np.ndarray, z: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The least of values[a] to values[z], both included, by spans whose lengths are powers of two; anything where skip is set."""
    out = values[z]
    size = np.where(skip, 1, z - a + 1)
    level = np.frexp(size)[1] - 1
    table, span = values, 1
    for k in range(1, int(level.max(initial=0)) + 1):
        table = np.minimum(table[:-span], table[span:])
        span *= 2
        at = (level == k).nonzero()[0]
        if len(at):
            out[at] = np.minimum(table[a[at]], table[z[at] - span + 1])
    return out


def _star_names(text: np.ndarray, kind: np.ndarray, star: np.ndarray) -> np.ndarray:
    """Ranks of the stars' substrings by (character, type), equal ones alike. None is a proper beginning of another: an S
    after an L ends each. Some characters, as many as 64 bits hold, are compared at a time, and only those still equal go on."""
    n = len(text)
    bits = int(text.max()).bit_length() + 2
    wide = 64 // bits
    coded = np.concatenate([text.astype(np.uint64) * np.uint64(2) + kind + np.uint64(1), np.zeros(wide, np.uint64)])
    size = np.append(np.diff(star) + 1, n - star[-1])
    names, live, at = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(live):
        key = np.zeros(len(live), np.uint64)
        for k in range(at, at + wide):
            key = (key << np.uint64(bits)) | np.where(k < size[live], coded[np.minimum(star[live] + k, n)], np.uint64(0))
        order = np.lexsort((key, names[live])) if at else np.argsort(key, kind="stable")
        place, group, key = live[order], names[live[order]], key[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        # A name is its group's plus how many of the group come before its own key.
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        base = np.maximum.accumulate(np.where(opens, np.arange(len(place)), 0))
        names[place] = group + first - base
        at += wide
        alone = fresh & np.append(fresh[1:], True)
        live = place[~alone & (size[place] > at)]
    used = np.zeros(len(star), bool)
    used[names] = True
    return (np.cumsum(used) - 1)[names]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Lengths, up to MOST, of the common prefixes of suffixes a and b, of which `known` characters agree."""
    out = np.minimum(known, MOST)
    live = np.flatnonzero(out < MOST)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        live = live[text[np.minimum(x, len(text) - 1)] == text[np.minimum(y, len(text) - 1)]]
        out[live] += 1
        live = live[out[live] < MOST]
    return out.astype(np.uint8)


def _sorted_stars(text: np.ndarray, kind: np.ndarray, disk: Disk) -> Iterator[Tuples]:
    """The stars in order, with the prefix that each has in common with the one before."""
    star = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    names = _star_names(text, kind, star)
    distinct = int(names.max()) + 1
    ranked = Spool(disk)
    if distinct == len(star):
        ranked.add(np.argsort(names)[::-1], np.zeros(len(star), np.uint8))
    else:
        for part in suffixes_descending(names, distinct, disk):  # the last star is the end itself: the least name, alone
            ranked.add(*part)
    del names
    before = 0
    for place, shared in ranked.backwards():
        a, b = star[np.append(before, place[:-1])], star[place]
        # Names that agree: all characters up to the first star that differs.
        known = star[np.minimum(place + shared, len(star) - 1)] - b
        known[shared == MOST] = MOST
        prefix = common_prefix(text, a, b, known)
        before = int(place[-1])
        yield b, prefix


def suffixes_descending(text: np.ndarray, characters: int, disk: Disk) -> Iterator[Tuples]:
    """(position, prefix), in parts: the suffixes of text from the largest on, and the length, up to MOST, of the prefix that
    each has in common with the one before in this order. text: numbers under `characters`, the last of which is 0 and occurs
    nowhere else."""
    if len(text) > 1:
        kind, runs = _types(text), _runs(text)
        large = Spool(disk)
        for position, prefix, queued in _Scan(text, kind, runs, characters, _sorted_stars(text, kind, disk), True, disk):
            if queued.all():
                large.add(position, prefix)
            elif queued.any():
                large.add(position[queued], prefix[queued])
        for position, prefix, _ in _Scan(text, kind, runs, characters, large.backwards(), False, disk):
            yield position, prefix
    yield np.array([len(text) - 1]), np.zeros(1, np.uint8)


def sort_suffixes(text: np.ndarray, characters: int, folder: str, budget: int) -> Tuples:
    """All suffixes of a small text in ascending order at once, with the prefixes in common with the one before."""
    with Disk(folder, budget) as disk:
        position, prefix = _joined(list(suffixes_descending(text, characters, disk)))
    return position[::-1], np.append(np.zeros(1, np.uint8), prefix[:0:-1])
