"""Byte-level BPE over whole batches: texts are cut into the tokenizer's pieces with array operations, and only the
distinct pieces of a batch are encoded."""

from __future__ import annotations

import base64
from array import array

import numpy as np

# Code points that the short way knows (Latin letters, with their marks and signs), and the pieces' classes.
LAST = 0x24F
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(int(base), ())) < max(n, 1):
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        _powers[int(base)] = np.multiply.accumulate(out)
    return _powers[int(base)][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64)


class SliceHasher:
    """64-bit hashes of slices of a byte array: a polynomial over random values of the bytes, mixed, with the length."""

    def __init__(self, data: np.ndarray, seed: int = 7):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        self.back = powers(_INVERSE, len(data) + 1)
        np.cumsum(byte_values(seed)[data] * powers(_P, len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mixed(h ^ mixed((ends - starts).astype(np.uint64) + np.uint64(1)))


def _classes() -> np.ndarray:
    import regex

    out = np.full(0x800, UNKNOWN, np.uint8)
    for c in range(LAST + 1):
        out[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER
    out[:0x20] = UNKNOWN  # of the white space, the short way knows three sorts
    out[0x7F:0xA1] = UNKNOWN
    out[[0x20, 0x09, 0x0A]] = SPACE
    out[ord("'")] = UNKNOWN  # may begin a contraction
    return out


class PieceTokenizer:
    """ids of `tokenizers` for the file at path, add_special_tokens=False, and then the end id.

    ranks: the same vocabulary as a file of ranks, or None; then each text goes to the library itself, which takes
    some four times as long. Texts with special tokens' strings, apostrophes or letters beyond Latin take a longer way."""

    def __init__(self, path: str, ranks: str | None, pattern: str, end: int = 1, cached: int = 200_000):
        self.path, self.ranks, self.pattern, self.end, self.cached = path, ranks, pattern, end, cached
        self._tools = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    @property
    def tools(self) -> tuple:
        if self._tools is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            full, ranked = Tokenizer.from_file(self.path), None
            if self.ranks:
                import tiktoken

                with open(self.ranks, "rb") as lines:
                    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
                ranked = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
            special = [x.content for x in full.get_added_tokens_decoder().values()]
            self._tools = full, ranked, special, _classes()
            self.forget()
        return self._tools

    def forget(self) -> None:
        """Empties the store of pieces: known has a piece's slot by its hash, flat the ids of all slots in a row."""
        self.known, self.flat, self.sizes = {}, array("i"), array("i")

    @property
    def wide(self) -> bool:
        """Whether ids may need more than 16 bits."""
        return self.tools[0].get_vocab_size(with_added_tokens=True) >= 1 << 16 or self.end >= 1 << 16

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and where each text's ids end. data: their UTF-8; offsets: len + 1 bounds."""
        full, ranked, special, classes = self.tools
        n = len(offsets) - 1
        if ranked is None:
            texts = [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            parts = [e.ids + [self.end] for e in full.encode_batch(texts, add_special_tokens=False)]
            return np.array([x for p in parts for x in p], np.uint32), np.cumsum([len(p) for p in parts], dtype=np.int64)
        kind = classes[data]
        lead = np.flatnonzero(data >= 0xC0)
        lead = lead[lead + 1 < len(data)]
        point = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = np.where(data[lead] < 0xE0, classes[point], UNKNOWN)
        kind[np.flatnonzero(data >= 0xE0)] = UNKNOWN
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == UNKNOWN, out=odd[1:])
        long_way = odd[offsets[1:]] > odd[offsets[:-1]]
        raw = data.tobytes()
        for word in special:
            at = raw.find(word.encode())
            while at >= 0:
                long_way[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(word.encode(), at + 1)
        # Pieces: runs of a class, each with the one space before it; white space before something else gives up its last character.
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = kind[1:] != kind[:-1]
        start[offsets] = True
        first = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1 if len(data) > 1 else np.zeros(0, np.int64)
        bound = np.zeros(len(data) + 1, bool)
        bound[offsets] = True
        first = first[~bound[first]]
        start[first - 1] = True
        start[first[data[first - 1] == 0x20]] = False
        edges = np.flatnonzero(start)
        begin, stop = edges[:-1], edges[1:]
        owner = np.searchsorted(offsets, begin, "right") - 1
        short = ~long_way[owner] if n else np.zeros(0, bool)
        begin, stop, owner = begin[short], stop[short], owner[short]
        hashes, where, back = np.unique(SliceHasher(data)(begin, stop), return_index=True, return_inverse=True)
        if len(self.known) > self.cached:
            self.forget()
        known, encode, names = self.known, ranked.encode_ordinary, hashes.tolist()
        fresh = [i for i, h in enumerate(names) if h not in known]
        for i, a, b in zip(fresh, begin[where[fresh]].tolist(), stop[where[fresh]].tolist(), strict=True):
            ids = encode(raw[a:b].decode())
            known[names[i]] = len(known)
            self.flat.extend(ids)
            self.sizes.append(len(ids))
        slots = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        flat, all_sizes = np.array(self.flat, np.int32), np.array(self.sizes, np.int64)
        sizes, slots = all_sizes[slots], (np.cumsum(all_sizes) - all_sizes)[slots]
        # What each text holds: its pieces' ids, or those of the long way, and the end id.
        counts = sizes[back]
        own = np.bincount(owner, counts, n).astype(np.int64) if n else np.zeros(0, np.int64)
        longer = {}
        for i in np.flatnonzero(long_way).tolist():
            text = raw[offsets[i] : offsets[i + 1]].decode()
            longer[i] = full.encode(text, add_special_tokens=False).ids if any(w in text for w in special) else ranked.encode_ordinary(text)
            own[i] = len(longer[i])
        last = np.cumsum(own + 1)
        out = np.full(int(last[-1]) if n else 0, self.end, np.uint32)
        # A piece's place: its text's start plus the ids of the text's pieces before it.
        before = np.cumsum(counts) - counts
        if len(counts):
            opening = np.concatenate([[True], owner[1:] != owner[:-1]])
            base = before[np.maximum.accumulate(np.where(opening, np.arange(len(before)), 0))]
            place = (last - own - 1)[owner] + before - base
            at = np.arange(int(counts.sum()))
            out[np.repeat(place - before, counts) + at] = flat[np.repeat(slots[back] - before, counts) + at]
        for i, ids in longer.items():
            out[last[i] - 1 - own[i] : last[i] - 1] = ids
        return out, last
