"""A vectorised front for word-level BPE vocabularies with an end-of-word mark.

The vocabulary lower-cases, drops white space and merges inside pre-tokens
only, so a text's ids are those of its pre-tokens in order. Blocks of texts are
split into pre-tokens with array operations. Every distinct pre-token of up to
LONG code points is encoded once and remembered in a bounded table; longer ones
are encoded as they come.

What a code point is (space, letter, number, other), its lower case and whether
it can take part in a composition is asked of the library, once for each code
point that occurs, so all scripts go the same way. Two kinds of texts are taken
apart first: those with the string of a special token, and those that the
library's normal form changes.

PrefixCounts holds the prefix dynamic programme. For each prefix of a
pre-token exactly one last token t is possible: one whose boundary to the last
token of the shorter prefix survives all merges. Its count is that prefix's
plus one. Two results are kept, for prefixes that the word goes on after and for
prefixes that end it, as the end-of-word mark changes the last symbol. From
them follows the exact count of every prefix of a text, in time linear in it.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import ahocorasick
import numpy as np
from tokenizers import Tokenizer, normalizers

from . import _common as c

#: Distinct pre-tokens that a worker remembers, and values kept for them; beyond either it starts anew.
MOST_WORDS, MOST_VALUES = 1 << 19, 1 << 23
#: Code points of a pre-token that is remembered.
LONG = 64
NONE = np.int32(-1)
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
APOSTROPHE = ord("'")
BASE = np.uint64(0xA0761D6478BD642F)

# What these vocabularies do to a text before they merge.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def _followers() -> frozenset[int]:
    """Code points that may join the one before them in the composed normal form."""
    out = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # vowels and finals of syllables
    for p in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(p)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(int(parts[1], 16))
    return frozenset(out)


class Points:
    """Class, lower case and composing of code points, asked of the library once each."""

    def __init__(self, library: Tokenizer):
        self.split, self.lower, self.nfc = library.pre_tokenizer.pre_tokenize_str, normalizers.Lowercase().normalize_str, normalizers.NFC().normalize_str
        size = 0x110000
        self.kind, self.low = np.full(size, UNKNOWN, np.uint8), np.arange(size, dtype=np.uint32)
        self.wide = np.zeros(size, np.uint8)  # lower-case code points beyond the first
        self.tails: dict[int, list[int]] = {}
        self.composes = np.zeros(size, bool)
        self.known = np.zeros(size, bool)

    def learn(self, cp: np.ndarray) -> None:
        for p in np.unique(cp[~self.known[cp]]).tolist():
            self.known[p] = True
            ch = chr(p)
            low = self.lower(ch)
            self.low[p] = ord(low[0])
            self.wide[p] = len(low) - 1
            if len(low) > 1:
                self.tails[p] = [ord(x) for x in low[1:]]
            for x in low:
                self.kind[ord(x)] = self._kind(x)
            if p >= 0x300:  # the code points below stand alone in the normal form
                self.composes[p] = unicodedata.combining(ch) != 0 or unicodedata.category(ch) == "Cn" or p in _followers() or self.nfc(ch) != ch

    def _kind(self, ch: str) -> int:
        twice = len(self.split(ch + ch))
        return SPACE if not twice else NUMBER if twice == 2 else LETTER if len(self.split("a" + ch)) == 1 else OTHER


class HashTable:
    """uint64 keys to int32 values, by linear probing over arrays."""

    def __init__(self, most: int):
        self.mask = np.uint64((1 << max(4, (2 * most - 1).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.full(int(self.mask) + 1, NONE, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none. Key 0 stands for an empty cell."""
        slot = keys & self.mask
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct new keys, at most `most` in all."""
        slot, todo = keys & self.mask, np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = todo[self.keys[at] == 0]
            self.keys[slot[free]] = keys[free]  # of several, one stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the disjoint, ordered, non-empty ranges of values; never 0."""
    lo, hi = int(starts[0]), int(ends[-1])
    span = np.diff(np.append(starts, hi))
    place = np.arange(lo, hi) - np.repeat(starts, span)
    part = values[lo:hi] * c.powers(BASE, int(span.max()))[place]
    part[place >= np.repeat(ends - starts, span)] = 0
    return c.mix(np.add.reduceat(part, starts - lo) + (ends - starts).astype(np.uint64)) | np.uint64(1)


def joined(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (length[0] of them), then the same of the next."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - length), length)


class Flat:
    """Growing lists of small arrays, flat."""

    def __init__(self, kind):
        self.data, self.at, self.n, self.size = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, lengths: np.ndarray, data: np.ndarray) -> None:
        while self.size + len(data) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        while self.n + len(lengths) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.data[self.size : self.size + len(data)] = data
        self.at[self.n + 1 : self.n + 1 + len(lengths)] = self.size + np.cumsum(lengths)
        self.n, self.size = self.n + len(lengths), self.size + len(data)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at index, joined, and their lengths."""
        first, length = self.at[index], self.at[index + 1] - self.at[index]
        return self.data[joined(first, length)], length


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Block:
    """Pre-tokens of a block of texts: row, start, end (lower-case code points of the block) and hash.

    cp and at are the code points and the offsets of the rows; rows in `blank`
    are passed over. `last` is, for each code point, the place of the last of
    its lower-case ones.
    """

    def __init__(self, points: Points, cp: np.ndarray, at: np.ndarray, blank: np.ndarray | None = None):
        points.learn(cp)
        wide = points.wide[cp]
        low = points.low[cp]
        if wide.any():
            size = wide.astype(np.int64) + 1
            self.last = np.cumsum(size) - 1
            low = np.repeat(low, size)
            for i in np.flatnonzero(wide).tolist():
                low[self.last[i] - wide[i] + 1 : self.last[i] + 1] = points.tails[int(cp[i])]
            self.at = np.concatenate(([0], self.last + 1))[at]
        else:
            self.last, self.at = np.arange(len(cp)), at
        self.points, n = low, len(low)
        kind = points.kind[low]
        if blank is not None:
            for r in np.flatnonzero(blank):
                kind[self.at[r] : self.at[r + 1]] = SPACE
        first = np.zeros(n + 1, bool)
        first[self.at[:-1]] = True
        prev = np.concatenate(([SPACE], kind[:-1])).astype(np.uint8) if n else kind
        fresh = (kind != SPACE) & ((kind != prev) | (kind == NUMBER) | first[:n])
        breaks = np.flatnonzero(fresh | (kind == SPACE) | first[:n])
        opens = np.flatnonzero(fresh[breaks])
        self.starts, self.ends = self._contractions(breaks[opens], np.append(breaks, n)[opens + 1], kind)
        # rows of no length share an offset with the next: the last of them is meant
        self.row = np.searchsorted(self.at, self.starts, side="right") - 1
        self.short = np.flatnonzero(self.ends - self.starts <= LONG)
        self.long = np.flatnonzero(self.ends - self.starts > LONG)
        self.hash = np.zeros(len(self.starts), np.uint64)
        if len(self.starts):
            self.hash = range_hashes(c.mix(low.astype(np.uint64) + np.uint64(77)), self.starts, self.ends)

    def _contractions(self, starts, ends, kind):
        """'s 't 'm 'd 're 've 'll, where the apostrophe stands alone, take letters from the next pre-token."""
        if len(starts) < 2:
            return starts, ends
        lone = np.flatnonzero((self.points[starts[:-1]] == APOSTROPHE) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (kind[starts[1:]] == LETTER))
        if not len(lone):
            return starts, ends
        row = np.searchsorted(self.at, starts, side="right")
        starts, ends = starts.copy(), ends.copy()
        gone = np.zeros(len(starts), bool)
        for i in lone.tolist():
            if row[i] != row[i + 1]:
                continue
            a, n = starts[i + 1], ends[i + 1] - starts[i + 1]
            two = "".join(map(chr, self.points[a : a + min(2, n)]))
            take = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if take:
                ends[i] += take
                starts[i + 1] += take
                gone[i + 1] = take == n
        return starts[~gone], ends[~gone]

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.points.astype("<u4").tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def _tokenizer(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class WordBpe:
    """Ids of texts, equal to the library's without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.words = path, _tokenizer(path)
        self.words.normalizer = normalizers.Sequence([])  # pre-tokens are taken as they are: lower case can leave the normal form
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        steps = [x["type"] for x in (self.spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (self.spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != NORMALIZERS or splits[:1] != [PATTERN] or not self.spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path} is no vocabulary of words with end marks")
        self.specials = [x["content"] for x in self.spec["added_tokens"]]
        self.code = Points(self.words)
        self.reset()

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The whole library, for texts that are taken apart; a worker that meets none does without."""
        return _tokenizer(self.path)

    def reset(self) -> None:
        self.table, self.ids = HashTable(MOST_WORDS), Flat(np.int32)

    @property
    def store(self) -> Flat:
        """What is remembered of a pre-token."""
        return self.ids

    def learn(self, words: list[str]) -> None:
        """Encode new pre-tokens."""
        found = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        self.ids.add(np.array([len(x) for x in found], np.int64), np.array([y for x in found for y in x], np.int32))

    def gather(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """What is remembered of the short pre-tokens of a block, joined, and the lengths.

        At most MOST_WORDS pre-tokens are looked up at once, so they fit the
        memory after a reset, and their values are taken before the next ones
        may cause another.
        """
        parts = [self._gather(block, block.short[lo : lo + MOST_WORDS]) for lo in range(0, len(block.short), MOST_WORDS)]
        if not parts:
            return self.store.data[:0], np.zeros(0, np.int64)
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))

    def _gather(self, block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = block.hash[which]
        index = self.table.get(hashes)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new = missing[np.unique(hashes[missing], return_index=True)[1]]
            if self.store.n + len(new) > MOST_WORDS or self.store.size > MOST_VALUES:
                self.reset()
                new = np.unique(hashes, return_index=True)[1]
            start = self.store.n
            self.learn(block.strings(which[new]))
            self.table.put(hashes[new], np.arange(start, start + len(new), dtype=np.int32))
            index = self.table.get(hashes)
        return self.store.take(index)  # only now: a reset has changed the store

    def decoded(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of a block, row offsets in them, and the rows that hold special tokens or are not in normal form."""
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        raw = data.tobytes()
        cp, rows = code_points(raw.decode("utf-8")), heads[at]
        special, composed = (np.zeros(len(at) - 1, bool) for _ in range(2))
        self.code.learn(cp)
        for s in self.specials:
            if (s := s.encode()) in raw:
                special |= [s in raw[a:b] for a, b in zip(at[:-1], at[1:])]
        odd = np.flatnonzero(self.code.composes[cp])
        for r in np.unique(np.searchsorted(rows, odd, side="right") - 1).tolist():
            text = raw[at[r] : at[r + 1]].decode("utf-8")
            composed[r] = self.code.nfc(text) != text
        return cp, rows, special, composed

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of a block."""
        cp, rows, special, composed = self.decoded(data, at)
        odd = special | composed
        block = Block(self.code, cp, rows, odd)
        flat, length = self.gather(block)
        if len(block.long):
            longs = [np.array(e.ids, np.int32) for e in self.words.encode_batch_fast(block.strings(block.long), add_special_tokens=False)]
            sizes = np.zeros(len(block.starts), np.int64)
            sizes[block.short], sizes[block.long] = length, [len(x) for x in longs]
            first = np.cumsum(sizes) - sizes
            every = np.zeros(int(sizes.sum()), np.int32)
            every[joined(first[block.short], length)] = flat
            every[joined(first[block.long], sizes[block.long])] = np.concatenate(longs)
            flat, length = every, sizes
        sums = np.concatenate(([0], np.cumsum(length)))
        cut = sums[np.searchsorted(block.row, np.arange(len(at)))]
        out = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for r in np.flatnonzero(odd):
            text = data[at[r] : at[r + 1]].tobytes().decode("utf-8")
            out[r] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Answers on boundaries that are kept; bytes of a word that is counted along with others, and of words at once.
MOST_PAIRS, AT_ONCE, LEARN_BYTES = 1 << 20, 32, 1 << 19


class PrefixCounts(WordBpe):
    """Exact token counts of every prefix."""

    def __init__(self, path: str):
        super().__init__(path)
        self._load()

    def reset(self) -> None:
        self.table = HashTable(MOST_WORDS)
        self.counts = Flat(np.uint32)  # for each code point of a pre-token, the tokens of the pre-token up to it

    @property
    def store(self) -> Flat:
        return self.counts

    def _load(self) -> None:
        model, alphabet = self.spec["model"], _byte_alphabet()
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        n = max(vocab.values()) + 1
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a single symbol
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs, ranks, made = [], [], []
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            pairs.append(x << 20 | y)
            ranks.append(r)
            made.append(z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.merges = HashTable(len(pairs))
        keys = c.mix(np.array(pairs, np.uint64)) | np.uint64(1)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("hashes of merges collide")
        self.merges.put(keys, np.array(ranks, np.int32))
        strings: dict[bytes, list[int]] = {}
        alive = self._alive(np.array(made, np.int64), n)
        for token, i in vocab.items():
            last = token.endswith(mark) and token != mark
            text = token[: -len(mark)] if last else token
            if alive[i] and all(ch in alphabet for ch in text) and text:
                strings.setdefault(bytes(alphabet[ch] for ch in text), [-1, -1])[last] = i
        # tokens of up to 32 bytes; word_bpe vocabularies have few longer ones, which are kept in a wider table
        self.longest = max(map(len, strings))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum([len(s) for s in strings])
        starts = np.concatenate(([0], ends[:-1]))
        keys = range_hashes(c.BYTE_VALUES[0][flat], starts, ends)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("hashes of tokens collide")
        self.tokens = HashTable(len(keys))
        self.tokens.put(keys, np.arange(len(keys), dtype=np.int32))
        both = np.array([*strings.values(), [-1, -1]], np.int64)  # the last row: no such token
        self.inner, self.final = both[:, 0], both[:, 1]
        self.by_length = np.bincount(ends - starts, minlength=self.longest + 1)
        self.automaton = ahocorasick.Automaton()
        for s, (inner, final) in strings.items():
            self.automaton.add_word(s.decode("latin-1"), (len(s), inner, final))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.one_by_one = dict(zip(pairs, ranks)), self.rank.tolist(), self.left.tolist(), self.right.tolist()

    def _alive(self, made: np.ndarray, n: int) -> np.ndarray:
        """Tokens that merging their own text gives."""
        alive = np.ones(n, bool)
        order = np.unique(made)
        order = order[np.argsort(self.rank[order])]
        safe = self.stable(self.left[order], self.right[order], self.rank[order])
        for z, ok in zip(order.tolist(), safe.tolist()):
            alive[z] = ok and alive[self.left[z]] and alive[self.right[z]]
        return alive

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        got = self.merges.get(c.mix(x.astype(np.uint64) << np.uint64(20) | y.astype(np.uint64)) | np.uint64(1)).astype(np.int64)
        return np.where(got < 0, np.int64(1 << 40), got)

    def stable(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the boundary between adjacent tokens x and y (before rank `until`).

        Merges are undone, latest first: the two symbols at the boundary exist
        together until the earlier of their own next merges. They merge if their
        rank is below that one, or equal to it when the undone merge lies to the
        right, as equal merges go from left to right.
        """
        ok = np.ones(len(x), bool)
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), 1 << 39, np.int64) if until is None else until.copy()
        ties = np.zeros(len(x), bool)
        todo = np.arange(len(x))
        while len(todo):
            r = self.pair_rank(x, y)
            bad = (r < limit) | (ties & (r == limit))
            ok[todo[bad]] = False
            cx, cy = self.rank[x], self.rank[y]
            go = ~bad & ((cx >= 0) | (cy >= 0))
            todo, x, y, cx, cy = todo[go], x[go], y[go], cx[go], cy[go]
            ties = cy >= cx
            limit = np.where(ties, cy, cx)
            x, y = np.where(ties, x, self.right[x]), np.where(ties, self.left[y], y)
        return ok

    def word_counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For every byte of the words, the tokens of the word that ends there; and the offsets of the words."""
        length = np.array([len(w) for w in words], np.int64)
        at = np.concatenate(([0], np.cumsum(length)))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(c.BYTE_VALUES[0][data] * c.powers(BASE, n), out=sums[1:])
        back = c.powers(np.uint64(pow(int(BASE), -1, 2**64)), n + 1)
        depth = np.arange(n) - np.repeat(at[:-1], length) + 1
        found = np.full((self.longest + 1, n), -1, np.int32)
        for d in range(1, min(self.longest, int(depth.max())) + 1):
            if self.by_length[d]:
                p = np.flatnonzero(depth >= d)
                found[d, p] = self.tokens.get(c.mix((sums[p + 1] - sums[p + 1 - d]) * back[p + 1 - d] + np.uint64(d)) | np.uint64(1))
        last, inside, ended = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(1, int(length.max()) + 1):
            p = at[:-1][length >= i] + i - 1
            sizes = np.flatnonzero((found[: min(i, self.longest) + 1, p] >= 0).any(axis=1))[::-1].tolist()  # of tokens that end here
            for table, out in ((self.inner, inside), (self.final, ended)):
                open_ = p
                for d in sizes:
                    if not len(open_):
                        break
                    t = table[found[d, open_]]
                    have = np.flatnonzero(t >= 0)
                    if not len(have):
                        continue
                    q, t = open_[have], t[have]
                    if d < i:
                        before = last[q - d]
                        fits = (before >= 0) & self.stable(np.maximum(before, 0), t)
                        out[q[fits]] = inside[q[fits] - d] + 1
                    else:
                        fits = np.ones(len(q), bool)
                        out[q] = 1
                    if table is self.inner:
                        last[q[fits]] = t[fits]
                    keep = np.ones(len(open_), bool)
                    keep[have[fits]] = False
                    open_ = open_[keep]
        return ended, at

    def long_word(self, word: bytes) -> tuple[np.ndarray, list[int], list[int]]:
        """For every byte of one word: the tokens of a word that ends there, and the last token and the count if it goes on.

        The same programme as word_counts, a byte at a time; the candidates at a
        byte come from an automaton over all tokens, longest first.
        """
        n = len(word)
        ended, last, inside = [0] * n, [-1] * n, [0] * n
        self._extend(word.decode("latin-1"), 0, ended, last, inside)
        return np.array(ended, np.int64), last, inside

    def _extend(self, text: str, done: int, ended: list[int], last: list[int], inside: list[int]) -> None:
        """Fill the lists from byte `done` on."""
        memo = self.pairs
        if len(memo) > MOST_PAIRS:
            memo.clear()
        for end, (d, inner, final) in self.automaton.iter(text):
            if end < done:
                continue
            before = end - d
            if inner >= 0 and last[end] < 0:
                if before < 0:
                    last[end], inside[end] = inner, 1
                elif (p := last[before]) >= 0:
                    ok = memo.get(p << 20 | inner)
                    if ok is None:
                        ok = memo[p << 20 | inner] = self.one_stable(p, inner)
                    if ok:
                        last[end], inside[end] = inner, inside[before] + 1
            if final >= 0 and not ended[end]:
                if before < 0:
                    ended[end] = 1
                elif (p := last[before]) >= 0:
                    ok = memo.get(p << 20 | final)
                    if ok is None:
                        ok = memo[p << 20 | final] = self.one_stable(p, final)
                    if ok:
                        ended[end] = inside[before] + 1

    def one_stable(self, x: int, y: int) -> bool:
        """stable of one pair."""
        merges, ranks, left, right = self.one_by_one
        limit, tie = 1 << 39, False
        while True:
            r = merges.get(x << 20 | y, 1 << 40)
            if r < limit or tie and r == limit:
                return False
            a, b = ranks[x], ranks[y]
            if a < 0 and b < 0:
                return True
            tie = b >= a
            if tie:
                limit, y = b, left[y]
            else:
                limit, x = a, right[x]

    def learn(self, words: list[str]) -> None:
        """Prefix counts of new pre-tokens."""
        raw = [w.encode() for w in words]
        at = np.concatenate(([0], np.cumsum([len(w) for w in raw])))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ended = np.zeros(len(data), np.int64)
        wide = [i for i, w in enumerate(raw) if len(w) > AT_ONCE]
        for i in wide:
            ended[at[i] : at[i + 1]] = self.long_word(raw[i])[0]
        some, size = [], 0
        for i, w in enumerate(raw):  # a bounded number of bytes at once
            if len(w) <= AT_ONCE:
                some.append(i)
                size += len(w)
            if some and (size > LEARN_BYTES or i == len(raw) - 1):
                found, ends = self.word_counts([raw[j] for j in some])
                ended[joined(at[some], np.diff(ends))] = found
                some, size = [], 0
        # a code point ends before a byte that begins one, or at the end of the word
        lasts = np.flatnonzero(np.append((data[1:] & 0xC0) != 0x80, True))
        counts = ended[lasts].astype(np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        place = np.cumsum(size) - size
        for i, w in enumerate(words):
            if w[0] == "'" and w[1:] in ("re", "ve", "ll"):  # a shorter prefix of these is an apostrophe and a letter
                counts[place[i] + 1] = 1 + self._count(w[1])
        self.counts.add(size, counts)

    def _count(self, text: str) -> int:
        return len(self.words.encode(text, add_special_tokens=False).ids)

    def _totals(self, block: Block) -> tuple[np.ndarray, np.ndarray, dict[int, tuple]]:
        """For each lower-case code point of a block: the tokens up to it, the tokens of pre-tokens that end there or before; the long words."""
        n = len(block.points)
        counts, base, span, longs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), {}
        flat, length = self.gather(block)
        if len(length):
            where = joined(block.starts[block.short], length)
            counts[where], span[where] = flat, True
            base[block.ends[block.short] - 1] = flat[np.cumsum(length) - 1]
        for i, word in zip(block.long.tolist(), block.strings(block.long)):
            raw = word.encode()
            ended, last, inside = self.long_word(raw)
            data = np.frombuffer(raw, np.uint8)
            lasts = np.flatnonzero(np.append((data[1:] & 0xC0) != 0x80, True))
            a, b = block.starts[i], block.ends[i]
            counts[a:b], span[a:b] = ended[lasts], True
            base[b - 1] = ended[-1]
            longs[int(a)] = (raw, lasts, ended, last, inside)
        closed = np.cumsum(base)
        return np.where(span, closed - base + counts, closed), closed, longs

    def prefix_block(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each row of a block, the tokens of its first 0, 1, 2, ... code points."""
        cp, rows, special, composed = self.decoded(data, at)
        block = Block(self.code, cp, rows, special | composed)
        total, closed, _ = self._totals(block)
        total = total[block.last]
        begin = np.concatenate(([0], closed))[block.at[:-1]]
        out = []
        for a, b, less in zip(rows[:-1].tolist(), rows[1:].tolist(), begin.tolist()):
            row = np.zeros(b - a + 1, np.int64)
            row[1:] = total[a:b] - less
            out.append(row)
        for r in np.flatnonzero(special | composed):
            text = data[at[r] : at[r + 1]].tobytes().decode("utf-8")
            out[r] = self.special_prefixes(text) if special[r] else self.composed_prefixes(text)
        return out

    def special_prefixes(self, text: str) -> np.ndarray:
        """The same for a text with special tokens: an unfinished one is ordinary text, a finished one counts 1 and starts anew."""
        places = sorted((i, s) for s in self.specials for i in _finds(text, s))
        cuts = [0, *(i + len(s) for i, s in places)]
        parts = [text[lo : i + len(s) - 1] for lo, (i, s) in zip(cuts, places)] + [text[cuts[-1] :]]
        raw = [p.encode() for p in parts]
        rows = self.prefix_block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(x) for x in raw)]))
        out, done = np.zeros(len(text) + 1, np.int64), 0
        for lo, row, (i, _) in zip(cuts, rows, [*places, (len(text), "")]):
            out[lo : lo + len(row)] = done + row
            done += int(row[i - lo]) + 1
        return out

    def composed_prefixes(self, text: str) -> np.ndarray:
        """The same for one text without special tokens, in normal form or not.

        A text falls into segments: a code point that joins nothing before it,
        and those after it that may. The normal form is that of the segments in
        turn, so where a segment ends the normal form's own prefix counts hold.
        Inside a segment the prefix is the normal form up to it and a few other
        code points, which are counted from the last pre-tokens on.
        """
        cp = code_points(text)
        self.code.learn(cp)
        joins = self.code.composes[cp]
        edges = np.diff(np.concatenate(([0], joins.astype(np.int8), [0])))
        form, inside = [], []  # pieces of the normal form; (prefix, normal form before its segment, its own end)
        ends = np.arange(len(cp) + 1)  # the normal form's length where a segment ends
        done = shift = 0
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            a = max(0, a - 1)
            whole = self.code.nfc(text[a:b])
            form += [text[done:a], whole]
            at = a + shift
            ends[done : a + 1] += shift
            for j in range(a + 1, b):
                part = self.code.nfc(text[a:j])
                if whole.startswith(part):
                    ends[j] = at + len(part)
                else:
                    ends[j] = at  # put right below
                    inside.append((j, at, part))
            shift += len(whole) - (b - a)
            done = b
        form.append(text[done:])
        ends[done:] += shift
        form = "".join(form)
        block = Block(self.code, code_points(form), np.array([0, len(form)]))
        total, closed, longs = self._totals(block)
        counts = np.concatenate(([0], total[block.last]))
        out = counts[ends]
        lows = block.points.astype("<u4").tobytes().decode("utf-32-le") if inside else ""
        ask, base, which = [], [], []
        for j, at, part in inside:
            low = self.code.lower(part)
            end = int(block.last[at - 1]) + 1 if at else 0  # in lower case
            i = int(np.searchsorted(block.starts, end)) - 1  # the last pre-token that begins before
            if i < 0 or block.ends[i] < end:  # white space or nothing before
                start = end
            else:
                start = int(block.starts[i])
                if end - start > LONG:
                    out[j] = self._branch(longs[start], end - start, low, int(closed[start - 1]) if start else 0)
                    continue
                if i and block.ends[i - 1] == start and start - block.starts[i - 1] <= LONG:
                    start = int(block.starts[i - 1])  # an apostrophe before could take its letters
            ask.append(lows[start:end] + low)
            base.append(int(closed[start - 1]) if start else 0)
            which.append(j)
        for lo in range(0, len(ask), 1024):
            out[which[lo : lo + 1024]] = np.array(base[lo : lo + 1024]) + self._counts(ask[lo : lo + 1024])
        return out

    def _counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts that are taken as they are, without the normal form."""
        cps = [code_points(x) for x in texts]
        block = Block(self.code, np.concatenate(cps), np.cumsum([0, *(len(x) for x in cps)]))
        closed = np.concatenate(([0], self._totals(block)[1]))
        return np.diff(closed[block.at])

    def _branch(self, word: tuple, n: int, more: str, base: int) -> int:
        """Tokens up to n code points of a long word and some other code points after them."""
        raw, lasts, ended, last, inside = word
        cps = code_points(more)
        self.code.learn(cps)
        kind = self.code.kind[code_points(raw[: int(lasts[0]) + 1].decode())[0]]
        k = next((i for i, x in enumerate(cps) if self.code.kind[x] != kind), len(cps))
        stop = int(lasts[n - 1]) + 1
        head = int(ended[stop - 1])
        if k:
            lo, extra = max(0, stop - self.longest - 1), more[:k].encode()  # no token that ends later begins before lo
            found, none = [0] * (stop - lo + len(extra)), [0] * len(extra)
            self._extend((raw[lo:stop] + extra).decode("latin-1"), stop - lo, found, last[lo:stop] + [-1] * len(extra), inside[lo:stop] + none)
            head = found[-1]
        return base + head + (int(self._counts([more[k:]])[0]) if k < len(more) else 0)


def _finds(text: str, part: str) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + len(part))
    return out
