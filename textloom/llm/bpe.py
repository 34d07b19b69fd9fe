"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

A token sequence is what the merges give for a piece exactly if each adjacent pair of tokens is what they give for
the pair's own bytes. So a transducer can read the piece byte by byte, keeping every token that is still open in a
byte trie, and accept a token only after a token with which it makes such a pair. One hypothesis for each open start
remains; what all of them have in common is emitted at once, so the lookahead is bounded by the longest token. The
subsets of hypotheses are the states of the deterministic transducer, which is built only where texts lead.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import ByteHash, slices, text_bytes

#: Marks that are a piece of their own at the end of a word.
_MARKS = (".", ",", ";", ":", "!", "?")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class HashTable:
    """int64 keys, not negative, to int64 values, not negative; whole arrays are looked up at once."""

    def __init__(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def add(self, key: int, value: int) -> None:
        at, mask = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - self.bits, (1 << self.bits) - 1
        while self.keys[at] >= 0 and self.keys[at] != key:
            at = at + 1 & mask
        self.keys[at], self.values[at] = key, value
        self.n += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add_many(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that aren't there yet."""
        at, open_, mask = self._home(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(open_):
            free = open_[self.keys[at[open_]] < 0]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            own = self.keys[at[open_]] == keys[open_]
            self.values[at[open_[own]]] = values[open_[own]]
            open_ = open_[~own]
            at[open_] = at[open_] + 1 & mask
        self.n += len(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        mask, at = (1 << self.bits) - 1, self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Transducer:
    """Encodes pieces. States and pair checks are made on demand and forgotten beyond a bound.

    A state is the set of its hypotheses, one for each start that is still open: the last token before that start and
    the trie node of the bytes since. Each transition emits the one token that, read up to here, would end the piece;
    the token before it ends where it begins, so the sequence is read off backwards from any place that all
    hypotheses share.
    """

    STATES, MOVES, PAIRS = 250_000, 1_000_000, 150_000
    #: Pieces longer than this go byte by byte; so many bytes are held back before certain tokens are looked for.
    LONG, HELD = 64, 4096
    NEVER = 1 << 60
    _NODE = 20

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.first, self.depth = [0], [0]
        for token, rank in ranks.items():
            node = 0
            self.sizes[rank] = len(token)
            for depth, byte in enumerate(token):
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.first.append(token[0])
                    self.depth.append(depth + 1)
                node = after
            self.ends[node] = rank
        if len(self.children) >> self._NODE:
            raise ValueError("the vocabulary's trie is too large")
        # the least rank of a token of two bytes or more on the way to a node or below it: when what begins so can first grow
        self.grows, self.way = [self.NEVER] * len(self.children), [self.NEVER] * len(self.children)
        for node in range(len(self.children) - 1, 0, -1):  # children have higher numbers
            for after in self.children[node].values():
                self.grows[node] = min(self.grows[node], self.grows[after], self.ends[after] if self.ends[after] >= 0 else self.NEVER)
        for node, children in enumerate(self.children):
            for after in children.values():
                if node:
                    on_way = self.way[node] if self.ends[after] < 0 else min(self.way[node], self.ends[after])
                    self.way[after] = on_way
                    self.grows[after] = min(self.grows[after], on_way)
        self.split: dict[int, tuple[int, int] | None] = {}
        self.valid: dict[int, bool] = {}
        self.joins: dict[int, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]  # hypotheses: (last token + 1) << 20 | node
        self.numbers = {(0,): 0}
        self.moves = HashTable(21)

    def merged(self, piece: bytes, least: int = 1) -> list[int]:
        """The merges themselves, lowest rank first and leftmost on ties, down to `least` parts: used on single tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte and for a token that no merge reaches."""
        if token not in self.split:
            parts = self.merged(self.tokens[token], 2)
            self.split[token] = tuple(parts) if len(parts) == 2 and self.ranks.get(self.tokens[token]) == token else None
        return self.split[token]

    def reached(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def follows(self, last: int, token: int) -> bool:
        """Whether the merges leave these two side by side.

        Until something merges across their border, each is built as it would be alone; so what touches the border
        is a right part of the one and a left part of the other, and these grow in the order of their ranks. At equal
        ranks the merge further left comes first: the left token's own, then the one across.
        """
        if last < 0:
            return self.reached(token)
        key = last << 20 | token
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) >= self.PAIRS:
                self.valid.clear()
            known = self.valid[key] = self.reached(token) and self._apart(last, token)
        return known

    def _apart(self, last: int, token: int) -> bool:
        never = 1 << 60
        left, right = [last], [token]
        while (h := self.halves(left[-1])) is not None:
            left.append(h[1])
        while (h := self.halves(right[-1])) is not None:
            right.append(h[0])
        while True:
            across = self.ranks.get(self.tokens[left[-1]] + self.tokens[right[-1]], never)
            grows_left = left[-2] if len(left) > 1 else never
            grows_right = right[-2] if len(right) > 1 else never
            if across < grows_left and across <= grows_right:
                return False
            if len(left) == len(right) == 1:
                return True
            if grows_left <= grows_right:
                left.pop()
            else:
                right.pop()

    def crossing(self, last: int, byte: int) -> int:
        """The rank at which a token's end merges with this byte, if the byte hasn't merged with what follows by then."""
        if last < 0:
            return self.NEVER
        key = last << 8 | byte
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) >= self.PAIRS:
                self.joins.clear()
            right = [last]
            while (h := self.halves(right[-1])) is not None:
                right.append(h[1])
            known, single = self.NEVER, self.tokens[self.ranks[bytes([byte])]]
            while right:
                part = right.pop()
                across = self.ranks.get(self.tokens[part] + single, self.NEVER)
                if across < (right[-1] if right else self.NEVER):
                    known = across
                    break
            self.joins[key] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        """One new transition: next state << 20 | token that ends here.

        Tokens that would begin at a border which merges before they can grow are given up at once.
        """
        live, token = [], -1
        children, mask = self.children, (1 << self._NODE) - 1
        for hypothesis in self.states[state]:
            after = children[hypothesis & mask].get(byte)
            if after is None:
                continue
            last = (hypothesis >> self._NODE) - 1
            if token < 0 and (end := self.ends[after]) >= 0 and self.follows(last, end):
                token = end
            if children[after] and self.grows[after] < self.crossing(last, self.first[after]):
                live.append(last + 1 << self._NODE | after)
        if token < 0:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        live.append(token + 1 << self._NODE)
        key = tuple(live)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        move = number << 20 | token
        self.moves.add(state << 8 | byte, move)
        return move

    def _step(self, states: np.ndarray, read: np.ndarray) -> np.ndarray:
        """The transitions of many states, those that are new made first."""
        keys = states << 8 | read
        out = self.moves.get(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            some, at = np.unique(keys[new], return_inverse=True)
            out[new] = np.array([self._move(k >> 8, k & 255) for k in some.tolist()], np.int64)[at]
        return out

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all pieces, how many each has). Pieces step through the transducer side by side."""
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for start in range(0, len(pieces), 32_768):
            if len(self.states) > self.STATES or self.moves.n > self.MOVES:
                self._forget()
            ids, n = self._block(pieces[start : start + 32_768])
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)

    def _block(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.zeros(len(data), np.int64)  # the token that ends at each byte
        used = np.zeros(len(data), bool)
        for k in np.flatnonzero(lengths > self.LONG).tolist():
            at = int(begins[k])
            for token in self.stream(pieces[k]):
                at += int(self.sizes[token])
                ends[at - 1], used[at - 1] = token, True
        order = np.argsort(-lengths, kind="stable")
        order = order[(lengths[order] <= self.LONG) & (lengths[order] > 0)]
        sizes, first = lengths[order], begins[order]
        states = np.zeros(len(order), np.int64)
        for at in range(int(sizes[0]) if len(order) else 0):
            n = int(np.searchsorted(-sizes, -at))  # pieces that are longer
            move = self._step(states[:n], data[first[:n] + at])
            states[:n] = move >> 20
            ends[first[:n] + at] = move & 0xFFFFF
        at = first + sizes - 1
        while len(at):
            used[at] = True
            before = at - self.sizes[ends[at]]
            open_ = before >= first
            at, first = before[open_], first[open_]
        total = np.append(0, np.cumsum(used))
        return ends[used].astype(np.int32), total[begins + lengths] - total[begins]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The ids of one piece, byte by byte in bounded memory: a token is emitted once all open hypotheses share it."""
        state, ends, begin, n = 0, [], 0, 0  # ends[k]: the token that ends at byte begin + k
        mask = (1 << self._NODE) - 1
        for byte in data:
            move = int(self.moves.get(np.array([state << 8 | byte]))[0])
            if move < 0:
                if len(self.states) > self.STATES or self.moves.n > self.MOVES:
                    kept = self.states[state]
                    self._forget()
                    state = self.numbers.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                move = self._move(state, byte)
            state = move >> 20
            ends.append(move & 0xFFFFF)
            n += 1
            if len(ends) >= self.HELD and len(ends) % self.HELD == 0:
                chains = [self._chain(ends, n - begin - self.depth[h & mask]) for h in self.states[state]]
                certain = max(set(chains[0]).intersection(*chains[1:]), default=0)
                yield from self._read(ends, certain)
                ends, begin = ends[certain:], begin + certain
        yield from self._read(ends, len(ends))

    def _chain(self, ends: list[int], place: int) -> list[int]:
        """The borders of the sequence that ends at a place."""
        out = [place]
        while place > 0:
            place -= int(self.sizes[ends[place - 1]])
            out.append(place)
        return out

    def _read(self, ends: list[int], place: int) -> list[int]:
        return [ends[p - 1] for p in reversed(self._chain(ends, place)[:-1])]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.encode_many([piece])[0].tolist()


#: White space that isn't ASCII; no space beside it is taken for the end of a part.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Parts:
    """The ids of texts from those of their parts, the stretches between single spaces.

    No piece of the pattern reaches across a single space between other characters. A part is known by two 64-bit
    hashes of its bytes; the ids of parts seen before are gathered from one array, and make() is asked for the others
    of a whole list of texts at once. What is remembered is bounded, and begun anew beyond that. Texts with white
    space that isn't ASCII go to make() whole.
    """

    BITS, IDS = 21, 6_000_000
    LONGEST = 256

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        """make: (ids of all given strings, how many each has)."""
        self.make, self.hash, self.check = make, ByteHash(31, lower=False), ByteHash(32, lower=False)
        self._forget()

    def _forget(self) -> None:
        self.table = HashTable(self.BITS)
        self.checks = np.zeros(1 << self.BITS, np.uint64)
        self.place, self.size = np.zeros(1 << self.BITS, np.int32), np.zeros(1 << self.BITS, np.int32)
        self.ids, self.used = np.zeros(self.IDS, np.int32), 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all texts, where each text's begin and the last's end)."""
        odd = pc.match_substring_regex(texts.fill_null(""), _WIDE_SPACE.pattern).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        ids, stops = self._plain(plain)
        if not odd.any():
            return ids, stops
        made, sizes = self.make(texts.filter(pa.array(odd)).to_pylist())
        own, wide, plain_k = [], iter(np.split(made, np.cumsum(sizes)[:-1])), 0
        for is_odd in odd.tolist():
            if is_odd:
                own.append(next(wide))
            else:
                own.append(ids[stops[plain_k] : stops[plain_k + 1]])
                plain_k += 1
        return np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own]))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        blank = _BLANK[data]
        begin_of = np.zeros(n, bool)
        begin_of[offsets[:-1][offsets[:-1] < n]] = True
        space = data == 32
        space[1:] &= ~blank[:-1]
        space[:-1] &= ~blank[1:]
        space &= ~begin_of
        last = offsets[1:][offsets[1:] > 0] - 1
        space[last] = False
        # each safe space begins a part; it is told apart from a text's first part by its first byte
        begins = np.flatnonzero(space | begin_of)
        ends = np.append(begins[1:], n)
        keys = (self.hash(data, begins, ends) >> np.uint64(1)).view(np.int64)
        checks = self.check(data, begins, ends)
        found = self.table.get(keys)
        new = np.flatnonzero((found < 0) | (self.checks[found] != checks))
        if len(new):
            if self.table.n + len(new) > (1 << self.BITS) * 0.6 or self.used > self.IDS * 0.8:
                self._forget()
                found[:] = -1
                new = np.arange(len(keys))
            _, first, at = np.unique(checks[new], return_index=True, return_inverse=True)
            asked = new[first]
            raw = data.tobytes()
            made, sizes = self.make([raw[a:b].decode() for a, b in zip(begins[asked].tolist(), ends[asked].tolist(), strict=True)])
            place = np.cumsum(sizes) - sizes
            # a key that is there already (with another check), is new twice, or too long, is used once
            _, once = np.unique(keys[asked], return_index=True)
            fresh = np.zeros(len(asked), bool)
            fresh[once] = True
            kept = np.flatnonzero(fresh & (self.table.get(keys[asked]) < 0) & (ends[asked] - begins[asked] <= self.LONGEST))
            kept = kept[(self.used + np.cumsum(sizes[kept]) <= self.IDS) & (np.arange(len(kept)) + self.table.n < (1 << self.BITS) * 0.7)]
            rows = self.table.n + np.arange(len(kept))
            self.table.add_many(keys[asked[kept]], rows)
            stops = self.used + np.cumsum(sizes[kept])
            self.checks[rows], self.size[rows], self.place[rows] = checks[asked[kept]], sizes[kept], stops - sizes[kept]
            if len(kept):
                kept_ids = np.arange(int(stops[-1]) - self.used) + np.repeat(place[kept] - (stops - sizes[kept] - self.used), sizes[kept])
                self.ids[self.used : int(stops[-1])] = made[kept_ids]
                self.used = int(stops[-1])
            number = np.full(len(asked), -1)
            number[kept] = rows
            found[new] = number[at]
            left = np.flatnonzero(found < 0)
            of_new = np.zeros(len(keys), np.int64)
            of_new[new] = at
        size, start = self.size[found].astype(np.int64), self.place[found].astype(np.int64)
        source = self.ids[: self.used]
        if len(new) and len(left):
            size[left], start[left] = sizes[of_new[left]], self.used + place[of_new[left]]
            source = np.concatenate([source, made])
        stops = np.cumsum(size)
        total = int(stops[-1])
        ids = source[np.arange(total) + np.repeat(start - (stops - size), size)]
        of_text = np.append(0, stops)[np.searchsorted(begins, offsets)]
        return ids, of_text


class Encoder:
    """Encodes texts: splits them by the pattern and sends each match through the transducer.

    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s of the pattern means Unicode White_Space, without the separators U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.transducer = Transducer(ranks)
        get = ranks.get
        self.whole = lambda piece: get(piece, -1)
        self.cuts = " ?" in pattern and r"\s+(?!\S)" in pattern
        #: runs of letters are pieces of their own, with the space before them
        self.letters = r" ?\p{L}+|" in pattern
        self.parts = Parts(self._made)

    def _made(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, stops, letters, split = [], [], self.letters, self.pattern.findall
        for part in parts:
            if letters and part[1:].isalpha() and part[0] == " ":
                pieces.append(part)
            elif letters and part[-1:] in _MARKS and part[1:-1].isalpha() and part[0] == " ":
                pieces += (part[:-1], part[-1])
            else:
                pieces += split(part)
            stops.append(len(pieces))
        numbers: dict[str, int] = {}
        at = np.fromiter((numbers.setdefault(p, len(numbers)) for p in pieces), np.int64, len(pieces))
        some = [p.encode() for p in numbers]
        whole = np.fromiter(map(self.whole, some), np.int64, len(some))
        open_ = np.flatnonzero(whole < 0)
        made, counts = self.transducer.encode_many([some[k] for k in open_.tolist()])
        place, size = np.arange(len(some)), np.ones(len(some), np.int64)
        place[open_], size[open_] = len(some) + np.cumsum(counts) - counts, counts
        source = np.concatenate([whole.astype(np.int32), made])
        sizes = size[at]
        ends = np.cumsum(sizes)
        ids = source[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(place[at] - (ends - sizes), sizes)]
        stops = np.append(0, ends)[np.array(stops, np.int64)]
        return ids, np.diff(stops, prepend=0)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all texts, where each text's begin and the last's end); none for a null or empty text."""
        if self.cuts:
            return self.parts.encode(texts)
        ids, sizes = self._made(texts.fill_null("").to_pylist())
        return ids, np.append(0, np.cumsum(sizes))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_texts(pa.array([text], pa.string()))[0]


class Utf8Stream:
    """Incremental UTF-8: bytes in, text out, with an unfinished character held back until its rest arrives.

    The state is (bytes still wanted, range of the next one). Ill-formed bytes become U+FFFD as a text decoder
    would put it.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end are the valid start of an unfinished character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need, low, high = (2, 0x80, 0xBF) if 0xC2 <= lead <= 0xDF else (3, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF) if 0xE0 <= lead <= 0xEF else (4, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF) if 0xF0 <= lead <= 0xF4 else (1, 0, 0)
            if need <= back or back > 1 and not low <= data[-back + 1] <= high:
                return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.open_tail(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Streaming decoder: ids in any portions, text as soon as its characters are whole."""

    PORTION = 4096

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def stream(self, portions: Iterable[list[int]]) -> Iterator[str]:
        utf8 = Utf8Stream()
        for ids in portions:
            yield utf8.feed(b"".join(map(self.table.__getitem__, ids)))
        yield utf8.finish()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.stream(ids[k : k + self.PORTION] for k in range(0, len(ids), self.PORTION)))


_MADE: dict = {}


def _once(kind, data: bytes, *more):
    """The object is kept for the life of a Python worker."""
    key = (kind, len(data), hash(data), *more)
    if key not in _MADE:
        _MADE[key] = kind(parse_ranks(data), *more)
        gc.freeze()
    return _MADE[key]


def _rank_bytes(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB


def id_lists(ids: np.ndarray, places: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with a column `ids` (array<int>): the byte-level BPE ids of the column `text`.

    A null text counts as empty and has an empty array. An existing column `ids` is replaced; other columns and
    repeated rows stay as they are. Texts of any length are encoded whole, about a megabyte of rows at a time.

    decoded: the name of a further column with what the decoder makes of the ids. That saves decode() and, for each
    task, a second Python worker; workers change places between tasks, so each of them would hold an encoder in the end.
    """
    data = _rank_bytes(df, ranks_path)
    made = {c.lower() for c in (ids, decoded) if c}
    kept = [c for c in df.columns if c.lower() not in made or c == text]
    source = df.select(*kept)
    names = [c for c in kept if c.lower() not in made]
    schema = T.StructType([*(source.schema[c] for c in names), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, data.value, pattern)
        for batch in batches:
            for begin, count in slices(batch.column(text)):
                part = batch.slice(begin, count)
                lists = id_lists(*encoder.encode_texts(part.column(text)))
                columns = [*(part.column(c) for c in names), lists]
                if decoded:
                    columns.append(_decoded(lists, _once(Decoder, data.value)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def _decoded(column: pa.Array, decoder: Decoder) -> pa.Array:
    """The texts of lists of ids; null for null."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = [0 if n is None else n for n in pc.list_value_length(column).to_pylist()]
    ends = np.cumsum(sizes)
    return pa.array([None if not ok else decoder.decode(flat[e - n : e].tolist()) for ok, n, e in zip(column.is_valid().to_pylist(), sizes, ends, strict=True)], pa.string())


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column `text`: the text of the ids in `ids`; null for null. An existing column `text` is replaced."""
    data = _rank_bytes(df, ranks_path)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return _decoded(column, _once(Decoder, data.value))

    return df.withColumn(text, run(F.col(ids)))


def ids_text(ids: Column) -> Column:
    """The decimal ids, joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
