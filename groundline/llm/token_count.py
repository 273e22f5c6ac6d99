"""Token counts by finite-state transduction, for a lower-casing BPE with word ends.

Two deterministic transducers. The splitter reads one character class at a time over seven
states and marks where pre-tokens start. The counter reads bytes and is compiled from the
merges: its transitions carry the number of tokens that a byte adds to the encoding of what was
read of the pre-token, which is negative where tokens merge; a pre-token's last byte is a symbol
of its own, and leads back to rest. A transition is compiled when it is first read.

Both read chunks side by side, and what happens in a chunk is a map from entry to exit state.
The splitter's maps are composed by a parallel prefix scan in logarithmically many rounds. A
chunk in which a pre-token ends maps every entry state to one exit state; so entry states follow
from a prefix maximum over such chunks, and only chunks within one long pre-token follow each
other.

How the merges become transitions: the encoding of a prefix is that of a shorter prefix and one
token more, the longest one that may follow the shorter prefix's last token. Two tokens may be
neighbours if no merge across their border comes before those that made them. A state holds, for
each suffix of what was read that begins some token, its place in the tree of tokens, the last
token before it, and how many tokens ago that was.

Defined cases: null counts as the empty text, which has no tokens. Special strings inside a text
count as one token each, as the library's default has it. Ids may be null or equal; repeated
rows are each returned. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bytecoder import slices

# Character classes; those of NEW are asked of the library, whose Unicode is newer than Python's.
SPACE, LETTER, DIGIT, OTHER, QUOTE, E, L, R, V, ENDING, NEW = range(11)
# States: nothing open; in letters; in symbols; after an opening quote; after 'r, 'v, 'l.
IDLE, WORD, SIGNS, QUOTED, QR, QV, QL = range(7)
START, START_BEFORE = 1, 2
#: Unicode's White_Space, which is not quite Python's.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
CHUNK = 128
#: Symbols of the counter: a byte, the last byte of a pre-token, a byte of white space.
FINAL, BLANK, SYMBOLS = 256, 512, 513
#: Bytes that a lane of the counter reads; lanes below which plain steps are faster.
LANE, FEW = 256, 24
#: Compiled transitions after which the automaton starts anew; a bound on memory, not on what is counted.
TRANSITIONS = 600_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
ENDLESS = 1 << 60


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class.

    The contractions 's 't 'm 'd 're 've 'll come before letter runs, single digits and symbol
    runs, but only where a match begins: not inside a run of symbols.
    """
    step, mark = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, E, L, R, V, ENDING)

    def arc(state: int, cls: int, to: int, emit: int = 0) -> None:
        step[state, cls], mark[state, cls] = to, emit

    for state in range(7):
        opened = START_BEFORE if state in (QR, QV, QL) else 0
        arc(state, SPACE, IDLE, opened)
        arc(state, DIGIT, IDLE, opened | START)
        for c in letters:
            arc(state, c, WORD, 0 if state == WORD else opened or START)
        arc(state, OTHER, SIGNS, 0 if state in (SIGNS, QUOTED) else opened | START)
        arc(state, QUOTE, SIGNS if state in (SIGNS, QUOTED) else QUOTED, 0 if state in (SIGNS, QUOTED) else opened | START)
    arc(QUOTED, ENDING, IDLE)
    arc(QUOTED, R, QR)
    arc(QUOTED, V, QV)
    arc(QUOTED, L, QL)
    arc(QR, E, IDLE)
    arc(QV, E, IDLE)
    arc(QL, L, IDLE)
    return step, mark


def character_classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind == "Cn":
            out[code] = NEW
        elif kind[0] in "LN":
            out[code] = LETTER if kind[0] == "L" else DIGIT
    for chars, cls in ((BLANKS, SPACE), ("'", QUOTE), ("e", E), ("l", L), ("r", R), ("v", V), ("stmd", ENDING)):
        out[[ord(c) for c in chars]] = cls
    return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Prefixes of state maps (chunk, entry state) -> exit state, under composition."""
    out, by = maps, 1
    while by < len(out):
        out = np.concatenate((out[:by], np.take_along_axis(out[by:], out[:-by], 1)))
        by *= 2
    return out


class Splitter:
    def __init__(self) -> None:
        self.step, self.mark = compile_splitter()

    def starts(self, cls: np.ndarray) -> np.ndarray:
        """Does a pre-token start at this character; the classes of texts that end in a blank."""
        n = len(cls)
        padded = np.full(-(-n // CHUNK) * CHUNK, SPACE, np.uint8)
        padded[:n] = cls
        chunks = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
        step, mark = self.step.ravel(), self.mark.ravel()
        maps = np.repeat(np.arange(7, dtype=np.uint8), chunks.shape[1]).reshape(7, -1)
        for t in range(CHUNK):
            maps = step[maps * 10 + chunks[t]]
        state = np.concatenate(([IDLE], scan_maps(maps.T)[:-1, IDLE])).astype(np.uint8)
        marks = np.empty_like(chunks)
        for t in range(CHUNK):
            at = state * 10 + chunks[t]
            marks[t], state = mark[at], step[at]
        marks = marks.T.reshape(-1)[:n]
        start = (marks & START) > 0
        start[:-1] |= (marks[1:] & START_BEFORE) > 0
        return start


class Merges:
    """The vocabulary as a tree of symbols, and which tokens may be neighbours."""

    def __init__(self, tokens: list[tuple[int, ...]], merges: list[tuple[int, int, int]]):
        """``tokens``: symbols of each token; ``merges``: (left, right, merged) by rank."""
        self.rank = {a << 32 | b: n for n, (a, b, _) in enumerate(merges)}
        self.made = {t: (a, b, n) for n, (a, b, t) in enumerate(merges)}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [False]
        self.known: dict[int, bool] = {}
        for t, symbols in enumerate(tokens):
            if not self.encodes_itself(t):
                continue
            node = 0
            for s in symbols:
                to = self.child.get(node * SYMBOLS + s)
                if to is None:
                    self.inner[node] = True
                    to = self.child[node * SYMBOLS + s] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = t

    def spine(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        """The token and the parts at its left (0) or right (1) end, each with the rank of the merge that ends it."""
        out = [(token, until)]
        while token in self.made:
            *ends, rank = self.made[token]
            token = ends[side]
            out.append((token, rank))
        return out

    def border_holds(self, left: int, right: int, until: int) -> bool:
        """No merge across the border comes before ``until`` and before its parts merge away from
        it. Of equal pairs the one further left merges first."""
        others = self.spine(right, 0, until)
        for a, end_a in self.spine(left, 1, until):
            for b, end_b in others:
                rank = self.rank.get(a << 32 | b)
                if rank is not None and rank < end_a and rank <= end_b and rank < until:
                    return False
        return True

    def encodes_itself(self, token: int) -> bool:
        if token not in self.made:
            return True
        a, b, rank = self.made[token]
        return self.border_holds(a, b, rank) and self.encodes_itself(a) and self.encodes_itself(b)

    def neighbours(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (found := self.known.get(key)) is None:
            found = self.known[key] = self.border_holds(left, right, ENDLESS)
        return found


Entry = tuple[int, int, int]  # place in the tree, last token before it (-1: none), tokens up to it less those up to here


class Automaton:
    """The compiled counter: (state, symbol) -> (state, tokens added). State 0 rests."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[Entry, ...]] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}
        self.fresh: list[int] = []
        self.bits = 12
        self._rebuild()

    def _rebuild(self) -> None:
        size = 1 << self.bits
        self.keys, self.to, self.adds = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self._insert(list(self.arcs))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: list[int]) -> None:
        if not keys:
            return
        own, new = np.array(keys, np.int64), np.array([self.arcs[k] for k in keys], np.int64)
        at, left = self._slots(own), np.arange(len(own))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            slots, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slots], self.to[slots], self.adds[slots] = own[put], new[put, 0], new[put, 1]
            left = left[self.keys[at[left]] != own[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def arc(self, key: int) -> tuple[int, int]:
        """The transition of state * SYMBOLS + symbol, compiled at need."""
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self.compiled(*divmod(key, SYMBOLS))
            self.fresh.append(key)
        return found

    def settle(self) -> None:
        """Puts what was compiled since into the arrays."""
        if 3 * len(self.arcs) > len(self.keys):
            self.bits = (4 * len(self.arcs)).bit_length()
            self._rebuild()
        else:
            self._insert(self.fresh)
        self.fresh = []

    def compiled(self, state: int, symbol: int) -> tuple[int, int]:
        if symbol == BLANK:
            return 0, 0
        m, last, adds, kept = self.merges, -1, 0, []
        for node, before, since in self.states[state]:
            to = m.child.get(node * SYMBOLS + symbol)
            if to is None:
                continue
            if last < 0 and (t := m.token[to]) >= 0 and (before < 0 or m.neighbours(before, t)):
                last, adds = t, since + 1
            if m.inner[to]:
                kept.append((to, before, since))
        if symbol >= FINAL:
            return 0, adds
        entries = (*((to, before, since - adds) for to, before, since in kept), (0, last, 0))
        number = self.number.setdefault(entries, len(self.states))
        if number == len(self.states):
            self.states.append(entries)
        return number, adds

    def walk(self, state: int, symbols: list[int]) -> tuple[int, list[int]]:
        out = []
        for s in symbols:
            state, adds = self.arc(state * SYMBOLS + s)
            out.append(adds)
        return state, out

    def lock_step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and added tokens of lanes that read ``symbols`` (step, lane)."""
        adds = np.empty(symbols.shape, np.int16)
        state = state.astype(np.int64)
        for t in range(len(symbols)):
            key = state * SYMBOLS + symbols[t]
            at = self._slots(key)
            if (miss := np.flatnonzero(self.keys[at] != key)).size:
                at = self._found(key, at, miss)
            state = self.to[at].astype(np.int64)
            adds[t] = self.adds[at]
        return state, adds

    def _found(self, key: np.ndarray, at: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """Slots of all keys: probe on, and compile what is in no slot."""
        while miss.size:
            there = self.keys[at[miss]]
            if (there == -1).any():
                for k in np.unique(key[miss[there == -1]]).tolist():
                    self.arc(k)
                self.settle()
                at = self._slots(key)
                miss = np.flatnonzero(self.keys[at] != key)
            miss = miss[self.keys[at[miss]] != key[miss]]
            at[miss] = (at[miss] + 1) & (len(self.keys) - 1)
            miss = miss[self.keys[at[miss]] != key[miss]]
        return at

    def added(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens added at each symbol; before the first one the automaton rests."""
        n = len(symbols)
        lanes = -(-n // LANE)
        padded = np.full(lanes * LANE, BLANK, np.int64)
        padded[:n] = symbols
        rows = padded.reshape(lanes, LANE)
        resets = rows >= FINAL
        constant = resets.any(1)
        head = np.where(constant, resets.argmax(1) + 1, LANE)
        head[0] = 0
        in_head = np.arange(LANE) < head[:, None]
        # Every lane from rest, its head skipped: the exit states of all constant maps.
        leave, adds = self.lock_step(np.zeros(lanes, np.int64), np.ascontiguousarray(np.where(in_head, BLANK, rows).T))
        adds = np.ascontiguousarray(adds.T)
        constant[0] = True
        # Entry states: from the lane before where its map is constant, else along the lanes of one pre-token.
        enter = np.append(0, leave[:-1])
        known = np.append(True, constant[:-1])
        self._heads(np.flatnonzero(known & (head > 0)), rows, head, enter, leave, adds, constant)
        for lane in np.flatnonzero(~known).tolist():
            enter[lane] = leave[lane - 1]
            self._heads(np.array([lane]), rows, head, enter, leave, adds, constant)
        return adds.reshape(-1)[:n]

    def _heads(self, lanes: np.ndarray, rows: np.ndarray, head: np.ndarray, enter: np.ndarray, leave: np.ndarray, adds: np.ndarray, constant: np.ndarray) -> None:
        """Reads the heads of these lanes, whose entry states are known; sets the exit states of lanes that are all head."""
        order = lanes[np.argsort(-head[lanes], kind="stable")]
        state, t = enter[order].astype(np.int64), 0
        while len(order) >= FEW:
            state, new = self.lock_step(state, rows[order, t][None])
            adds[order, t] = new[0]
            t += 1
            done = head[order] <= t
            full = order[done & ~constant[order]]
            leave[full] = state[done & ~constant[order]]
            order, state = order[~done], state[~done]
        for lane, s in zip(order.tolist(), state.tolist(), strict=True):
            end, new = self.walk(s, rows[lane, t : head[lane]].tolist())
            adds[lane, t : head[lane]] = new
            if not constant[lane]:
                leave[lane] = end


class Counter:
    """The counter of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library = path, None
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = sorted((x["content"] for x in spec["added_tokens"] if x["special"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        tokens: list[tuple[int, ...]] = [()] * (max(vocab.values()) + 1)
        for text, t in vocab.items():
            if text not in special:
                inner = [byte[c] for c in text.removesuffix(suffix)]
                tokens[t] = (*inner[:-1], inner[-1] + FINAL * text.endswith(suffix))
        merges = Merges(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.automaton, self.splitter, self.classes = Automaton(merges), Splitter(), character_classes()

    def _library(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if (self.classes[np.frombuffer(text.encode("utf-32-le"), "<u4")] == NEW).any():
            return self._library().normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # the library knows no final sigma

    def classified(self, codes: np.ndarray) -> np.ndarray:
        cls = self.classes[codes]
        if (cls == NEW).any():
            split = self._library().pre_tokenizer.pre_tokenize_str
            cls = cls.copy()
            for code in np.unique(codes[cls == NEW]).tolist():
                c = chr(code)
                # One run of letters, or two digits, or two signs between letters.
                kind = LETTER if len(split(f"a{c}a")) == 1 else DIGIT if len(split(c + c)) == 2 else OTHER
                cls[codes == code] = kind
        return cls

    def count(self, texts: pa.Array) -> np.ndarray:
        if len(self.automaton.arcs) > TRANSITIONS:
            self.automaton.clear()
            self.automaton.merges.known.clear()
        every, extra = texts.to_pylist(), np.zeros(len(texts), np.int64)
        for n, x in enumerate(every):
            parts = self.special.split(x) if self.special and "<" in x else [x]
            extra[n] = len(parts) - 1
            every[n] = " ".join(map(self.normal, parts)) + " "
        if not len(every):
            return extra
        raw, ends = "".join(every).encode(), np.cumsum([len(x.encode()) for x in every])
        first = np.frombuffer(raw, "u1")
        at = np.flatnonzero((first & 0xC0) != 0x80)  # first byte of each character
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        cls = self.classified(codes)
        start = self.splitter.starts(cls)
        blank = cls == SPACE
        symbols = first.astype(np.int64)
        symbols[at[blank]] = BLANK
        if len(at) < len(first):  # bytes of wide blanks that follow their first one
            wide = np.repeat(blank, np.diff(np.append(at, len(first))))
            symbols[wide] = BLANK
        last = at[1:][(start | blank)[1:] & ~blank[:-1]] - 1
        symbols[last] += FINAL
        sums = np.append(0, np.cumsum(self.automaton.added(symbols), dtype=np.int64))
        return extra + np.diff(sums[np.append(0, ends)])


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_documents(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for keys, texts in slices(batches):
            n = own.count(texts)
            yield pa.RecordBatch.from_arrays([keys, pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
