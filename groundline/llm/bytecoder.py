"""Byte-level BPE encoding and decoding of whole texts.

A text is cut at single blanks into units, whose ids do not depend on their neighbours; each
distinct unit is cut into the pattern's matches, each distinct match is merged by the segment
tree of ``bpe``, and both are remembered, in tables of bounded size.

Which code points are letters or digits is what the library says: Python's tables, the pattern
module's and the library's are of different Unicode versions.

Defined cases: null is the empty text, which has no ids. Ids may be null or equal; repeated rows
are each returned. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import merge_many, rank_pairs, read_ranks

#: Entries after which a memo starts anew; a bound on memory, not on what is encoded.
MEMO = 300_000
#: Longer units are not remembered.
LONG = 128
#: Signs that often end a word; each is a match of its own after letters.
_STOPS = frozenset(".,;:!?")


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """Looked up for planes 0 to 3 and 14; 4 to 13 are empty, and the last two for private use."""
    out = np.ones(sys.maxunicode + 1, bool)
    out[0xF0000:] = False
    for start, stop in ((0, 0x40000), (0xE0000, 0xF0000)):
        out[start:stop] = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(start, stop)), bool, stop - start)
    return out


def holds_newer(text: str) -> bool:
    """Are there code points of which Python's Unicode knows nothing?"""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")  # all assigned, and quickly told
    except UnicodeEncodeError:
        return bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())
    return False


def cut_at_blanks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units, the unit number at each place, and each text's first place (and the end)."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), offsets - offsets[0]


class Units:
    """Texts -> ids, by way of distinct units. ``coded`` gives the ids of new pieces as bytes,
    ``newer`` cuts texts with code points that Python does not know as the library does."""

    def __init__(self, pattern: str, coded: Callable[[list[str]], list[bytes]], newer: Callable[[str], list[str]]):
        matches = regex.compile(pattern).findall
        self.findall = lambda x: newer(x) if holds_newer(x) else matches(x)
        self.coded = coded
        self.after: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's ids start (and the end)."""
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        units, at, offsets = cut_at_blanks(texts)
        if len(self.after) + len(units) > MEMO:
            self.after = {}
        known = self.after
        new = [u for u in units if u not in known]
        # A unit that is empty or ends in white space may form a match with the next one.
        apart = [u for u in new if u and not u[-1].isspace()]
        known.update(dict.fromkeys(new))
        known.update(zip(apart, self._values([" " + u for u in apart]), strict=True))
        values = list(map(known.__getitem__, units))
        joins = np.fromiter((v is None for v in values), bool, len(values))
        first, many = offsets[:-1], np.diff(offsets) > 1
        lead = [units[k] for k in at[first]]
        open_start = np.fromiter((not u or u[-1].isspace() for u in lead), bool, len(lead))
        at_joins = joins[at]
        at_joins[first] = False
        whole = many & (open_start | np.logical_or.reduceat(at_joins, first))
        again = np.flatnonzero(whole)
        for n in again:
            lead[n] = texts[int(n)].as_py()
            at[offsets[n] : offsets[n + 1]] = len(units) + len(lead)
        at[first] = len(units) + np.arange(len(lead))
        values += [*self._values(lead), b""]
        values = [v or b"" for v in values]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.cumsum(each)
        out = ids[np.repeat(starts[at] - (ends - each), each) + np.arange(ends[-1])]
        for u in [u for u in new if len(u) > LONG]:
            del known[u]
        return out, np.append(0, ends)[offsets]

    def _values(self, texts: list[str]) -> list[bytes]:
        """The values of texts, by the pattern's matches; letters after a blank are one match."""
        if len(self.pieces) > MEMO:
            self.pieces = {}
        known, findall = self.pieces, self.findall
        cut = [(x[:-1], x[-1]) if x[-1:] in _STOPS and x[1:-1].isalpha() and x[0] == " " else (x,) if x[1:].isalpha() and x[0] == " " else findall(x) for x in texts]
        new = [m for m in set().union(*cut) if m not in known]
        known.update(zip(new, self.coded(new), strict=True))
        get = known.__getitem__
        out = [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]
        for m in [m for m in new if len(m) > LONG]:
            del known[m]
        return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, and their decoding."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = rank_pairs(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = {v: k for k, v in self.ranks.items()}
        self.units = Units(pattern, self._coded, self._newer)
        self.spans = regex.compile(pattern).finditer
        self.stands: dict[int, str] = {}

    def _newer(self, text: str) -> list[str]:
        """The matches in a text of stand-ins: one of its class, by the library, for each newer code point."""
        for c in set(text):
            if ord(c) not in self.stands and holds_newer(c):
                self.stands[ord(c)] = next((s for kind, s in (("L", "é"), ("N", "٣")) if library_matches(rf"\p{{{kind}}}", c)), "\ue000")
        return [text[m.start() : m.end()] for m in self.spans(text.translate(self.stands))]

    def _coded(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        hard = []
        for n, b in enumerate(raw):
            rank = self.ranks.get(b)
            if rank is None:
                hard.append(n)
            else:
                out[n] = rank.to_bytes(4, "little")
        words = [self.single[np.frombuffer(raw[n], np.uint8)] for n in hard]
        for n, ids in zip(hard, merge_many(words, self.pairs), strict=True):
            out[n] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        ids, at = self.units.texts(texts)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def library_matches(pattern: str, text: str) -> bool:
    return bool(_matcher(pattern).encode_ordinary(text))


@lru_cache(maxsize=4)
def _matcher(pattern: str):
    import tiktoken

    return tiktoken.Encoding("matches", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process, as its tables take a while to build."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of some megabytes at a time, a longer text alone; null texts as empty ones."""
    gc.disable()  # millions of strings and no cycles; a reused worker collects again afterwards
    try:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            if not len(texts):
                continue
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            group = ends // size
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.column(0).slice(a, b - a), texts.slice(a, b - a)
    finally:
        gc.enable()


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary) and the bytes decoded from them."""
    return _mapped(docs, path, pattern, doc_id, text, False)


def digest_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _mapped(docs, path, pattern, doc_id, text, True)


def _mapped(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for keys, texts in slices(batches):
            ids = own.encode(texts)
            decoded = [own.decode(x) for x in ids]
            if digests:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, decoded), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, decoded binary"
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(run, schema)
