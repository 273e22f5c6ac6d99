"""Best-fit packing of token sequences by a linear grouping scheme.

1. Every document becomes pieces of at most ``size`` tokens; its first piece may be shorter.
2. Only a histogram of piece lengths (at most ``size`` rows, whatever the corpus) is planned
   on the driver: lengths above ``small`` are sorted, cut into groups of equal cardinality and
   rounded up to the largest of their group; a linear programme finds which configurations of
   these sizes, a few to a sequence, need the fewest sequences; then real lengths take the place
   of the rounded ones, and the short lengths go, longest first, where they fit best.
3. The plan is a list of runs ("so many sequences with these lengths"), never of documents. A
   piece finds its sequence, and its place there, by its length and its ordinal among the pieces
   of that length; ordinals come from counts by (length, salt), with as many salts as a length has
   pieces by ``PART``, dealt out in turn, so that neither a length nor copies of a row are gathered
   in one task.

Defined cases: null counts as the empty text: one piece with the end token only. Ids may be null
or equal: rows are packed each for itself. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .bytecoder import Units, slices
from .common import Scratch, give_back

#: Exchanges of the simplex method at most.
STEPS = 200
#: Pieces of one length that are numbered in one part.
PART = 200_000
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


class LibraryEncoder:
    """Ids as ``tokenizers`` gives them; the same vocabulary's ranks encode new Latin words faster."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        self.units = Units(pattern, self._coded, self._newer)

    def _newer(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def _coded(self, pieces: list[str]) -> list[bytes]:
        one = self.fast._encode_single_piece
        return [array("I", one(p) if max(p) < "ɐ" else self._library(p)).tobytes() for p in pieces]

    def _library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        ids, at = self.units.texts(texts)
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for s in self.special:
            for n in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)):
                out[n] = np.array(self._library(texts[int(n)].as_py()), "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str, ranks_path: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(path, ranks_path, pattern)


def pieces(docs: DataFrame, path: str, ranks_path: str, pattern: str, size: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its turn among those of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail, before = library_encoder(path, ranks_path, pattern), end.to_bytes(4, "little"), 0
        for keys, texts in slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for key, ids in zip(keys.to_pylist(), own.encode(texts), strict=True):
                ids += tail
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + (size if k else n % size or size)
                    rows.append((key, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, k = to, k + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            turn = pa.array(np.arange(before, before + len(rows)))
            before += len(rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), turn], [*PIECE, "turn"])
        give_back()

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, turn long")


Run = tuple[int, tuple[int, ...]]  # so many sequences, each with these lengths


def plan(histogram: dict[int, int], size: int = 1024, groups: int = 512, small: int | None = None) -> list[Run]:
    """Runs that hold every piece of the histogram once.

    The work depends on the number of distinct lengths only, not on how many pieces there are.
    """
    small = size // 4 if small is None else small
    runs: list[Run] = [(n, (size,)) for n in [histogram.get(size, 0)] if n]
    large = sorted(((x, n) for x, n in histogram.items() if small < x < size and n > 0), reverse=True)
    for count, shape in configurations(*rounded_groups(large, groups), size):
        runs += shape_runs(count, shape)
    return fill(runs, {x: n for x, n in histogram.items() if x <= small and n > 0}, size)


def rounded_groups(large: list[tuple[int, int]], groups: int) -> tuple[list[int], dict[int, list[list[int]]]]:
    """Sizes of the groups, largest first, and the real (length, count) stock of each."""
    total = sum(n for _, n in large)
    stock: dict[int, list[list[int]]] = {}
    each, room, top = max(1, -(-total // groups)), 0, 0
    for x, n in large:
        while n:
            if not room:
                room, top = each, x
            take = min(n, room)
            stock.setdefault(top, []).append([x, take])
            room, n = room - take, n - take
    return sorted(stock, reverse=True), stock


def best_configurations(sizes: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[float, np.ndarray]]:
    """(how often, how many of each size): the linear programme of fewest sequences that hold all.

    The simplex method starts from the configurations of ``fullest_first``. Further ones are
    generated: the dual values of the sizes price all configurations at once, by a knapsack over
    the lengths of a sequence, and the one that saves most comes in. It ends where none saves
    anything; where it ends after ``STEPS`` exchanges, what it has holds everything all the same.
    """
    place = {int(s): k for k, s in enumerate(sizes)}
    basis, inverse, most = np.eye(len(sizes)), np.eye(len(sizes)), int(size // sizes.min())

    def exchange(out: int, new: np.ndarray, change: np.ndarray) -> None:
        basis[:, out] = new
        row = inverse[out] / change[out]
        inverse[:] -= np.outer(change, row)
        inverse[out] = row

    for _, shape, gone in fullest_first(sizes.tolist(), dict(zip(sizes.tolist(), demand.tolist(), strict=True)), size):
        new = np.bincount([place[s] for s in shape], minlength=len(sizes)).astype(np.float64)
        change = inverse @ new
        if abs(change[place[gone]]) > 1e-6:
            exchange(place[gone], new, change)
    room = np.arange(size + 1) - sizes[:, None]
    fits, room = room >= 0, np.maximum(room, 0)
    for _ in range(STEPS):
        value = inverse.sum(0)  # the dual value of each size
        best, pick = [np.zeros(size + 1)], []
        for _ in range(most):
            with_one = np.where(fits, value[:, None] + best[-1][room], 0)
            which = with_one.argmax(0)
            top = with_one[which, np.arange(size + 1)]
            pick.append(np.where(top > best[-1], which, -1))
            best.append(np.maximum(top, best[-1]))
        if best[-1][size] <= 1 + 1e-7:
            break
        new, free = np.zeros(len(sizes)), size
        for which in reversed(pick):
            if (i := which[free]) >= 0:
                new[i] += 1
                free -= int(sizes[i])
        often, change = np.maximum(inverse @ demand, 0), inverse @ new
        out = int(np.where(change > 1e-9, often / np.maximum(change, 1e-9), np.inf).argmin())
        exchange(out, new, change)
    often = np.linalg.solve(basis, demand.astype(np.float64))
    return [(float(x), basis[:, k]) for k, x in enumerate(often)]


def fullest_first(sizes: list[int], left: dict[int, int], size: int) -> Iterator[tuple[int, list[int], int]]:
    """(count, shape, the size that stops it): the largest size left opens a configuration, which
    is filled as full as it can be and used as often as the stock allows."""
    while live := [s for s in sizes if left[s]]:
        shape = [live[0]]
        shape += fullest(size - live[0], sorted(live), {s: left[s] - (s == live[0]) for s in live}, 3)
        count, gone = min((left[s] // shape.count(s), s) for s in set(shape))
        for s in shape:
            left[s] -= count
        yield count, shape, gone


def configurations(sizes: list[int], stock: dict[int, list[list[int]]], size: int) -> Iterator[tuple[int, list[list[list[int]]]]]:
    """(count, one stock list a slot): how many sequences take which rounded sizes.

    The programme's configurations are used as often as they go in whole numbers. Of what they
    leave, a few of each size, the fullest come first.
    """
    left = {s: sum(n for _, n in stock[s]) for s in sizes}
    if sizes:
        own = np.array(sizes)
        for often, use in sorted(best_configurations(own, np.array([left[s] for s in sizes]), size), key=lambda c: -c[0]):
            shape = [int(s) for s, n in zip(own, use, strict=True) for _ in range(round(n))]
            if sum(shape) <= size and (count := min([max(0, int(often + 1e-6)), *(left[s] // shape.count(s) for s in set(shape))])):
                for s in shape:
                    left[s] -= count
                yield count, [taken(stock[s], count) for s in shape]
    for count, shape, _ in fullest_first(sizes, left, size):
        yield count, [taken(stock[s], count) for s in shape]


def fullest(room: int, ascending: list[int], left: dict[int, int], depth: int) -> list[int]:
    """Up to ``depth`` sizes whose sum is as near to ``room`` as it can be without passing it."""
    best: list[int] = []
    if not depth:
        return best
    total = 0
    top = bisect.bisect_right(ascending, room)
    for s in reversed(ascending[:top]):
        if s * depth <= total:
            break
        if not left[s]:
            continue
        left[s] -= 1
        own = [s, *fullest(room - s, ascending, left, depth - 1)]
        left[s] += 1
        if sum(own) > total:
            best, total = own, sum(own)
        if total == room:
            break
    return best


def taken(stock: list[list[int]], count: int) -> list[list[int]]:
    """Take ``count`` real lengths off a group's stock."""
    out = []
    while count:
        length, there = stock[0]
        n = min(there, count)
        out.append([length, n])
        count -= n
        stock[0][1] -= n
        if not stock[0][1]:
            stock.pop(0)
    return out


def shape_runs(count: int, slots: list[list[list[int]]]) -> list[Run]:
    """Align the slots' real lengths: a new run wherever one of them changes."""
    out, at = [], [0] * len(slots)
    left = [s[0][1] for s in slots]
    while count:
        n = min(left)
        out.append((n, tuple(s[i][0] for s, i in zip(slots, at, strict=True))))
        count -= n
        for k in range(len(slots)):
            left[k] -= n
            if not left[k] and count:
                at[k] += 1
                left[k] = slots[k][at[k]][1]
    return out


def fill(runs: list[Run], short: dict[int, int], size: int) -> list[Run]:
    """Best fit of what is left, longest first, into the tightest room; new sequences if none is left.

    The rooms are kept by size, each with a stack of runs, so a step places one length in a
    whole run or splits one. Large pieces may also go where real lengths left room.
    """
    rooms: dict[int, list[Run]] = defaultdict(list)
    for n, shape in runs:
        rooms[size - sum(shape)].append((n, shape))
    order = sorted(r for r in rooms if rooms[r])
    for length in sorted(short, reverse=True):
        n = short[length]
        while n:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                per = size // length
                whole, rest = divmod(n, per)
                new = [(whole, (length,) * per)] * bool(whole) + [(1, (length,) * rest)] * bool(rest)
                for run in new:
                    _put(rooms, order, size - sum(run[1]), run)
                break
            room = order[at]
            count, shape = rooms[room].pop()
            per = room // length
            if n >= count * per:
                _put(rooms, order, room - per * length, (count, shape + (length,) * per))
                n -= count * per
            else:
                whole, rest = divmod(n, per)
                if whole:
                    _put(rooms, order, room - per * length, (whole, shape + (length,) * per))
                if rest:
                    _put(rooms, order, room - rest * length, (1, shape + (length,) * rest))
                if (same := count - whole - bool(rest)) > 0:
                    rooms[room].append((same, shape))
                n = 0
            if not rooms[room]:
                order.remove(room)
    return [run for r in sorted(rooms) for run in rooms[r]]


def _put(rooms: dict[int, list[Run]], order: list[int], room: int, run: Run) -> None:
    if not rooms[room]:
        at = bisect.bisect_left(order, room)
        if at == len(order) or order[at] != room:
            order.insert(at, room)
    rooms[room].append(run)


def seats(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ordinals of its intervals, what turns an ordinal into a sequence id, and the offset there."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    used: dict[int, int] = defaultdict(int)
    base = 0
    for count, shape in runs:
        offset = 0
        for length in shape:
            for column, x in zip(out[length], (used[length], base - used[length], offset), strict=True):
                column.append(x)
            used[length] += count
            offset += length
        base += count
    return {x: tuple(map(np.array, columns)) for x, columns in out.items()}


def pack(spark: SparkSession, docs: DataFrame, path: str, ranks_path: str, pattern: str, size: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, path, ranks_path, pattern, size, end, doc_id, text), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # a row a length
    salts = {x: -(-n // PART) for x, n in histogram.items()}
    dealt = F.array(*[F.lit(salts.get(x, 1)) for x in range(size + 1)])
    cut = cut.withColumn("salt", F.pmod("turn", F.get(dealt, F.col("length").cast("int"))).cast("int"))
    before = {x: np.zeros(n + 1, np.int64) for x, n in salts.items()}
    for length, salt, n in cut.groupBy("length", "salt").count().collect():  # a row for every PART pieces, and one a length
        before[length][salt + 1] = n
    before = {x: np.cumsum(v) for x, v in before.items()}
    table = spark.sparkContext.broadcast((before, seats(plan(histogram, size))))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, where = table.value
        for b in batches:
            length, salt, nth = (b.column(n).to_numpy() for n in ("length", "salt", "nth"))
            sequence, offset = np.empty((2, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                x = int(length[rows[0]])
                ordinal = first[x][salt[rows]] + nth[rows] - 1
                starts, shift, places = where[x]
                at = np.searchsorted(starts, ordinal, side="right") - 1
                sequence[rows], offset[rows] = ordinal + shift[at], places[at]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in PIECE), pa.array(sequence), pa.array(offset)], [*PIECE, "sequence_id", "offset"])

    numbered = cut.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, piece, ids_crc32, start) nth")
    return numbered.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
