"""Secret scan: fixed patterns, and a character convolutional network over every other candidate.

A candidate is any run of twelve or more credential characters. The network (embedding, one
convolution, max pooling, logistic output; numpy only) reads the candidate and its surrounding
characters, of a long one overlapping pieces; the highest output counts. Its labelled findings
owe nothing to the patterns. Secrets are credentials of known forms, written into places drawn
from the documents. Harmless are look-alikes written there likewise, and the documents' own
candidates that read like their short words: nearly all their letter triples occur in those.
Candidates of which neither is known teach nothing. Outputs are calibrated on held-out findings,
and the threshold is the highest that keeps the required recall there. The network reads every
candidate that the patterns' spans do not cover whole, and its spans are added whole, over a
pattern's span in their midst as well; the patterns' spans always stay as they are.

Defined cases: null counts as the empty text, without findings. Spans count code points, end
exclusive. Very long texts are read whole, long runs in overlapping pieces. Ids may be null or equal; repeated rows are each returned. An empty table gives an
empty one, and a network taught by credentials and look-alikes alone. Other columns are ignored,
or kept where secrets are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecoder import slices
from .common import give_back

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, so that asking for the length in the pattern drops the same runs.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
KINDS = ("assign", "access", "hex", "network")
BEFORE, INSIDE, AFTER = 24, 40, 16
WIDTH = BEFORE + INSIDE + AFTER
#: Bounds of the training sample (documents, excerpts of each, characters of these, candidates),
#: credentials and look-alikes that are written, and the recall that the threshold must keep.
SAMPLE_DOCS, EXCERPTS, EXCERPT, SAMPLE_FINDINGS, WRITTEN, RECALL = 2000, 3, 240, 6000, 5000, 0.98
#: Share of a candidate's letter triples that short words have too, if it reads like words.
WORDLIKE = 0.9
#: Plain words that are long enough to be candidates, or become so with a prefix.
LONG_WORDS = """administration announcement appreciation approximately architecture championship characteristics
 circumstances collaboration communication comprehensive concentration configuration congratulations consciousness
 consequently considerable constitution construction contemporary contributions demonstration determination development
 disappointed discrimination distinguished documentation effectiveness encyclopedia enthusiastic entertainment
 environmental establishment extraordinary functionality fundamentally headquarters identification implementation
 independence infrastructure institutional international interpretation investigation manufacturing mathematical
 misunderstanding neighborhood nevertheless notwithstanding opportunities organizations participation particularly
 photographer possibilities predominantly professional psychological pharmaceutical recommendations relationships
 representative responsibility revolutionary significantly sophisticated specifications straightforward
 subsequently successfully surroundings sustainability technologies telecommunications temperature thoughtfulness
 traditionally transformation transportation understanding unfortunately universities vulnerability worthwhile""".split()
Span = tuple[int, int, int]  # kind, start, end


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[Span]:
    out: list[Span] = []
    if assign:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if access:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hexes:
        out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def frames(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate, or overlapping pieces of a long one that hold all its characters."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in (*range(start, end - INSIDE, INSIDE // 2), end - INSIDE)]


def uncovered(found: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """Those of the ordered ``found`` that do not lie wholly in what the spans cover; one pass over both."""
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, k = [], 0
    for start, end in found:
        while k < len(merged) and merged[k][1] <= start:
            k += 1
        if k == len(merged) or start < merged[k][0] or merged[k][1] < end:
            out.append((start, end))
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a fixed frame: before, the candidate or a piece of it, after. Those of the
    candidate are raised by 128, so that the network sees where it lies."""
    inside = text[start : min(end, start + INSIDE)]
    frame = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    codes = np.frombuffer(frame.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(codes < 128, codes, 1)
    codes[BEFORE : BEFORE + len(inside)] += 128
    return codes


class Network:
    def __init__(self, embed: int = 8, filters: int = 24, reach: int = 5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.reach = reach
        self.p = {
            "e": rng.normal(0, 0.5, (256, embed)),
            "k": rng.normal(0, (2 / (embed * reach)) ** 0.5, (embed * reach, filters)),
            "b": np.zeros(filters),
            "w": rng.normal(0, 0.2, filters),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        emb = self.p["e"][x]
        cols = np.concatenate([emb[:, i : x.shape[1] - self.reach + 1 + i] for i in range(self.reach)], 2)
        act = cols @ self.p["k"] + self.p["b"]
        at = act.argmax(1)
        top = np.take_along_axis(act, at[:, None], 1)[:, 0]
        hid = np.maximum(top, 0)
        return cols, at, top, hid, hid @ self.p["w"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.empty(0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xs, ys = x[rows], y[rows]
                cols, at, top, hid, z = self._forward(xs)
                dz = (1 / (1 + np.exp(-z)) - ys) / len(rows)
                dh = dz[:, None] * self.p["w"] * (top > 0)
                picked = cols[np.arange(len(rows))[:, None], at]  # row, filter, input
                dk = np.einsum("nf,nfd->df", dh, picked)
                dcol = dh[:, :, None] * self.p["k"].T  # row, filter, input
                size = self.p["e"].shape[1]
                de = np.zeros_like(self.p["e"])
                for r in range(self.reach):
                    np.add.at(de, np.take_along_axis(xs, at + r, 1).ravel(), dcol[:, :, r * size : (r + 1) * size].reshape(-1, size))
                step += 1
                for k, g in (("e", de), ("k", dk), ("b", dh.sum(0)), ("w", hid.T @ dz), ("c", np.array([dz.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold of at least this recall."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
            w = p * (1 - p)
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            s = np.linalg.solve(h, g)
            a, b = a - s[0], b - s[1]
            if np.abs(s).max() < 1e-6:
                break
        self.scale, self.shift = float(a), float(b)
        hits = np.sort(self.chance(x)[y > 0.5])
        self.threshold = float(hits[int((1 - recall) * len(hits))]) if len(hits) else 0.5

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))


def generated(n: int, seed: int = 5, places: list[tuple[str, str]] | None = None, forms: tuple[int, ...] | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): credentials (of these ``forms`` only) and look-alikes that are
    none, in turn, each between the two halves of one of the ``places`` of a text."""
    rng = random.Random(seed)
    alnum, lower = string.ascii_letters + string.digits, string.ascii_lowercase

    def some(chars: str, a: int, b: int) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))

    def word() -> str:
        return some(lower, 2, 9)

    def spoken() -> str:
        return "".join(rng.choice(("b", "c", "d", "f", "g", "l", "m", "n", "p", "r", "s", "t", "v", "st", "tr", "pl", "th")) + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s", "l")) for _ in range(rng.randint(2, 4)))

    def long() -> str:
        return rng.choice(("inter", "over", "counter", "trans", "under", "")) + rng.choice(("", "multi", "re")) + rng.choice(LONG_WORDS)

    secret = (
        lambda: some(alnum, 20, 44),
        lambda: some(lower + string.digits, 24, 44),
        lambda: some(alnum + "+/", 27, 60) + "=",
        lambda: rng.choice(("ghp_", "sk_live_", "pk_", "xoxb-", "glpat-")) + some(alnum, 20, 40),
        lambda: "eyJ" + some(alnum, 20, 40) + "." + some(alnum + "_-", 20, 40),
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 14, 18),
        lambda: some("0123456789abcdef", 20, 64),
        lambda: some(string.ascii_letters, 12, 44),
        lambda: some(alnum, 12, 20),
        lambda: some(lower, 20, 44),
    )
    plain = (
        lambda: f"{word()}.{rng.randint(1, 99)}",
        lambda: f"{word()}{rng.randint(1, 9)}.{rng.choice(('com', 'org', 'net'))}/{word()}",
        lambda: f"{rng.randint(1900, 2040)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: f"{word()}_{word()}_{rng.randint(0, 9)}",
        lambda: f"{word()}/{word()}/{word()}{rng.randint(1, 20)}.{rng.choice(('txt', 'html', 'py'))}",
        lambda: f"555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: "".join(rng.choice(string.digits) for _ in range(rng.randint(12, 15))),
        lambda: word() + word() + str(rng.randint(1, 99)),
        lambda: "-" * rng.randint(8, 20) + str(rng.randint(1, 9)),
        lambda: rng.choice("-=._/") * rng.randint(12, 60),
        long,
        lambda: long().capitalize() + rng.choice((".", "", "...")),
        lambda: rng.choice("-_/.").join(rng.choice((long, spoken))() for _ in range(rng.randint(2, 4))),
        lambda: "".join(rng.choice((long, spoken))().capitalize() for _ in range(rng.randint(2, 3))),
        lambda: spoken() + spoken(),
        lambda: (spoken() + spoken()).upper(),
    )
    out = []
    for i in range(n):
        make = rng.choice([secret[k] for k in forms] if i % 2 and forms else secret if i % 2 else plain)
        body = make()
        while len(body) < 12:
            body = body + rng.choice(string.digits) if i % 2 else spoken() + body
        before, after = rng.choice(places) if places else (" ".join(word() for _ in range(rng.randint(0, 5))), " ".join(word() for _ in range(rng.randint(0, 4))))
        lead, tail = before + rng.choice((" ", " ", " ", "\n", ": ", '="', " = ", " (")), rng.choice((" ", " ", ". ", '" ', "\n", ", ", ") ")) + after
        out.append((lead + body + tail, len(lead), len(lead) + len(body), i % 2))
    return out


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], list[bytes]]:
    """Excerpts and windows of candidates of a bounded sample of documents; any place of a text may be drawn."""
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    ids = rows.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct().collect()
    if not ids:
        return [], []
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in ids], "doc_id long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            out: list[tuple[int, int, bool, bytes]] = []
            for x, key in zip(texts.to_pylist(), keys.to_pylist(), strict=True):
                for k in range(EXCERPTS):
                    at = random.Random(f"{key} {k} {len(x)}").randrange(max(1, len(x) - EXCERPT))
                    out.append((key, at, True, x[at : at + EXCERPT].encode()))
                for c in candidates(x):
                    for a, b in sorted({frames(*c)[0], frames(*c)[-1]}):  # a long run must not outweigh others
                        out.append((key, a, False, window(x, a, b).astype("u1").tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["doc_id", "at", "excerpt", "data"])

    drawn = rows.join(chosen, "doc_id", "left_semi").mapInArrow(run, "doc_id long, at long, excerpt boolean, data binary")
    least = lambda some, n: drawn.where(some).orderBy(F.xxhash64("doc_id", "at", "data"), "doc_id", "at").limit(n).collect()
    excerpts = [bytes(r.data).decode() for r in least("excerpt", SAMPLE_DOCS * EXCERPTS)]
    return excerpts, [bytes(r.data) for r in least("not excerpt", SAMPLE_FINDINGS)]


def triples(word: str) -> set[str]:
    return {f"^{word}$"[k : k + 3] for k in range(len(word))}


def short_words(excerpts: list[str]) -> set[str]:
    """Letter triples of words that are too short to be candidates, in two excerpts at least."""
    once: set[str] = set()
    twice: set[str] = set()
    for x in excerpts:
        own = set().union(*(triples(w) for w in re.findall("[a-z]{1,11}", " ".join(x.lower().split()[1:-1]))), set())
        twice |= own & once
        once |= own
    return twice


def wordlike(win: bytes, known: set[str]) -> bool:
    """Does the candidate in a window read like the documents' words? Few digits, and known triples."""
    inside = bytes(c - 128 for c in win if c >= 128).decode("ascii")
    own = [t for w in re.findall("[a-z]+", inside.lower()) for t in sorted(triples(w)) if t.isalpha()]
    return sum(c.isdigit() for c in inside) <= 3 and len(own) >= 5 and sum(t in known for t in own) >= WORDLIKE * len(own)


def in_capitals(win: bytes) -> bytes:
    return bytes(c - 32 if chr(c & 127).islower() else c for c in win)


def places_of(excerpts: list[str]) -> list[tuple[str, str]]:
    """Texts before and after some blanks of the excerpts."""
    out = []
    for x in excerpts:
        blanks = [m.start() for m in re.finditer(r"\s", x)]
        out += [(x[:at], x[at + 1 :]) for at in blanks[3:-3:7]]
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forms: tuple[int, ...] | None = None) -> Network:
    excerpts, found = sample(docs, doc_id, text)
    known = short_words(excerpts)
    own = [w for w in found if wordlike(w, known)]
    data = [(w, 0) for w in (*own, *map(in_capitals, own[::5]))]
    data += [(window(t, a, b).astype("u1").tobytes(), y) for t, *c, y in generated(WRITTEN, places=places_of(excerpts), forms=forms) for a, b in frames(*c)]
    x = np.array([np.frombuffer(w, "u1") for w, _ in data], np.int64)
    y = np.array([v for _, v in data], np.float64)
    rest = np.random.default_rng(3).random(len(x)) < 0.3
    net = Network()
    net.train(x[~rest], y[~rest])
    net.calibrate(x[rest], y[rest])
    return net


def scan_text(text: str, net: Network, assign: bool, access: bool, hexes: bool, runs: bool) -> list[Span]:
    """All spans, by start, then kind."""
    base = base_spans(text, assign, access, hexes)
    if runs:
        free = uncovered(candidates(text), base)
        pieces = [(n, *f) for n, c in enumerate(free) for f in frames(*c)]
        highest = np.zeros(len(free))
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            np.maximum.at(highest, [n for n, _, _ in part], net.chance(np.array([window(text, a, b) for _, a, b in part])))
        base = base + [(3, a, b) for (a, b), p in zip(free, highest, strict=True) if p >= net.threshold]
    return sorted(base, key=lambda s: (s[1], s[0]))


def scan_texts(texts: pa.Array, net: Network) -> list[list[Span]]:
    """Texts that linear-time filters show to hold nothing are not looked at any more."""
    mask = lambda pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    assign = mask("(?i)passw|passwd|secret|token|api_?key")
    access = pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
    runs = mask("[A-Za-z0-9+/_.=-]{12}")
    hexes = mask("[0-9a-f]{16}")
    out: list[list[Span]] = [[]] * len(texts)
    for n in np.flatnonzero(assign | access | runs | hexes):
        out[n] = scan_text(texts[int(n)].as_py(), net, bool(assign[n]), bool(access[n]), bool(hexes[n]), bool(runs[n]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(spark: SparkSession, docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_network, base_sha256, spans."""
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            spans = scan_texts(texts, shared.value)
            counts = [[sum(k == kind for k, _, _ in s) for s in spans] for kind in range(4)]
            sha = [hashlib.sha256(joined([x for x in s if x[0] < 3]).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array([joined(s) for s in spans], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_network", "base_sha256", "spans"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_network long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans as one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame, net: Network, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, and ``length`` (a long) set anew in those rows; null texts stay null."""
    shared = spark.sparkContext.broadcast(net)
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            spans = scan_texts(pc.fill_null(texts, ""), shared.value)
            new = [redacted(texts[n].as_py(), s) if s else None for n, s in enumerate(spans)]
            cols = batch.columns
            cols[at] = pc.coalesce(pa.array(new, pa.string()), texts)
            if size is not None:
                cols[size] = pc.coalesce(pa.array([None if x is None else len(x) for x in new], pa.int64()), cols[size])
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
