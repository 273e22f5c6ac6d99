"""Words grouped with their spelling variants: one-edit pairs by merging an errata trie.

1. Runs of letters are counted in whole texts; a task sends each word it met once with its count.
2. The words make a trie. A node is the digest of a prefix, so a word of any length costs as many
   rows as it has characters. Nodes are counted, and each node's heavy child is the one with most
   words below it. All other children, and a word's end, are light. A word lies in at most as many
   light subtrees as the logarithm of the number of words.
3. Light subtrees are merged into what lies beside them, small into large, with one character
   skipped or replaced; where a terminal of the merged subtree coincides with one that is there,
   the two words are one edit apart. With w = p + x + s, where x leaves the heavy path at node p
   whose heavy child is h, the terminals looked up are
   * p + s: x is skipped,
   * p + h + x + s: the heavy character stands before x, as if skipped on the other side,
   * p + h + s: x is replaced by the heavy character;
   light subtrees of one node that replace each other's character meet in the group (p, s), which
   has a word for each character at most.
   Of a run of equal characters only the last is skipped, so every pair is met exactly once.
4. A word's near words are summed up as their number and the best of them; pairs are not kept.
5. Roots follow the forms by doubling. A form has ten times its word's count, so chains are short.

Nodes that hold many words (shallow prefixes, or a stem that a large part of all words share) are
joined by broadcast, all others by their key: no more than ``HOT`` nodes can hold a ``HOT``-th of
all rows each, which bounds both the broadcast and the largest key.

Defined cases: null and empty texts have no words. A null id is the empty string in the hash.
Repeated rows count each. Very long runs are words like any other. Ties of forms go to the
smallest in code-point order. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Nodes that are joined by broadcast at most.
HOT = 20_000
#: Distinct words that a task holds before it sends them on; a bound on memory only.
HELD = 400_000
#: The letters of a run, in UTF-8 after A-Z went to a-z (U+00C0 to U+00FF are C3 80 to C3 BF).
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def counted(docs: DataFrame, least: int, every: int) -> DataFrame:
    """word, n: parts of counts of words of ``least`` code points or more, after the planned deletions."""
    runs = re.compile(LETTER + b"{%d,}" % least)

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for key, text in zip(b.column(0).to_pylist(), texts, strict=True):
                body = text.as_py()
                if not body:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                own = Counter(runs.findall(body.translate(LOWER)))
                for word in own:
                    if (h := zlib.crc32(word, start)) % every == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) > least:
                            held[(letters[:at] + letters[at + 1 :]).encode()] += own[word]
                    else:
                        held[word] += own[word]
                if len(held) >= HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    return docs.mapInArrow(run, "word string, n long")


def steps(words: DataFrame) -> DataFrame:
    """word_key, node, at, next: a row for every prefix of a word, with the character after it ('' at its end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, nodes, ats, nexts = [], [], [], []
            for word, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = hashlib.blake2b(digest_size=16)
                for at, c in enumerate(word):
                    keys.append(key)
                    nodes.append(path.digest())
                    ats.append(at)
                    nexts.append(c)
                    path.update(c.encode())
                keys.append(key)
                nodes.append(path.digest())
                ats.append(len(word))
                nexts.append("")
                if len(keys) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(nodes, pa.binary()), pa.array(ats, pa.int32()), pa.array(nexts, pa.string())], ["word_key", "node", "at", "next"])
                    keys, nodes, ats, nexts = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(nodes, pa.binary()), pa.array(ats, pa.int32()), pa.array(nexts, pa.string())], ["word_key", "node", "at", "next"])

    return words.select("word", "word_key").mapInArrow(run, "word_key binary, node binary, at int, next string")


def light_edges(scratch: Scratch, words: DataFrame) -> DataFrame:
    """word, n, at, heavy: where each word leaves a heavy path, or ends on one."""
    path = scratch.save(steps(words), "steps")
    below = path.where("next <> ''").groupBy("node", "next").agg(F.count("*").alias("c"))
    nodes = below.groupBy("node").agg(F.min_by("next", F.struct(-F.col("c"), "next")).alias("heavy"), F.sum("c").alias("c"))
    nodes = scratch.save(nodes, "nodes")
    total = nodes.agg(F.sum("c")).first()[0] or 0
    hot = F.broadcast(nodes.where(F.col("c") >= max(1, total // HOT)).select("node", "heavy"))  # HOT nodes or few more, see above
    cold = nodes.where(F.col("c") < max(1, total // HOT)).select("node", "heavy")
    off = path.join(hot, "node", "left").withColumnRenamed("heavy", "known")
    off = off.where("known is null or next <> known")
    rest = off.where("known is null").drop("known").join(cold, "node").where("next <> heavy")
    edges = off.where("known is not null").select("word_key", "at", F.col("known").alias("heavy")).unionByName(rest.select("word_key", "at", "heavy"))
    each = edges.groupBy("word_key").agg(F.collect_list(F.struct("at", "heavy")).alias("edges"))  # a logarithm of all words at most
    return words.join(each, "word_key").select("word", "n", F.explode("edges").alias("e")).select("word", "n", "e.*")


def one_edit(scratch: Scratch, words: DataFrame) -> DataFrame:
    """word, c, best (struct of n, word): parts of each word's near words, to be summed."""
    word, heavy = F.col("word"), F.col("heavy")
    edges = scratch.save(light_edges(scratch, words), "edges")
    front, own, rest = F.left(word, F.col("at")), F.substr(word, F.col("at") + 1, F.lit(1)), F.substr(word, F.col("at") + 2)
    a = edges.select("word", "n", front.alias("p"), own.alias("x"), rest.alias("s"), heavy.alias("h"))
    last = (F.col("x") != "") & (F.left("s", F.lit(1)) != F.col("x"))
    merged = F.array(
        F.when(last, F.concat("p", "s")),
        F.concat("p", "h", "x", "s"),
        F.when(F.col("x") != "", F.concat("p", "h", "s")),
    )
    probes = a.select("word", "n", F.explode(merged).alias("other")).where("other is not null")
    met = scratch.save(probes.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"), "met")
    side = lambda w, to, n: met.select(F.col(w).alias("word"), F.lit(1).cast("long").alias("c"), F.struct(F.col(n).alias("n"), F.col(to).alias("word")).alias("best"))
    beside = a.where("x <> ''").groupBy(F.sha2(F.concat("p", F.lit("\n"), "s"), 256).alias("k")).agg(F.collect_list(F.struct("n", "word")).alias("g")).where("size(g) > 1")  # a word a letter at most
    ranked = F.array_sort("g", lambda u, v: F.when(u["n"] != v["n"], F.when(u["n"] > v["n"], -1).otherwise(1)).when(u["word"] < v["word"], -1).otherwise(1))
    groups = beside.withColumn("g", ranked)
    groups = groups.select((F.size("g") - 1).cast("long").alias("c"), F.col("g")[0].alias("first"), F.col("g")[1].alias("second"), F.explode("g").alias("m"))
    groups = groups.select("m.word", "c", F.when(F.col("m.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return side("word", "other", "other_n").unionByName(side("other", "word", "n")).unionByName(groups)


def group(spark: SparkSession, docs: DataFrame, least: int = 7, often: int = 2, every: int = 31, times: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    scratch = Scratch(spark, "spelling")
    own = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")
    words = counted(own, least, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    words = scratch.save(words.withColumn("word_key", F.unhex(F.left(F.sha2("word", 256), F.lit(32)))), "words")
    near = one_edit(scratch, words).groupBy("word").agg(F.sum("c").alias("n_near"), F.max("best.n").alias("form_n"), F.min_by("best.word", F.struct(-F.col("best.n"), F.col("best.word"))).alias("form"))
    near = near.join(words.select("word", "n"), "word").withColumn("has", F.col("form_n") >= times * F.col("n"))
    near = scratch.save(near.select("word", "n_near", F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "near")
    roots = scratch.save(near.where("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    most, chain = words.agg(F.max("n")).first()[0] or 1, 1
    turn = 0
    while times**chain <= most:  # a chain of so many forms needs a count of times**chain at least
        turn += 1
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.save(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{turn}")
        scratch.drop(f"roots-{turn - 1}")
        chain *= 2
    out = words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
