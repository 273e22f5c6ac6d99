"""Language identification by compression with per-language zstandard raw-content dictionaries.

A dictionary per language holds a bounded sample of the passages of its labelled texts; every
passage of every such text may be drawn, and the drawn ones are in it whole. A whole text is
encoded, block by block, with every dictionary; the language whose dictionary gives the fewest
bytes wins. A narrow relative margin between the two best rejects the prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected, as is
any text if nothing was learned. Equal sizes go to the language first in order. Repeated rows
are each returned; in learning, repeated rows may take several places of the sample. A null id
is not held out. Very long texts are compressed whole, in blocks whose sizes are summed. An
empty table gives no predictions and nothing learned. Only ``text`` takes part in a prediction;
other columns are ignored. Every learned language costs its dictionary in each worker's memory
and one encoding a text, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecoder import slices
from .common import give_back

#: Bound of the sample: passages a language, and code points of a passage.
PASSAGES, PASSAGE = 48, 2000
BLOCK = 32_768
#: Compressible by any dictionary: without it a short text is stored as it is, at equal size.
FILLER = b"\n" + b"-" * 120
CODING = {"strategy": zstandard.STRATEGY_LAZY2, "window_log": 19, "hash_log": 17, "chain_log": 19, "search_log": 3, "min_match": 4, "target_length": 16}
#: Relative margin below which a prediction is rejected.
NARROW = 0.01


def normal(texts: pa.Array) -> pa.Array:
    """Lower-case letters, anything between them as one blank."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language.

    The sample takes the passages with the least hashes of each language; the window limit drops
    other rows before the shuffle, and only hashes take part. A second pass fetches the passages.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length("text") / PASSAGE).cast("int") - 1)))
    rows = rows.select("doc_id", "lang", at.alias("at"), "text").selectExpr("lang", f"substring(text, at * {PASSAGE} + 1, {PASSAGE}) text", "doc_id", "at")
    rows = rows.selectExpr("lang", "text", "xxhash64(lang, doc_id, at, text) h")
    few = rows.selectExpr("lang", "h", "row_number() over (partition by lang order by h) n").where(f"n <= {PASSAGES}").select("h").distinct().collect()  # PASSAGES for each language at most
    if not few:
        return {}
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.h,) for r in few], "h long"))
    by: dict[str, list[str]] = {}
    for r in rows.join(chosen, "h", "left_semi").distinct().orderBy("lang", "h").collect():
        by.setdefault(r.lang, []).append(r.text)
    return {k: " ".join(normal(pa.array(v)).to_pylist()).encode() for k, v in sorted(by.items())}


class Sizes:
    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.coders = []
        for k in self.langs:
            how = zstandard.ZstdCompressionParameters(write_content_size=0, write_dict_id=0, **CODING)
            own = zstandard.ZstdCompressionDict(content[k] + FILLER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))

    def predict(self, text: str) -> tuple[str, float, float]:
        """(language, score, relative margin) of a normal text."""
        if not self.langs or not text:
            return "und", 0.0, 0.0
        raw = text.encode() + FILLER
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders], np.float64)
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        second = rest.min() if len(rest) else float(max(len(raw), sizes[best]))
        margin = float((second - sizes[best]) / second)
        return self.langs[best], margin / (margin + NARROW), margin


def predict(spark: SparkSession, docs: DataFrame, content: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected."""
    shared = spark.sparkContext.broadcast(content)  # PASSAGES passages a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sizes(shared.value)
        for keys, texts in slices(batches):
            lang, score, margin = zip(*map(own.predict, normal(texts).to_pylist()), strict=True)
            margin = pa.array(margin, pa.float64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(lang, pa.string()), pa.array(score, pa.float64()), margin, pc.less(margin, NARROW)], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_predicted(spark: SparkSession, docs: DataFrame, content: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose prediction is not rejected."""
    shared = spark.sparkContext.broadcast(content)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sizes(shared.value)
        for batch in batches:
            texts = normal(pc.fill_null(batch.column(at), "")).to_pylist()
            yield batch.filter(pa.array([own.predict(x)[2] >= NARROW for x in texts], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
