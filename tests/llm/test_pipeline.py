"""The pipeline's stages on a small table, and its guard in the entry module."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from statistics import mean, variance

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from groundline.llm import language, queries  # noqa: E402
from tests.llm.test_operators import DOCS, ODD, brute_links, brute_quality, clashing, classes, frame, plain_language, words  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    base = [words(rng, 60) + f" token = {'%040x' % rng.getrandbits(160)} end" if i % 10 == 0 else words(rng, 60) for i in range(60)]
    return frame(spark, [*base, *base[:5], base[7].replace("w1", "w9", 1), *ODD])


def test_each_stage_on_what_the_one_before_kept(spark, docs, tmp_path):
    at = clashing(docs).drop("path")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == at.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at
    count = {k: v.count() for k, v in seen.items()}
    assert count["quality_rules"] == 66 and count["language_id"] == 66 and count["ngram_jaccard_join"] == 60 == count["secret_scan"]
    texts = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert set(texts) == set(range(60)) and all(("[SECRET]" in t) == (i % 10 == 0) for i, t in texts.items())
    packed = seen["best_fit_packing"]
    assert {r.doc_id for r in packed.collect()} == set(texts)


def test_run_and_empty_tables(spark, docs, tmp_path):
    (tmp_path / "full").mkdir()
    docs.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).select("doc_id").distinct().count() == 60
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_repeated_rows_leave_one(spark, docs):
    twice = docs.where("doc_id < 5").unionAll(docs.where("doc_id < 5"))
    assert corpus_pipeline.ngram_jaccard_join(spark, twice, "").count() == 5
    nameless = twice.withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.ngram_jaccard_join(spark, nameless, "").count() == 5  # known by their texts


def test_run_is_brute_force(spark, tmp_path):
    """Every stage again in plain Python: host rates, compressed sizes, all pairs of sets, written secrets, library ids."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(41)
    kinds = {"xa": "tion the ing and er".split(), "xb": "sch ung der ein keit".split(), "xc": "ique eau les aux ment".split()}
    prose = lambda k, n: ["".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 2))) for _ in range(n)]
    every, langs, hosts, hidden = [], {}, {}, {}

    def add(words_, lang, host):
        langs[len(every)], hosts[len(every)] = lang, host
        every.append(" ".join(words_))

    for i in range(60):
        own = prose(kind := list(kinds)[i % 3], rng.randint(60, 120))
        if i % 10 == 0:
            hidden[len(every)] = f"token = {rng.getrandbits(160):040x}"
            own.insert(30, hidden[len(every)])
        add(own, kind, f"good{i % 4}")
        if i % 6 == 1:
            add([*own[:40], "changed", *own[41:]], kind, "good0")
    for i in range(12):  # two of them are clean, and go with their host
        add(prose("xa", 60) if i < 2 else ["#$%&|<>"] * 40, "xa", "bad")
    add(["er", "and", "the"], "xa", "good1")
    add([w for pair in zip(prose("xa", 40), prose("xb", 40), strict=True) for w in pair], "xa", "good2")
    add(prose("xb", 3000), "xb", "good3")
    docs = frame(spark, every, lang=langs, source=hosts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    counts = [brute_quality(t) for t in every]
    bad = [c[5] or 10 * c[2] > c[1] for c in counts]
    by_host = defaultdict(list)
    for i, failed in enumerate(bad):
        by_host[hosts[i]].append(failed)
    rates = [mean(map(float, v)) for v in by_host.values()]
    strength = min(1000.0, max(2.0, mean(rates) * (1 - mean(rates)) / variance(rates) - 1))
    centre = (sum(bad) + 0.5) / (len(bad) + 1)
    shrunk = {h: (sum(v) + centre * strength) / (len(v) + strength) for h, v in by_host.items()}
    kept = [i for i in range(len(every)) if not counts[i][5] and shrunk[hosts[i]] <= 0.5]
    assert shrunk["bad"] > 0.5 and len(kept) == len(every) - 13
    content = language.learn(docs.where(F.col("doc_id").isin(kept)))
    kept = [i for i in kept if (plain_language(content, every[i]) or ("und", 0.0))[1] >= language.NARROW]
    group = classes(brute_links([every[i] for i in kept]))
    kept = [i for n, i in enumerate(kept) if group[n] == n]
    assert len(kept) in (61, 62)

    want = set()
    for i in kept:
        text = every[i].replace(hidden[i], "[SECRET]") if i in hidden else every[i]
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want |= {(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True)) and sum(own[-1]) <= 1024
