"""Host-level quality rules, in DataFrame functions only.

Each document gets its counts; rule failures are summed by host (``source``); each host's
failure rate is shrunk towards the corpus rate by a beta prior fitted to the hosts by the
method of moments, its strength kept within ``strength`` documents; a host whose shrunk rate
exceeds ``max_rate`` is rejected as a whole.

Defined cases: a null or empty text has no words (counts 0, base rule fails). A null host is
a host of its own. Repeated rows count as often as they occur, and each is returned. An empty
table gives an empty result. A rate of just ``max_rate`` keeps its host. Very long texts are
counted whole. Ids may be null or equal. Columns other than the named ones are
ignored, whatever their names; the named ones may have names of columns made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Documents that the prior weighs at least and at most: moments of few or equal hosts give no bound themselves.
STRENGTH = (2.0, 1000.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts, ``base_failed`` and ``rule_failed``; one scan, no shuffle.

    Every window of eight words is reduced to a 64-bit hash of its words' hashes. Only texts
    whose hashes are not all different pay for sorting the windows by (hash, position).
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in _OWN]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a = docs.select(*own, F.filter(F.split(body, SPACES), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hash"),
    )
    last = F.size("__hash") - WINDOW
    a = a.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice("__hash", i + 1, WINDOW)))).alias("__win"),
    )
    again = F.size(F.array_distinct("__win")) < F.size("__win")
    a = a.withColumn("__win", F.when(again, F.col("__win")))
    a = a.withColumn("__win", F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    w = F.col("__win")
    same = lambda x, i, by: F.coalesce(F.get(w, i + by)["h"] == x["h"], F.lit(False))
    found = F.filter(w, lambda x, i: ((i > 0) & same(x, i, -1)) | same(x, i, 1))
    a = a.withColumn("__win", F.sort_array(F.transform(found, lambda x: x["i"])))
    gaps = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda p, k: F.least(p - F.get(w, k), F.lit(WINDOW)))
    repeat = F.when(F.coalesce(F.size(w), F.lit(0)) > 0, F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g)).otherwise(0)
    a = a.withColumn("n_repeat_words", repeat.cast("long")).drop("__win")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    noisy = 10 * F.col("n_symbols") > F.col("word_chars")
    return a.withColumn("base_failed", base).withColumn("rule_failed", base | noisy)


_OWN = {*COUNTS, "base_failed", "rule_failed", "host_rate", "__words", "__lines", "__hash", "__win", "__host", "__rate"}


def host_rates(counted: DataFrame, host: str = "source", strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """One row a host: documents, failures, and the failure rate shrunk by the beta prior.

    The prior takes one row (four sums over hosts) to the driver, whatever the number of hosts.
    """
    hosts = counted.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("docs"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    n, k, m, v = hosts.agg(F.sum("docs"), F.sum("failed"), F.avg(rate), F.var_samp(rate)).first()
    alpha, beta = beta_prior(n or 0, k or 0, m or 0.0, v or 0.0, strength)
    return hosts.withColumn("__rate", (F.col("failed") + alpha) / (F.col("docs") + alpha + beta))


def beta_prior(docs: int, failed: int, mean: float, variance: float, strength: tuple[float, float] = STRENGTH) -> tuple[float, float]:
    """Method of moments, as strong as ``strength`` allows; centred on the corpus rate."""
    least, most = strength
    centre = (failed + 0.5) / (docs + 1)
    weight = min(most, max(least, mean * (1 - mean) / variance - 1 if variance > 0 else most))
    return centre * weight, (1 - centre) * weight


def host_rules(spark: SparkSession, docs: DataFrame, keys: list[str], host: str = "source", text: str = "text", max_rate: float = 0.5, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """``keys`` of each row, its counts, ``base_failed``, ``host_rate`` and ``kept``.

    The counts are written once to the shared folder, as two passes read them: the sums by
    host and the join of host rates back to the rows. ``keys`` may be all columns of ``docs``.
    """
    scratch = Scratch(spark, "quality")
    names = {c: f"__in{n}" for n, c in enumerate(dict.fromkeys([*keys, host, text]))}
    counted = with_counts(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names[text])
    need = list(dict.fromkeys(names[c] for c in (*keys, host)))
    counted = scratch.save(counted.select(*need, *COUNTS, "base_failed", "rule_failed"), "counted")
    rates = scratch.save(host_rates(counted, names[host], strength).select("__host", "__rate"), "rates")
    joined = counted.join(rates, counted[names[host]].eqNullSafe(rates["__host"]), "left")
    kept: Column = ~F.col("base_failed") & (F.col("__rate") <= max_rate)
    return joined.select(*[counted[names[k]].alias(k) for k in keys], *COUNTS, "base_failed", F.col("__rate").alias("host_rate"), kept.alias("kept"))
