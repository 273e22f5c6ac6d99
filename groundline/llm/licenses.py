"""Licence lookup by canonical digest, in DataFrame functions only.

A text is lower-cased, its copyright lines go, runs of anything but letters and digits become
one blank, and equivalent spellings become one. The SHA-256 of the result is joined with the
digests of known licence texts. Single lines are looked up likewise among known notices.

Defined cases: null counts as the empty text; an empty canonical text matches no licence.
Repeated rows are each returned, whatever their ids, null and equal ones included. An empty table
gives an empty one. Very long texts are read whole. Two known licences of one digest are one
form; the name that comes last in the list stands for it. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import LICENSES, NOTICES, SPELLINGS

#: A line that opens with a copyright mark and goes on with a sign or a year, at once or after at most six words of
#: a holder's name, or a paragraph of the mark and a name only; not a line that speaks of copyright.
_MARK = r"(?:portions[ \t]+)?copyright"
_BLANK = r"[^\p{L}\p{N}\n]*"
COPYRIGHT = (
    rf"(?:^|\n{_BLANK}\n){_BLANK}{_MARK}(?:[ \t]+[^ \t\n]+){{1,6}}[ \t]*\n{_BLANK}\n"
    rf"|(?:^|\n){_BLANK}(?:{_MARK}(?:[^\p{{L}}\n]*(?:\(c\)|©|[0-9]{{4}})|(?:[ \t]+[^ \t\n]+){{1,6}}[ \t]+[0-9]{{4}})|\(c\)|©|all rights reserved)[^\n]*"
)
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, OTHER, " "), F.lit(" "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(x)


def canonical_text(text: str) -> str:
    """The same in Python, for the fixed licence texts."""
    x = regex.sub(COPYRIGHT, " ", text.lower())
    x = " " + regex.sub(OTHER, " ", x) + " "
    for old, new in SPELLINGS:
        x = x.replace(f" {old} ", f" {new} ")
    return x.strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def digest_table(spark: SparkSession) -> DataFrame:
    """One row a known licence: a fixed list of this module, so its broadcast is bounded."""
    rows = sorted({digest(text): name for name, text in LICENSES}.items())
    return spark.createDataFrame(rows, "canon_sha256 string, license_id string")


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, canon_sha256 and license_id of the whole text, and the notices found among its lines."""
    known = {digest(line): name for name, line in NOTICES}
    names = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.lower(x).rlike("licen[cs]e|warranty|public domain"))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(names, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    a = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("canon_sha256"), found.alias("found"))
    a = a.join(F.broadcast(digest_table(spark)), "canon_sha256", "left")
    return a.select("doc_id", "canon_sha256", "license_id", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))
