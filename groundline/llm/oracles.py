"""The same results in DuckDB SQL, for those operators that SQL can express."""

from __future__ import annotations

from .license_texts import LICENSES, NOTICES, SPELLINGS
from .licenses import COPYRIGHT, OTHER, digest

_Q = "'"


def quoted(text: str) -> str:
    return _Q + text.replace(_Q, _Q * 2) + _Q


QUALITY = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), windows AS (
  SELECT *, CASE WHEN len(w) >= 8 THEN list_transform(range(0, len(w) - 7), lambda i: array_to_string(w[i + 1 : i + 8], ' ')) ELSE [] END AS win
  FROM words
), marked AS (
  SELECT doc_id, source, row_number() OVER () AS r, body, w, ln, win FROM windows
), placed AS (
  SELECT r, unnest(win) AS x, unnest(range(0, len(win))) AS i FROM marked
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM placed) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS t(k) GROUP BY r
), counted AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM marked LEFT JOIN covered USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT source, count(*) AS docs, sum(CAST(base_failed OR 10 * n_symbols > word_chars AS BIGINT)) AS bad FROM failed GROUP BY source
), moments AS (
  SELECT sum(docs) AS n, sum(bad) AS k, avg(bad / docs) AS m, coalesce(var_samp(bad / docs), 0) AS v FROM hosts
), prior AS (
  SELECT (k + 0.5) / (n + 1) AS centre, least(1000, greatest(2, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000 END)) AS strength FROM moments
), rates AS (
  SELECT source AS host, (bad + centre * strength) / (docs + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rate AS host_rate,
       NOT base_failed AND rate <= 0.5 AS kept
FROM failed JOIN rates ON source IS NOT DISTINCT FROM host
"""


def _canonical(x: str) -> str:
    x = f"regexp_replace(lower(coalesce({x}, '')), {quoted(COPYRIGHT)}, ' ', 'g')"
    x = f"' ' || regexp_replace({x}, {quoted(OTHER)}, ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        x = f"replace({x}, ' {old} ', ' {new} ')"
    return f"trim({x})"


def license_sql() -> str:
    known = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in sorted({digest(t): n for n, t in LICENSES}.items()))
    notes = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in sorted({digest(t): n for n, t in NOTICES}.items()))
    return f"""
WITH known(canon_sha256, license_id) AS (VALUES {known}), notes(d, name) AS (VALUES {notes}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
whole AS (SELECT r, doc_id, sha256({_canonical("text")}) AS canon_sha256 FROM docs),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
found AS (SELECT r, name FROM (SELECT r, sha256({_canonical("line")}) AS d FROM lines WHERE regexp_matches(lower(line), 'licen[cs]e|warranty|public domain')) JOIN notes USING (d)),
noted AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM found GROUP BY r)
SELECT doc_id, canon_sha256, license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(names, '') AS notices
FROM whole LEFT JOIN known USING (canon_sha256) LEFT JOIN noted USING (r)
"""


def spelling_sql() -> str:
    """CRC-32 bit by bit over the UTF-8 bytes; pairs by the words that one deletion makes of two words."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx) // 2 + 1), lambda i: CAST('0x' || hx[2 * i - 1 : 2 * i] AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1]))"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, {bit}, k + 1 FROM bits WHERE k < 8
), crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
longer AS (SELECT doc_id, run, count(*) AS m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, m, xor({crc}, 4294967295) AS h FROM longer, crcs),
edited AS (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, m FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cut AS MATERIALIZED (SELECT DISTINCT word, n, i, word[: i] || word[i + 2 :] AS rest FROM words, (SELECT unnest(range(0, (SELECT max(length(word)) FROM words))) AS i) WHERE i < length(word)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), near AS (SELECT word, count(*) AS n_near, max(m) AS best_n, arg_min(other, (-m, other)) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS here, 0 AS k FROM formed UNION ALL SELECT walk.word, form, k + 1 FROM walk JOIN formed ON walk.here = formed.word WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


def centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round a pair of tables, the vectors' nearest centroids and the centroids' next places."""
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY k LIMIT {k})",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, vec_id, v, k, CAST({far} AS BIGINT) AS d FROM kept, c{n}) GROUP BY r)")
        if n < rounds:
            out.append(f"s{n} AS (SELECT k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM (SELECT k, v, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY k, i)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT k, list(x ORDER BY i) AS m FROM s{n} GROUP BY k) USING (k))")
    last = f"a{rounds}"
    return f"WITH {', '.join(out)} SELECT vec_id, CAST({last}.k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (k)"


ORACLES: dict[str, str] = {"op6_quality_rules": QUALITY, "op10_license_scan": license_sql(), "op11_spelling_groups": spelling_sql(), "op13_centroid_clusters": centroid_sql()}
