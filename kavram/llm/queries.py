"""Queries of this subpackage's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, near_dedup, packing, quality_crf, quality_rules, suffix_dedup, token_counts, toxicity, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_decontamination,
        op3_warc_zip,
        op4_source_mixing,
        op5_suffix_dedup,
        op6_near_duplicates,
        op7_quality_classifier,
        op8_token_packing,
        op9_toxicity,
        op10_token_counts,
    )
}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_COUNTS = {
    "lower": "[^a-z]",
    "upper": "[^A-Z]",
    "digit": "[^0-9]",
    "space": r"[^ \t\n\r\f\v]",
    "punctuation": r"[^.,;:!?''\"()\-]",
    "other": r"[\x00-\x7F]",
}
_CLASS_COLUMNS = ", ".join(f"length(regexp_replace(t, '{pattern}', '', 'g')) AS c_{name}" for name, pattern in _COUNTS.items())
_CLASS_NAMES = [f"c_{name}" for name in _COUNTS]
_RULES, _MIX = quality_rules.Rules(), mixing.Settings()


def _distance_sql(p: str, q: str) -> str:
    """Of the shares p and q, which are columns of rows of one document."""
    m = f"(({p}) + ({q})) / 2"
    return f"round(sqrt(greatest(0, least(1, (sum(CASE WHEN {p} > 0 THEN {p} * log2({p} / ({m})) ELSE 0 END) + sum(CASE WHEN {q} > 0 THEN {q} * log2({q} / ({m})) ELSE 0 END)) / 2))), 6)"


SQL: dict[str, str] = {
    "op1_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS l, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
k AS (SELECT r, doc_id, l, len(w) AS n, length(t) AS chars, {_CLASS_COLUMNS} FROM d),
c AS (SELECT r, l, unnest([{', '.join(_CLASS_NAMES)}, chars - {' - '.join(_CLASS_NAMES)}]) AS v, unnest(range(7)) AS b FROM k),
cref AS (SELECT l, b, sum(v) / sum(sum(v)) OVER (PARTITION BY l) AS q FROM c GROUP BY l, b),
cd AS (SELECT c.r, {_distance_sql('p', 'q')} AS js FROM (SELECT r, l, b, v / greatest(sum(v) OVER (PARTITION BY r), 1) AS p FROM c) c JOIN cref USING (l, b) GROUP BY c.r),
x AS (SELECT r, l, unnest(w) AS word FROM d),
total AS (SELECT l, count(*) AS n FROM x GROUP BY l HAVING count(*) >= {_RULES.min_reference_words}),
common AS (SELECT l, word, count(*) AS n FROM x GROUP BY l, word),
wref AS (SELECT c.l, c.word, c.n, total.n AS total FROM common c JOIN total USING (l) WHERE c.n >= {_RULES.common_share} * total.n),
bins AS (SELECT l, word, n / total AS q FROM wref UNION ALL SELECT l, NULL, (any_value(total) - sum(n)) / any_value(total) FROM wref GROUP BY l),
own AS (SELECT r, l, word, count(*) AS n FROM x SEMI JOIN wref USING (l, word) GROUP BY ALL),
part AS (SELECT k.r, b.q, CASE WHEN b.word IS NULL THEN k.n - coalesce(s.n, 0) ELSE coalesce(o.n, 0) END / greatest(k.n, 1) AS p
  FROM k JOIN bins b USING (l) LEFT JOIN own o ON o.r = k.r AND o.word = b.word LEFT JOIN (SELECT r, sum(n) AS n FROM own GROUP BY r) s ON s.r = k.r),
wd AS (SELECT r, {_distance_sql('p', 'q')} AS js FROM part GROUP BY r),
j AS (SELECT k.doc_id, k.n, CASE WHEN k.chars >= {_RULES.min_chars} AND total.n IS NOT NULL THEN cd.js END AS a, CASE WHEN k.n >= {_RULES.min_words} THEN wd.js END AS b
  FROM k LEFT JOIN total ON total.l = k.l LEFT JOIN cd ON cd.r = k.r LEFT JOIN wd ON wd.r = k.r)
SELECT doc_id, n AS n_words, a AS char_distance, b AS word_distance,
  NOT (coalesce(a > {_RULES.max_char_distance}, false) OR coalesce(b > {_RULES.max_word_distance} + {_RULES.word_noise} / sqrt(greatest(n, 1)), false)) AS keep FROM j""",
    "op2_decontamination": f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, w, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM i, unnest(range(1, len(w) - k + 2)) AS u(p)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM i), unnest(range(1, len(w) - k + 2)) AS u(p)),
n AS (SELECT item_id, w, count(*) AS n FROM s GROUP BY item_id, w)
SELECT doc_id, item_id, round(count(*) / any_value(n.n), 6) AS containment FROM s JOIN g USING (k, g) JOIN n USING (item_id, w)
GROUP BY doc_id, item_id, w HAVING count(*) >= 0.8 * any_value(n.n)""",
    "op3_warc_zip": "SELECT page_id, url, CAST(CASE WHEN html IS NULL THEN 204 ELSE 200 END AS INTEGER) AS status, 'text/html' AS mime, html, CAST(NULL AS VARCHAR) AS error FROM pages",
    "op4_source_mixing": f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM documents GROUP BY source),
w AS (SELECT *, n ** {_MIX.temperature} AS w FROM n),
q AS (SELECT *, greatest(1, CAST(round(w / sum(w) OVER () * 4294967296) AS BIGINT)) AS q FROM w),
d AS (SELECT *, CAST(sum(q) OVER () AS BIGINT) AS d FROM q),
b AS (SELECT *, greatest({_MIX.block_docs}, (max((n * d + q - 1) // q) OVER () + {_MIX.max_slots} - 1) // {_MIX.max_slots}) AS b FROM d),
every AS (SELECT list(q ORDER BY i) AS q, list((n + b - 1) // b ORDER BY i) AS least, count(*) AS k, any_value(d) AS d FROM b),
edf(t, j, pick) AS (
  SELECT -1, list_transform(range(k), lambda x: 0::BIGINT), 0::BIGINT FROM every
  UNION ALL
  SELECT t + 1, list_transform(j, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick FROM (
    SELECT t, j, list_min(list_transform(list_filter(range(1, k + 1), lambda i: j[i] * d // q[i] <= t + 1), lambda i: {{'due': ((j[i] + 1) * d + q[i] - 1) // q[i], 'i': i}})).i AS pick
    FROM edf, every WHERE len(list_filter(range(1, k + 1), lambda i: j[i] < least[i])) > 0)),
slots AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf WHERE t >= 0),
plan AS (SELECT b.*, (SELECT count(*) FROM slots s WHERE s.i = b.i) AS blocks FROM b),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS pos FROM documents),
places AS (SELECT r.doc_id, r.source, p.i, p.n, p.b, unnest(range(r.pos, p.blocks * p.b, p.n)) AS e FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, CAST(t AS BIGINT) AS slot, CAST(e // b AS BIGINT) AS block, CAST(e // n AS BIGINT) AS epoch
FROM places JOIN slots ON slots.i = places.i AND slots.j = e // b""",
    "op5_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(p)),
again AS (SELECT r, doc_id, p - 1 AS p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
cut AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM again),
span AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) AS s FROM cut)
SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word FROM span GROUP BY r, doc_id, s""",
}
