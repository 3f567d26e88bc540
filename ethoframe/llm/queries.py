"""The corpus operators' queries, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, jaccard, lines, mixing, neighbours, packing, pages, periods, pii, quality, scoring, substrings, toxicity
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), most=3)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies"
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymise(table(spark, sf_dir, "documents"), key="op2")
    return rows.select("doc_id", "text", "n_found", F.concat_ws(",", "kinds").alias("kinds"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), order=5, folds=7, fold=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.withColumn("base_failed", quality.base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=50, digest=True)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.8, width=5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=4, fold=2)
    found = toxicity.score(docs, net)
    return found.select(
        "doc_id", toxicity.held_out(4, 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "threshold", "toxic",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=1024, digest=True)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.repeat_tails(table(spark, sf_dir, "documents"))
    return periods.collapse_runs(docs, shortest=24, digest=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_main_text": op13_main_text,
}

def _codes_sql(rounds: int) -> str:
    """Assignments and new codebooks, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT vec_id, label, part, any_value(p.x) AS x, min(struct_pack(far := list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), entry := c.entry)) AS best
  FROM p JOIN c{r} c USING (part) GROUP BY vec_id, label, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT part, best.entry AS entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r}, range(1, (SELECT max(len(x)) FROM p) + 1) AS k(i) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x, len(embedding) // 16 AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, x[part * d + 1:part * d + d] AS x FROM v, range(0, 16) AS r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < 64),{','.join(steps)},
f AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h"""


_SPACES = r"[^\x20\x09-\x0D]"

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS.split()))

SQL: dict[str, str] = {
    "op4_quality_rules": rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_SPACES}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACES}')) AS lines
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g),
s AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS k FROM n WHERE c > 1),
r AS (SELECT doc_id, sum(k) AS k FROM s GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(k, 0) AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM t LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *,
    CASE WHEN n_words < 10 THEN 'few_words' END AS f1,
    CASE WHEN 100.0::DOUBLE * n_repeat_words > 20.0::DOUBLE * n_words THEN 'repeats' END AS f2,
    CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words) THEN 'word_length' END AS f3,
    CASE WHEN n_words > 0 AND n_symbols::DOUBLE / n_words > 0.1::DOUBLE THEN 'symbols' END AS f4,
    CASE WHEN n_words >= 50 AND 100 * n_stop_words < 2 * n_words THEN 'stop_words' END AS f5,
    CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines THEN 'line_repeats' END AS f6,
    CASE WHEN n_words > 0 AND 100 * n_stutters > 30 * n_words THEN 'stutter' END AS f7
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       f1 IS NOT NULL OR f2 IS NOT NULL AS base_failed,
       coalesce(f1, f2, f3, f4, f5, f6, f7) IS NULL AS kept,
       concat_ws(',', f1, f2, f3, f4, f5, f6, f7) AS failed_rules
FROM f""",
    "op5_substring_dedup": rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACES}+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(array_to_string(w[i:i + 49], ' '))) AS least FROM g),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM h, range(0, 50) AS r(k) WHERE doc_id > least),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACES}+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
        list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
      FROM t WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS copy_of, count(*) AS size, any_value(s) AS s, md5(array_to_string(s, chr(10))) AS k FROM g GROUP BY k),
e AS (SELECT copy_of, len(s) AS n, unnest(s) AS x FROM c),
p AS (SELECT a.copy_of AS a, b.copy_of AS b FROM e a JOIN e b ON a.x = b.x AND a.copy_of < b.copy_of
      GROUP BY ALL HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT copy_of AS a, copy_of AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS copy_of, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT l.a AS copy_of, sum(c.size) AS linked, count(*) AS texts FROM l JOIN c ON l.b = c.copy_of GROUP BY l.a)
SELECT g.doc_id, c.copy_of, m.class_id, (c.size - 1 + coalesce(n.linked, 0))::BIGINT AS n_links, coalesce(n.texts, 0)::BIGINT AS n_texts
FROM g JOIN c ON md5(array_to_string(g.s, chr(10))) = c.k JOIN m USING (copy_of) LEFT JOIN n USING (copy_of)
UNION ALL SELECT doc_id, doc_id, doc_id, 0, 0 FROM t WHERE len(w) = 0""",
    "op12_vector_codes": _codes_sql(2),
}
