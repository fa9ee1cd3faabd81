"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontamination import find_contamination
from .language_id import language_id
from .licenses import license_scan
from .mixing import mix_sizes
from .ngram_join import ngram_jaccard_join
from .pii import pii_scan
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .secrets import secret_scan
from .suffix_dedup import remove_repeats


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, m.class_id, coalesce(k.n_links, 0) AS n_links FROM documents d
JOIN (SELECT a, min(b) AS class_id FROM r GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = d.doc_id
"""

def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents")).drop("copies")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(i % 3 + 1)::INT]::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM a),
r AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM w),
l AS (SELECT *, (total - caps) / (all_w - ws) AS level FROM r),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level * w <= cap) * w) AS target FROM l),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS e,
  (('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
c AS (SELECT *, floor(e)::BIGINT AS certain, e - floor(e) AS p FROM e),
k AS (SELECT *, sum(size * certain) OVER (PARTITION BY source) AS sure, CASE WHEN p > 0 THEN u / (1 - u) * ((1 - p) / p) END AS odds FROM c),
o AS (SELECT *, sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (certain + CASE WHEN odds IS NOT NULL AND run - size / 2.0 <= target - sure THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS i, h FROM d),
x AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 200)) AS s FROM w),
f AS (SELECT doc_id, i, min(doc_id * 1000000000 + i) OVER (PARTITION BY s) < doc_id * 1000000000 + i AS again FROM x),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM f WHERE again),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, k),
p AS (SELECT r.doc_id, a, substring(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS piece, b FROM r JOIN d USING (doc_id) WINDOW o AS (PARTITION BY r.doc_id ORDER BY a)),
k AS (SELECT p.doc_id, string_agg(piece, '' ORDER BY a) || substring(any_value(d.h), 2 * max(b) + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.kept, d.h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_pii_scan": op9_pii_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op2_mix_sources": OP2_SQL, "op10_suffix_dedup": OP10_SQL}
