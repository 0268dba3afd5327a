"""The corpus queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, hard_negatives, html_extract, jaccard_join, packing, quality_rules, secret_scan, sharding, suffix_dedup, tokens, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]

# The stated rules.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_articles(_table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; tests hold the others against plain versions."""
    return {"op2_suffix_dedup": REPEATS_SQL, "op4_url_filter": URL_SQL, "op5_decontamination": WINDOWS_SQL, "op8_jaccard_join": LINKS_SQL, "op12_hard_negatives": NEGATIVES_SQL}


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT s.page_id, s.host, s.path, r.verdict, r.rule_host || r.rule_path AS rule
  FROM split s LEFT JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 400 bytes (as hexadecimal digits) that start at two places.
REPEATS_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT r, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS a FROM texts
), windows AS (
  SELECT s.r, s.a, md5(substr(t.h, 2 * s.a + 1, 800)) AS w FROM starts s JOIN texts t USING (r)
), repeated AS (
  SELECT r, a, lag(a) OVER (PARTITION BY r ORDER BY a) AS before FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), numbered AS (
  -- Windows whose bytes overlap or touch are one removed run.
  SELECT r, a, sum(CASE WHEN before IS NULL OR a > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY a) AS run FROM repeated
), runs AS (
  SELECT r, run, min(a) AS a, max(a) + 400 AS b FROM numbered GROUP BY r, run
), kept AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS rest_from FROM runs
), pieces AS (
  SELECT k.r, string_agg(substr(t.h, 2 * k.rest_from + 1, 2 * (k.a - k.rest_from)), '' ORDER BY k.a) AS head, max(k.b) AS rest, sum(k.b - k.a) AS n_removed, count(*) AS n_spans FROM kept k JOIN texts t USING (r) GROUP BY k.r
)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, coalesce(p.n_removed, 0)::BIGINT AS n_removed, coalesce(p.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(p.head || substr(t.h, 2 * p.rest + 1), t.h))) AS kept_sha256
FROM texts t LEFT JOIN pieces p USING (r)
"""

WINDOWS_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[k + 1 : k + 10], ' ') AS w
  FROM (SELECT *, unnest(range(0, greatest(len(words) - 9, 1))) AS k FROM items WHERE len(words) > 0)
), places AS (
  SELECT d.r, s.size, k, array_to_string(d.words[k + 1 : k + s.size], ' ') AS w
  FROM docs d, (SELECT DISTINCT size FROM windows) s, unnest(range(0, greatest(len(d.words) - s.size + 1, 0))) u(k)
), found AS (
  SELECT p.r, p.k, p.size, w.item_id FROM places p JOIN windows w USING (size, w)
), hit AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + size)) AS place FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (r) LEFT JOIN named n USING (r)
"""

LINKS_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT r, md5(array_to_string(words[k + 1 : k + 3], ' ')) AS s FROM (SELECT *, unnest(range(0, greatest(len(words) - 2, 1))) AS k FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), both_have AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM both_have c JOIN sizes a ON a.r = c.x JOIN sizes b ON b.r = c.y WHERE 100 * c.n >= 90 * (a.n + b.n - c.n)
), edges AS MATERIALIZED (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT r AS x, r AS y FROM docs UNION SELECT reach.x, e.y FROM reach JOIN edges e ON reach.y = e.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id
FROM docs d LEFT JOIN sizes s USING (r) JOIN (SELECT reach.x AS r, min(o.doc_id) AS component_id FROM reach JOIN docs o ON o.r = reach.y GROUP BY reach.x) m USING (r)
"""

NEGATIVES_SQL = r"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST, other) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other_id NULLS LAST, s.other)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
