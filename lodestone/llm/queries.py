"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, jaccard_join, line_dedup, packing, quality_rules, secret_scan, substring_dedup, token_counts, url_filter

RANKS, MERGES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"

#: The contract's rules: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MERGES))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(MERGES))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_token_counts, op3_secret_scan, op4_packing, op5_substring_dedup,
        op6_url_filter, op7_bpe, op8_quality_rules, op9_jaccard_join, op10_line_dedup,
    )
}

OP1_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (
  SELECT * FROM vectors
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.n AS a, b.n AS b FROM sound AS a, sound AS b
  WHERE a.label = b.label AND a.n <> b.n AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(n, m) AS (SELECT n, n FROM vectors UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.m)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.n) AS n_links,
  min(w.vec_id) AS component_id, v.vec_id = min(w.vec_id) AS kept
FROM vectors AS v JOIN reach ON reach.n = v.n JOIN vectors AS w ON w.n = reach.m GROUP BY v.n, v.vec_id
"""

OP5_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT n, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT n, i, array_to_string(w[i:i + 34], ' ') AS passage FROM places JOIN docs USING (n)),
again AS (SELECT n, i FROM windows WHERE passage IN (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1)),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 35)) AS i FROM again),
every AS (SELECT n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
left_over AS (SELECT n, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM every ANTI JOIN gone USING (n, i) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_over.text, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (n)
"""

OP9_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
places AS (SELECT n, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT n, CASE WHEN len(w) < 3 THEN 'whole ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s FROM places JOIN docs USING (n)),
sizes AS (SELECT n, count(*) AS size FROM shingles GROUP BY n),
common AS (SELECT a.n AS a, b.n AS b, count(*) AS shared FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.n <> b.n GROUP BY a.n, b.n),
links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.n = a JOIN sizes AS y ON y.n = b WHERE 100 * shared >= 90 * (x.size + y.size - shared)),
reach(n, m) AS (SELECT n, n FROM docs UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.m)
SELECT d.doc_id, coalesce(any_value(size), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM docs AS d JOIN reach ON reach.n = d.n JOIN docs AS e ON e.n = reach.m LEFT JOIN sizes ON sizes.n = d.n GROUP BY d.n, d.doc_id
"""

OP10_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT n, doc_id, source, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line FROM docs),
inked AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
spread AS (SELECT line, min(doc_id) AS first FROM inked GROUP BY line HAVING count(DISTINCT source) >= 10),
gone AS (SELECT n, pos FROM inked JOIN spread USING (line) WHERE doc_id IS DISTINCT FROM first),
kept AS (SELECT n, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (n, pos) GROUP BY n),
counts AS (SELECT n, count(*) AS n_lines FROM inked GROUP BY n), lost AS (SELECT n, count(*) AS n_removed FROM gone GROUP BY n)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n) LEFT JOIN counts USING (n) LEFT JOIN lost USING (n)
"""

OP6_SQL = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS place
  FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) AS best USING (n)
"""

ORACLE_SQL = {
    "op1_embedding_dedup": OP1_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
}
