"""The operators bound to the supplied tables, with production parameters."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, codebooks, exact_dedup, html_text, katz, licenses, mixing, near_dedup, quality, rules, urls, warc


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: their Python
    workers import it when they run the operators' functions."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).parents[2]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/shelfloom", "zip", root, "shelfloom"))
        _SHIPPED.add(context.applicationId)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public vocabulary file that the BPE query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return licenses.license_labels(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op4_bpe(spark, sf_dir):
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary(), outputs=("ids_sha256", "decoded_sha256"))


def op5_quality_classifier(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_html_text(spark, sf_dir):
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op11_katz_score(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return katz.katz_scores(_table(spark, sf_dir, "documents"), held_out)


def op12_clusters(spark, sf_dir):
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return clusters.lloyd(_table(spark, sf_dir, "embeddings"), start, k=16, rounds=3, dims=64, scale=64)


def op13_vector_codes(spark, sf_dir):
    return codebooks.vector_codes(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, dims=64, scale=4096)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_near_dedup, op2_license_scan, op3_url_filter, op4_bpe, op5_quality_classifier, op6_exact_dedup, op7_source_mix, op8_warc, op9_html_text, op10_quality_rules, op11_katz_score, op12_clusters, op13_vector_codes, pipeline)
    return {f.__name__: f for f in named}


def _url_sql() -> str:
    low = "translate(url_decode(url), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = lambda terms: " + ".join(f"coalesce(regexp_matches({low}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'), false)::BIGINT" for t in terms)
    fits = [(v, h, p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {c} THEN '{h}{p}'" for _, h, p, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for v, _, _, c in fits)
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path, {hits(urls.STRICT)} AS strict_hits, {hits(urls.SOFT)} AS soft_hits FROM c)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits
FROM d"""


_EXACT_SQL = """
WITH a AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size, sha256(body) AS text_sha256 FROM a GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM a JOIN g USING (body)"""

_BASE32 = " || ".join(f"to_base(('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT, 32, 4)" for i in range(8))
_WARC_SQL = f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes,
             translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM a)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""


def _kept_sql(scale: int) -> str:
    """Usable vectors as whole numbers, each with a number of its own."""
    return f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


_SQUARED = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _lloyd_sql(rounds: int = 3) -> str:
    steps = [_kept_sql(64), "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS k, v FROM kept ORDER BY sha256('1:' || vec_id::VARCHAR) LIMIT 16)"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, k, d FROM (SELECT a.r, a.vec_id, a.v, c.k, {_SQUARED} AS d FROM kept a, c{i} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN
(SELECT k, list(m ORDER BY i) AS v FROM (SELECT k, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM a{i}, range(1, 65) t(i) GROUP BY k, i) GROUP BY k) n USING (k))""")
    return f"""WITH {", ".join(steps[:-1])}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)"""


def _codes_sql(rounds: int = 6) -> str:
    parts = "range(8) t(p)"
    steps = [
        _kept_sql(4096), f"parts AS MATERIALIZED (SELECT r, vec_id, label, p, v[8 * p + 1 : 8 * p + 8] AS v FROM kept, {parts})",
        "c0 AS (SELECT r - 1 AS k, p, v FROM parts WHERE r <= 16)",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, label, p, v, k, d FROM (SELECT a.*, c.k, {_SQUARED} AS d FROM parts a JOIN c{i} c USING (p)) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, p, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN
(SELECT k, p, list(m ORDER BY i) AS v FROM (SELECT k, p, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM a{i}, range(1, 9) t(i) GROUP BY k, p, i) GROUP BY k, p) n USING (k, p))""")
    return f"""WITH {", ".join(steps[:-1])},
rows_of AS (SELECT r, vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM rows_of"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator; the others are tested in tests/llm."""
    return {"op3_url_filter": _url_sql(), "op6_exact_dedup": _EXACT_SQL, "op8_warc": _WARC_SQL, "op12_clusters": _lloyd_sql(), "op13_vector_codes": _codes_sql()}
