"""Registered queries of the pipeline operators, and DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlab.llm import (decontaminate, license_scan, lm_score, near_dup, packing, periodic_runs, quality_model, quality_rules, repeats,
                        source_divergence, substring_dedup, url_filters, warc)
from seqlab.llm.common import ship


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {name: shipped(f) for name, f in {
    "op1_license_scan": license_scan.op1,
    "op2_quality_model": quality_model.op2,
    "op3_url_filter": url_filters.op3,
    "op4_near_dup": near_dup.op4,
    "op5_packing": packing.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_lm_score": lm_score.op7,
    "op8_repeats": repeats.op8,
    "op9_warc": warc.op9,
    "op10_quality_rules": quality_rules.op10,
    "op11_periodic_runs": periodic_runs.op11,
    "op12_substring_dedup": substring_dedup.op12,
    "op13_source_divergence": source_divergence.op13,
}.items()}

ORACLE = {
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op12_substring_dedup": substring_dedup.ORACLE_SQL,
    "op13_source_divergence": source_divergence.ORACLE_SQL,
    "op9_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN m.first IS NOT NULL AND p.page_id IS DISTINCT FROM m.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM m.first THEN m.first END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 100
""",
}
