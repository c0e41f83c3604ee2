"""SQL names of the main expressions, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_VERDICT = """
CASE WHEN is_fake THEN
  CASE WHEN confidence >= 0.9 THEN 'HIGHLY LIKELY DEEPFAKE'
       WHEN confidence >= 0.7 THEN 'LIKELY DEEPFAKE'
       WHEN confidence >= 0.5 THEN 'POSSIBLY DEEPFAKE'
       ELSE 'SUSPECTED DEEPFAKE (LOW CONFIDENCE)' END
ELSE
  CASE WHEN confidence >= 0.9 THEN 'HIGHLY LIKELY AUTHENTIC'
       WHEN confidence >= 0.7 THEN 'LIKELY AUTHENTIC'
       WHEN confidence >= 0.5 THEN 'POSSIBLY AUTHENTIC'
       ELSE 'UNCLEAR - MANUAL REVIEW RECOMMENDED' END
END"""

_HAMMING = """
aggregate(
  zip_with(split(a, '-'), split(b, '-'), (x, y) ->
    coalesce(CASE WHEN x RLIKE '^[0-9A-Fa-f]{1,16}$' AND y RLIKE '^[0-9A-Fa-f]{1,16}$' THEN
      bit_count(CAST(conv(substr(lpad(x, 16, '0'), 1, 8), 16, 10) AS BIGINT)
              ^ CAST(conv(substr(lpad(y, 16, '0'), 1, 8), 16, 10) AS BIGINT))
    + bit_count(CAST(conv(substr(lpad(x, 16, '0'), 9, 8), 16, 10) AS BIGINT)
              ^ CAST(conv(substr(lpad(y, 16, '0'), 9, 8), 16, 10) AS BIGINT)) END, 64)),
  0, (total, bits) -> total + bits)"""

FUNCTIONS = {
    "media_verdict(is_fake BOOLEAN, confidence DOUBLE)": ("STRING", _VERDICT),
    "media_hamming(a STRING, b STRING)": ("INT", _HAMMING),
    "media_ip_hash(ip STRING, salt STRING)": ("STRING", "sha2(concat(salt, ip), 256)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and returns their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature in FUNCTIONS]
