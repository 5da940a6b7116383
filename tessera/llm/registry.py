"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import divergence, negatives, windows
from tessera.llm.bpe import op6_bpe
from tessera.llm.divergence import op13_divergence
from tessera.llm.jaccard import op9_jaccard
from tessera.llm.language import language_of_pages, op4_language
from tessera.llm.media import op3_media
from tessera.llm.negatives import op11_negatives
from tessera.llm.packing import op10_packing
from tessera.llm.secrets import op7_secrets
from tessera.llm.simhash import op5_simhash
from tessera.llm.suffixes import op8_suffixes
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.warc import op2_warc
from tessera.llm.windows import op12_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_media": op3_media,
    "op4_language": op4_language,
    "language_of_pages": language_of_pages,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_suffixes": op8_suffixes,
    "op9_jaccard": op9_jaccard,
    "op10_packing": op10_packing,
    "op11_negatives": op11_negatives,
    "op12_windows": op12_windows,
    "op13_divergence": op13_divergence,
}

_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS BIGINT) << CAST(4 - j AS BIGINT))) AS BIGINT), 1)), '')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages), b AS (SELECT *, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
      SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != last THEN last END AS refers_to, true AS intact FROM b""",
    "op11_negatives": negatives.SQL,
    "op12_windows": windows.SQL,
    "op13_divergence": divergence.SQL,
}
