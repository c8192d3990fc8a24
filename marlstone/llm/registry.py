"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_transducer, embedding_dedup, exact_dedup, language_id, license_scan, minhash_dedup, packing, secret_scan, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_packing": packing.op3_packing,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_byte_bpe": bpe_transducer.op5_byte_bpe,
        "op6_language_id": language_id.op6_language_id,
        "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
        "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "language_of_pages": language_id.language_of_pages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op2_license_scan": license_scan.SQL, "op7_embedding_dedup": embedding_dedup.SQL, "op8_minhash_dedup": minhash_dedup.SQL, "op9_url_filter": url_filter.SQL}
