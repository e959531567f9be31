"""The registered queries of this subpackage, and their SQL for DuckDB where there is any."""

from __future__ import annotations

from . import bpe, embedding_dedup, hnsw, language_id, line_dedup, mixing, near_dedup, token_files, toxicity, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_language_id": language_id.op2,
        "op3_near_dedup": near_dedup.op3,
        "op4_source_mixing": mixing.op4,
        "op5_toxicity": toxicity.op5,
        "op6_warc": warc.op6,
        "op7_embedding_dedup": embedding_dedup.op7,
        "op8_byte_bpe": bpe.op8,
        "op9_token_files": token_files.op9,
        "op10_hnsw": hnsw.op10,
    }


def oracle_sql() -> dict[str, str]:
    """Trained models, sketches and tokenizers can't be put in SQL; tests hold them against plain Python or the libraries."""
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op4_source_mixing": mixing.OP4_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_embedding_dedup": embedding_dedup.OP7_SQL,
        "op10_hnsw": hnsw.OP10_SQL,
    }
