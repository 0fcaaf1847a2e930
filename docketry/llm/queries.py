"""Queries of this subpackage; none has an SQL form that finishes on whole tables."""

from __future__ import annotations

from docketry.llm.byte_bpe import op7_byte_bpe
from docketry.llm.decontaminate import op2_decontaminate
from docketry.llm.embedding_dedup import op1_embedding_dedup
from docketry.llm.language_id import op4_language_id
from docketry.llm.line_dedup import op6_line_dedup
from docketry.llm.minhash_dedup import op10_minhash_dedup
from docketry.llm.pii import op5_pii
from docketry.llm.secrets import op8_secret_scan
from docketry.llm.toxicity import op9_toxicity
from docketry.llm.warc_bundle import op3_warc_bundle

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_bundle": op3_warc_bundle,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_dedup": op10_minhash_dedup,
}

ORACLE_SQL: dict[str, str] = {}
