"""Every query of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidebook.llm import queries_chat, queries_fingerprints, queries_join, queries_language, queries_mixing, queries_packing, queries_quality, queries_repeats, queries_site, queries_toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": queries_mixing.op1_mix_sources,
        "op2_pack_documents": queries_packing.op2_pack_documents,
        "op3_toxicity": queries_toxicity.op3_toxicity,
        "op4_quality_rules": queries_quality.op4_quality_rules,
        "op5_fingerprints": queries_fingerprints.op5_fingerprints,
        "op6_ngram_join": queries_join.op6_ngram_join,
        "op7_language": queries_language.op7_language,
        "op8_repeats": queries_repeats.op8_repeats,
        "op9_chat": queries_chat.op9_chat,
        "op10_site_quality": queries_site.op10_site_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    """DuckDB SQL by query."""
    return {"op4_quality_rules": queries_quality.SQL, "op5_fingerprints": queries_fingerprints.SQL}
