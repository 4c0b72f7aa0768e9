"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.alignment import op12_token_alignment
from lexweave.llm.audit import OP13_SQL, op13_filter_audit
from lexweave.llm.bpe import op6_byte_bpe
from lexweave.llm.embeddings import OP1_SQL, op1_collision_projections
from lexweave.llm.lines import op11_line_labelling
from lexweave.llm.lm import op4_context_mixing
from lexweave.llm.media import op7_media_sniffing
from lexweave.llm.mixing import OP2_SQL, op2_curriculum_mix
from lexweave.llm.ngrams import OP10_SQL, op10_divide_skip
from lexweave.llm.quality import op8_compression_quality
from lexweave.llm.secrets import op9_secret_entropy
from lexweave.llm.toxicity import op5_noisy_or_toxicity
from lexweave.llm.urls import OP3_SQL, op3_link_graph


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_collision_projections": op1_collision_projections,
        "op2_curriculum_mix": op2_curriculum_mix,
        "op3_link_graph": op3_link_graph,
        "op4_context_mixing": op4_context_mixing,
        "op5_noisy_or_toxicity": op5_noisy_or_toxicity,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_media_sniffing": op7_media_sniffing,
        "op8_compression_quality": op8_compression_quality,
        "op9_secret_entropy": op9_secret_entropy,
        "op10_divide_skip": op10_divide_skip,
        "op11_line_labelling": op11_line_labelling,
        "op12_token_alignment": op12_token_alignment,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_collision_projections": OP1_SQL, "op2_curriculum_mix": OP2_SQL, "op3_link_graph": OP3_SQL, "op10_divide_skip": OP10_SQL, "op13_filter_audit": OP13_SQL}
