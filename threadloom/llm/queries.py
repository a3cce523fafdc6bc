"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.bpe_codec import op6_bpe_codec
from threadloom.llm.chat_format import OP9_SQL, op9_chat_format
from threadloom.llm.cross_polytope import op10_cross_polytope
from threadloom.llm.decontaminate import op4_decontaminate
from threadloom.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from threadloom.llm.language_id import op2_language_id
from threadloom.llm.lm_scoring import op8_lm_scoring
from threadloom.llm.pii import op3_pii
from threadloom.llm.suffix_dedup import op7_suffix_dedup
from threadloom.llm.token_counts import op1_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_language_id": op2_language_id,
        "op3_pii": op3_pii,
        "op4_decontaminate": op4_decontaminate,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_bpe_codec": op6_bpe_codec,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_chat_format": op9_chat_format,
        "op10_cross_polytope": op10_cross_polytope,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": OP5_SQL, "op9_chat_format": OP9_SQL}
