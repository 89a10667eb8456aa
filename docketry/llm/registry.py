"""The queries of this subpackage and the SQL that some of them can be held against."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import chat, decontamination, html_text, mixing, near_dedup, quality, runs, secrets, sharding, token_counts, token_files, top_k, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": decontamination.op1_winnowing,
        "op2_odd_sketch_dedup": near_dedup.op2_odd_sketch_dedup,
        "op3_entropy_mix": mixing.op3_entropy_mix,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_robust_outliers": quality.op5_robust_outliers,
        "op6_page_differencing": html_text.op6_page_differencing,
        "op7_token_files": token_files.op7_token_files,
        "op9_crf_secrets": secrets.op9_crf_secrets,
        "op10_chat_format": chat.op10_chat_format,
        "op8_jump_shards": sharding.op8_jump_shards,
        "op11_dual_cover_tree": top_k.op11_dual_cover_tree,
        "op12_spectrum_slicing": whitening.op12_spectrum_slicing,
        "op13_lyndon_runs": runs.op13_lyndon_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_winnowing": decontamination.OP1_SQL}
