"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import context_mixing, exact_dedup, hard_negatives, html_text, mixing, packing, pieces, quality, secrets, simhash, token_files, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": pieces.op1_pieces,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm_score": context_mixing.op3_lm_score,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_token_files": token_files.op7_token_files,
    "op8_quality": quality.op8_quality,
    "op9_pack": packing.op9_pack,
    "op10_main_text": html_text.op10_main_text,
    "op11_whitening": whitening.op11_whitening,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_mix": mixing.op13_mix,
}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_mix": mixing.OP13_SQL,
}
