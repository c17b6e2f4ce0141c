"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from palisade.llm import ball_tree, byte_bpe, chat_template, line_dedup, lm, mixing, near_dup, projections, token_counts, toxicity


def queries():
    return {
        "op1_byte_bpe": byte_bpe.query,
        "op2_projections": projections.query,
        "op3_mixing": mixing.query,
        "op4_token_counts": token_counts.query,
        "op5_near_dup": near_dup.query,
        "op6_line_dedup": line_dedup.query,
        "op7_chat_template": chat_template.query,
        "op8_ball_tree": ball_tree.query,
        "op9_toxicity": toxicity.query,
        "op10_language_model": lm.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.oracle_sql(),
        "op6_line_dedup": line_dedup.oracle_sql(),
        "op7_chat_template": chat_template.oracle_sql(),
        "op8_ball_tree": ball_tree.oracle_sql(),
    }
