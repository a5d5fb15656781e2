"""The thin queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from functools import partial

import public_tokenizers

from cadaspark.llm import conversations, exact_dedup, line_dedup, media, mixing, near_dedup, packing, phrases, quality, token_counts, token_files, toxicity, url_filter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1,
        "op2_token_files": partial(token_files.op2, tokenizer=TOKENIZER),
        "op3_toxicity": toxicity.op3,
        "op4_media": media.op4,
        "op5_best_fit_packing": partial(packing.op5, tokenizer=TOKENIZER),
        "op6_token_counts": partial(token_counts.op6, tokenizer=TOKENIZER),
        "op7_mixing": mixing.op7,
        "op8_quality": quality.op8,
        "op9_line_dedup": line_dedup.op9,
        "op10_near_dedup": near_dedup.op10,
        "op11_conversations": conversations.op11,
        "op12_url_filter": url_filter.op12,
        "op13_phrases": phrases.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op11_conversations": conversations.OP11_SQL, "op13_phrases": phrases.OP13_SQL}
