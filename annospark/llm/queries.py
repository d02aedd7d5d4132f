"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from annospark.llm import (
    bpe, chat, decontaminate, hilbert, langid, mixing, pii, quality, simhash, templates, toxicity, variants, whitening,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_dedup": templates.op2_line_dedup,
    "op3_ann": hilbert.op3_ann,
    "op4_bpe": bpe.op4_bpe,
    "op5_pii": pii.op5_pii,
    "op6_simhash": simhash.op6_simhash,
    "op7_language_id": langid.op7_language_id,
    "op8_quality": quality.op8_quality,
    "op9_chat": chat.op9_chat,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_mixing": mixing.op11_mixing,
    "op12_whitening": whitening.op12_whitening,
    "op13_variants": variants.op13_variants,
}

ORACLES = {"op9_chat": chat.OP9_SQL, "op11_mixing": mixing.OP11_SQL}
