"""Queries of the subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from sigmaflow.llm import bpe, chat, decontaminate, hnsw, jaccard, merkle, mixing, order, pii, quality, repeats, toxicity, whitening

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repeats": repeats.op4_repeats,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_hnsw": hnsw.op6_hnsw,
    "op7_chat": chat.op7_chat,
    "op8_pii": pii.op8_pii,
    "op9_order": order.op9_order,
    "op10_quality": quality.op10_quality,
    "op11_whitening": whitening.op11_whitening,
    "op12_bpe": bpe.op12_bpe,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_repeats": repeats.OP4_SQL,
    "op5_jaccard": jaccard.OP5_SQL,
    "op7_chat": chat.OP7_SQL,
    "op9_order": order.OP9_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
