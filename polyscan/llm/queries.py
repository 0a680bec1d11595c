"""The training-data queries by name."""

from __future__ import annotations

from polyscan.llm import ann, html, mixing, passages, pieces, quality, shards, simhash, sketches, toxicity

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_simhash": simhash.op2,
    "op3_quality": quality.op3,
    "op4_html": html.op4,
    "op5_ann": ann.op5,
    "op6_toxicity": toxicity.op6,
    "op7_sketches": sketches.op7,
    "op8_passages": passages.op8,
    "op9_pieces": pieces.op9,
    "op10_shards": shards.op10,
}
#: No SQL says what these compute: draws, learned models, peeling, files. tests/llm holds each against a brute-force version.
ORACLES: dict[str, str] = {}
