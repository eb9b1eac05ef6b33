"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from . import (decontaminate, html_extract, jaccard_join, kneser_ney, line_dedup, merkle, mixing, odd_sketch, order_minhash,
               phrases, quality, token_counts, url_filter)

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_order_minhash": order_minhash.op5_order_minhash,
    "op6_quality": quality.op6_quality,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_kneser_ney": kneser_ney.op9_kneser_ney,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_collocations": phrases.op11_collocations,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_odd_sketch": odd_sketch.op13_odd_sketch,
}

ORACLES = {
    "op1_mix": mixing.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op11_collocations": phrases.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
