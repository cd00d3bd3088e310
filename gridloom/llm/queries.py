"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import (
    embeddings, exact_dedup, fill_middle, fuzzy_lines, mixing, neighbour_graph, ngram_join, packing, pii, quality, repeats,
    token_counts, vector_codes,
)

QUERIES = {
    "op1_quality": quality.query,
    "op2_embeddings": embeddings.query,
    "op3_mixing": mixing.query,
    "op4_token_counts": token_counts.query,
    "op5_repeats": repeats.query,
    "op6_packing": packing.query,
    "op7_ngram_join": ngram_join.query,
    "op8_pii": pii.query,
    "op9_fuzzy_lines": fuzzy_lines.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_fill_middle": fill_middle.query,
    "op12_vector_codes": vector_codes.query,
    "op13_neighbours": neighbour_graph.query,
}
ORACLES = {
    "op2_embeddings": embeddings.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
