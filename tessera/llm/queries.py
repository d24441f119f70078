"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.decontaminate import op6_decontamination
from tessera.llm.line_dedup import OP5_SQL, op5_line_dedup
from tessera.llm.pii import op7_pii
from tessera.llm.sentencepiece_codec import op4_sentencepiece
from tessera.llm.simhash_dedup import op8_simhash_neardup
from tessera.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from tessera.llm.token_counts import op3_token_counts
from tessera.llm.toxicity import op10_toxicity
from tessera.llm.url_filter import op2_url_filter
from tessera.llm.vafile import OP9_SQL, op9_exact_topk

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_simhash_neardup": op8_simhash_neardup,
    "op9_exact_topk": op9_exact_topk,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op1_suffix_dedup": OP1_SQL,
    "op5_line_dedup": OP5_SQL,
    "op9_exact_topk": OP9_SQL,
}
