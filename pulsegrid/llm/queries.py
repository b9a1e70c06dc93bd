"""The queries of this package by name, and their checking SQL where SQL can express them."""

from __future__ import annotations

from pulsegrid.llm.chat import op10_chat_format
from pulsegrid.llm.decontaminate import op4_decontamination
from pulsegrid.llm.imatch import op7_imatch
from pulsegrid.llm.jaccard import op2_jaccard_join
from pulsegrid.llm.language import op1_language_id
from pulsegrid.llm.negatives import OP11_SQL, op11_hard_negatives
from pulsegrid.llm.packing import op12_packing
from pulsegrid.llm.pieces import op6_sentencepiece
from pulsegrid.llm.secret_scan import op9_secret_scan
from pulsegrid.llm.shards import op3_rendezvous_shards
from pulsegrid.llm.spelling import op13_spelling_variants
from pulsegrid.llm.suffixes import op8_suffix_dedup
from pulsegrid.llm.toxicity import op5_toxicity

QUERIES = {
    query.__name__: query
    for query in (op1_language_id, op2_jaccard_join, op3_rendezvous_shards, op4_decontamination, op5_toxicity, op6_sentencepiece, op7_imatch, op8_suffix_dedup, op9_secret_scan, op10_chat_format, op11_hard_negatives, op12_packing, op13_spelling_variants)
}

ORACLES: dict[str, str] = {"op11_hard_negatives": OP11_SQL}
