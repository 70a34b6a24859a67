"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from recordcheck.llm.exact import OP8_SQL, op8_exact_dedup
from recordcheck.llm.html import op5_html
from recordcheck.llm.licenses import OP9_SQL, op9_licenses
from recordcheck.llm.minhash import op7_minhash
from recordcheck.llm.negatives import OP11_SQL, op11_negatives
from recordcheck.llm.ngrams import OP4_SQL, op4_backoff
from recordcheck.llm.packing import op3_packing
from recordcheck.llm.pieces import op6_pieces
from recordcheck.llm.simhash import op2_simhash
from recordcheck.llm.spelling import op12_spelling
from recordcheck.llm.topk import OP13_SQL, op13_topk
from recordcheck.llm.toxicity import op10_toxicity
from recordcheck.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_backoff": op4_backoff,
    "op5_html": op5_html,
    "op6_pieces": op6_pieces,
    "op7_minhash": op7_minhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_spelling": op12_spelling,
    "op13_topk": op13_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_backoff": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_licenses": OP9_SQL,
    "op11_negatives": OP11_SQL,
    "op13_topk": OP13_SQL,
}
