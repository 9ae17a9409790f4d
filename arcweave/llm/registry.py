"""The queries of this subpackage, by name, and the SQL that says the same."""

from __future__ import annotations

from arcweave.llm import minhash, mixing, packing, pii, simhash, substring, topk, toxicity, warc, wavelet

_ALL = {
    "op4_warc": (warc.op4_warc, warc.OP4_SQL),
    "op9_pii": (pii.op9_pii, None),
    "op8_toxicity": (toxicity.op8_toxicity, None),
    "op6_minhash": (minhash.op6_minhash, None),
    "op5_packing": (packing.op5_packing, None),
    "op10_wavelet": (wavelet.op10_wavelet, None),
    "op1_mixing": (mixing.op1_mixing, mixing.OP1_SQL),
    "op7_topk": (topk.op7_topk, topk.OP7_SQL),
    "op3_simhash": (simhash.op3_simhash, None),
    "op2_substring_dedup": (substring.op2_substring_dedup, substring.OP2_SQL),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
