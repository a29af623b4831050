"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cairn.llm import op10_topk as top_k
from cairn.llm import op11_hard_negatives as negatives
from cairn.llm.op1_quality import op1_quality
from cairn.llm.op2_token_files import op2_token_files
from cairn.llm.op3_mixing import op3_mixing
from cairn.llm.op4_bpe import op4_bpe
from cairn.llm.op5_repeats import op5_repeats
from cairn.llm.op6_fingerprint import op6_fingerprint
from cairn.llm.op7_ctw import op7_ctw
from cairn.llm.op8_near_duplicates import op8_near_duplicates
from cairn.llm.op9_pii import op9_pii
from cairn.llm.op12_spelling import op12_spelling
from cairn.llm.op13_decontaminate import op13_decontaminate

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_token_files, op3_mixing, op4_bpe, op5_repeats, op6_fingerprint, op7_ctw, op8_near_duplicates, op9_pii, top_k.op10_topk,
        negatives.op11_hard_negatives, op12_spelling, op13_decontaminate,
    )
}

ORACLE_SQL: dict[str, str] = {"op10_topk": top_k.ORACLE_SQL, "op11_hard_negatives": negatives.ORACLE_SQL}
