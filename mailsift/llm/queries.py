"""The registered queries of the subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from mailsift.llm.op1_secrets import op1_secrets
from mailsift.llm.op2_langid import op2_langid
from mailsift.llm.op3_packing import op3_packing
from mailsift.llm.op4_html import op4_html
from mailsift.llm.op5_simhash import op5_simhash
from mailsift.llm.op6_toxicity import op6_toxicity
from mailsift.llm.op7_lm import op7_lm
from mailsift.llm.op8_quality import op8_quality
from mailsift.llm.op9_decontamination import op9_decontamination
from mailsift.llm.op10_binary import op10_binary
from mailsift.llm.op11_codes import op11_codes
from mailsift.llm.op12_alignment import op12_alignment
from mailsift.llm.op13_embeddings import op13_embeddings
from mailsift.llm.oracle import ORACLE

QUERIES = {f.__name__: f for f in (op1_secrets, op2_langid, op3_packing, op4_html, op5_simhash, op6_toxicity, op7_lm, op8_quality,
                                   op9_decontamination, op10_binary, op11_codes, op12_alignment, op13_embeddings)}

__all__ = ["ORACLE", "QUERIES"]
