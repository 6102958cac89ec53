"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from ebbtide.llm.conversation_repair import op11_conversation_repair
from ebbtide.llm.divergence_audit import OP12_SQL, op12_divergence_audit
from ebbtide.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from ebbtide.llm.harmonic_packing import op13_harmonic_packing
from ebbtide.llm.line_dedup import OP5_SQL, op5_line_dedup
from ebbtide.llm.metric_join import op3_metric_join
from ebbtide.llm.mixing import op4_source_mixing
from ebbtide.llm.packing import op6_best_fit_packing
from ebbtide.llm.quality_classifier import op7_quality_classifier
from ebbtide.llm.simhash import op9_simhash_dedup
from ebbtide.llm.suffix_dedup import op2_suffix_dedup
from ebbtide.llm.token_files import op8_token_files
from ebbtide.llm.tool_calls import OP10_SQL, op10_tool_calls

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_metric_join": op3_metric_join,
    "op4_source_mixing": op4_source_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_files": op8_token_files,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_tool_calls": op10_tool_calls,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_harmonic_packing": op13_harmonic_packing,
}

ORACLE = {
    "op1_exact_dedup": OP1_SQL,
    "op5_line_dedup": OP5_SQL,
    "op10_tool_calls": OP10_SQL,
    "op12_divergence_audit": OP12_SQL,
}
