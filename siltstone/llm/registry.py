"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from siltstone.llm import sql
from siltstone.llm.conversation_repair import op13_conversation_repair
from siltstone.llm.decontamination import op9_decontamination
from siltstone.llm.fill_in_middle import op11_fill_in_middle
from siltstone.llm.jaccard_join import op6_ngram_jaccard_join
from siltstone.llm.lm_scoring import op1_lm_scoring
from siltstone.llm.packing import op4_best_fit_packing
from siltstone.llm.personal_data import op12_personal_data
from siltstone.llm.quality_classifier import op3_quality_classifier
from siltstone.llm.quality_rules import op8_quality_rules
from siltstone.llm.secret_scan import op2_secret_scans
from siltstone.llm.substring_dedup import op5_substring_dedup
from siltstone.llm.suffix_array import op10_suffix_array
from siltstone.llm.token_output import op7_token_output


def queries() -> dict:
    found = [op1_lm_scoring, op2_secret_scans, op3_quality_classifier, op4_best_fit_packing, op5_substring_dedup, op6_ngram_jaccard_join, op7_token_output, op8_quality_rules, op9_decontamination, op10_suffix_array, op11_fill_in_middle, op12_personal_data, op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": sql.SUBSTRING_DEDUP, "op6_ngram_jaccard_join": sql.JACCARD_JOIN, "op10_suffix_array": sql.SUFFIX_ARRAY, "op11_fill_in_middle": sql.FILL_IN_MIDDLE, "op13_conversation_repair": sql.CONVERSATION_REPAIR}
