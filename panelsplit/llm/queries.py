"""The operators' registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from panelsplit.llm.collocation import OP11_SQL, op11_phrase_collocation
from panelsplit.llm.decontam import op6_benchmark_decontamination
from panelsplit.llm.knn import op2_topk_search
from panelsplit.llm.langid import op7_language_id
from panelsplit.llm.licences import op4_license_scan
from panelsplit.llm.lm import op8_lm_scoring
from panelsplit.llm.mixing import OP12_SQL, op12_source_mixing
from panelsplit.llm.neardup import op1_minhash_dedup
from panelsplit.llm.packing import op9_best_fit_packing
from panelsplit.llm.periodic import op13_periodic_runs
from panelsplit.llm.quality import op5_quality_classifier
from panelsplit.llm.secrets import op10_secret_scan
from panelsplit.llm.substring import op3_substring_dedup

_FUNCTIONS = (
    op1_minhash_dedup, op2_topk_search, op3_substring_dedup, op4_license_scan, op5_quality_classifier, op6_benchmark_decontamination,
    op7_language_id, op8_lm_scoring, op9_best_fit_packing, op10_secret_scan, op11_phrase_collocation, op12_source_mixing, op13_periodic_runs)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

#: Oracle SQL by query.
ORACLE: dict[str, str] = {"op11_phrase_collocation": OP11_SQL, "op12_source_mixing": OP12_SQL}
