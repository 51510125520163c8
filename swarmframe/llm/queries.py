"""The queries of the training-data operators and what SQL can say about them."""

from __future__ import annotations

from .chat_format import op6_chat_format
from .decontaminate import op1_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .importance import op12_importance_resampling
from .licenses import op10_license_scan, op10_sql
from .mixing import OP7_SQL, op7_source_mixing
from .near_dup import op8_near_duplicates
from .ngram_join import op11_ngram_join
from .quality_model import op4_quality_classifier
from .quality_rules import op2_quality_rules
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op3_token_counts
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_token_counts, op4_quality_classifier, op5_url_filter, op6_chat_format, op7_source_mixing, op8_near_duplicates, op9_suffix_dedup, op10_license_scan, op11_ngram_join, op12_importance_resampling, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op7_source_mixing": OP7_SQL, "op10_license_scan": op10_sql(), "op13_filter_audit": OP13_SQL}
