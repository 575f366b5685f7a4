"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import asof, chat_format, exact_dedup, filter_audit, sql
from .asof import op11_tolerant_asof
from .bpe import op9_bpe_encoding
from .chat_format import op7_chat_formatting
from .exact_dedup import op12_exact_dedup
from .filter_audit import op13_filter_audit
from .license_scan import op10_license_scan
from .line_dedup import op8_line_dedup
from .media import op1_media_columns
from .ngram_join import op6_ngram_join
from .packing import op5_best_fit_packing
from .quality import op4_quality_rules
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op2_suffix_array_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_suffix_array_dedup,
        op3_substring_dedup,
        op4_quality_rules,
        op5_best_fit_packing,
        op6_ngram_join,
        op7_chat_formatting,
        op8_line_dedup,
        op9_bpe_encoding,
        op10_license_scan,
        op11_tolerant_asof,
        op12_exact_dedup,
        op13_filter_audit,
    )
}
ORACLE_SQL = {
    "op2_suffix_array_dedup": sql.SUFFIX_DEDUP,
    "op3_substring_dedup": sql.SUBSTRING_DEDUP,
    "op6_ngram_join": sql.NGRAM_JOIN,
    "op7_chat_formatting": chat_format.SQL,
    "op8_line_dedup": sql.LINE_DEDUP,
    "op11_tolerant_asof": asof.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
