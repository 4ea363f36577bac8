"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from kpiforge.llm.chat import op2_chat_formatting
from kpiforge.llm.collocations import ORACLE_SQL as COLLOCATIONS_SQL
from kpiforge.llm.collocations import op13_phrase_collocations
from kpiforge.llm.decontaminate import op9_benchmark_decontamination
from kpiforge.llm.jaccard import ORACLE_SQL as JACCARD_SQL
from kpiforge.llm.jaccard import op3_ngram_jaccard_join
from kpiforge.llm.langid import op1_language_id
from kpiforge.llm.licenses import ORACLE_SQL as LICENSES_SQL
from kpiforge.llm.licenses import op8_license_scans
from kpiforge.llm.lines import ORACLE_SQL as LINES_SQL
from kpiforge.llm.lines import op10_line_dedup
from kpiforge.llm.merkle import ORACLE_SQL as MERKLE_SQL
from kpiforge.llm.merkle import op11_merkle_manifest
from kpiforge.llm.ngram_lm import op5_lm_scoring
from kpiforge.llm.packing import op6_best_fit_packing
from kpiforge.llm.pieces import op12_sentencepiece_codec
from kpiforge.llm.repetition import op7_quality_rules
from kpiforge.llm.suffixes import op4_suffix_array_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scans": op8_license_scans,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece_codec": op12_sentencepiece_codec,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": JACCARD_SQL,
    "op8_license_scans": LICENSES_SQL,
    "op10_line_dedup": LINES_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
    "op13_phrase_collocations": COLLOCATIONS_SQL,
}
