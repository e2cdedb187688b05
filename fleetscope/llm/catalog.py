"""The registered queries of this package and the check queries of those SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm.op01_language_id import op1_language_id
from fleetscope.llm.op02_bpe import op2_bpe
from fleetscope.llm.op03_setsketch import op3_setsketch
from fleetscope.llm.op04_html_wrapper import op4_html_wrapper
from fleetscope.llm.op05_decontamination import SQL as DECONTAMINATION
from fleetscope.llm.op05_decontamination import op5_decontamination
from fleetscope.llm.op06_license_scan import op6_license_rules
from fleetscope.llm.op07_lm_scoring import op7_context_mixing
from fleetscope.llm.op08_quality_gam import op8_quality_gam
from fleetscope.llm.op09_secret_scan import op9_secret_scan
from fleetscope.llm.op10_quality_rules import op10_line_rules
from fleetscope.llm.op11_spelling import op11_spelling
from fleetscope.llm.op12_repeated_phrases import SQL as REPEATED_PHRASES
from fleetscope.llm.op12_repeated_phrases import op12_repeated_phrases
from fleetscope.llm.op13_hard_negatives import SQL as HARD_NEGATIVES
from fleetscope.llm.op13_hard_negatives import op13_hard_negatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_setsketch": op3_setsketch,
    "op4_html_wrapper": op4_html_wrapper,
    "op5_decontamination": op5_decontamination,
    "op6_license_rules": op6_license_rules,
    "op7_context_mixing": op7_context_mixing,
    "op8_quality_gam": op8_quality_gam,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_rules": op10_line_rules,
    "op11_spelling": op11_spelling,
    "op12_repeated_phrases": op12_repeated_phrases,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {"op5_decontamination": DECONTAMINATION, "op12_repeated_phrases": REPEATED_PHRASES, "op13_hard_negatives": HARD_NEGATIVES}
