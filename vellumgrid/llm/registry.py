"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from vellumgrid.llm import chat_format, embedding_dedup, license_scan, line_dedup, quality_rules
from vellumgrid.llm.chat_format import op4_chat_formatting
from vellumgrid.llm.embedding_dedup import op8_embedding_dedup
from vellumgrid.llm.license_scan import op2_license_scan
from vellumgrid.llm.line_dedup import op3_line_dedup
from vellumgrid.llm.packing import op5_best_fit_packing
from vellumgrid.llm.quality_classifier import op6_quality_classifier
from vellumgrid.llm.quality_rules import op7_quality_rules
from vellumgrid.llm.segmentation import op10_segmentation
from vellumgrid.llm.simhash import op9_simhash
from vellumgrid.llm.substring_dedup import op1_substring_dedup

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_line_dedup, op4_chat_formatting, op5_best_fit_packing, op6_quality_classifier, op7_quality_rules, op8_embedding_dedup, op9_simhash, op10_segmentation)}
ORACLES: dict[str, str] = {"op2_license_scan": license_scan.ORACLE, "op4_chat_formatting": chat_format.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op8_embedding_dedup": embedding_dedup.ORACLE}
