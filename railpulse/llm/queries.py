"""Queries of the text operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railpulse.llm import conversation_repair, fill_middle, warc
from railpulse.llm.byte_bpe import op7_byte_bpe
from railpulse.llm.decontamination import op10_decontamination
from railpulse.llm.conversation_repair import op13_conversation_repair
from railpulse.llm.fill_middle import op11_fill_middle
from railpulse.llm.hmm_scoring import op4_hmm_scoring
from railpulse.llm.license_scan import op2_license_scan
from railpulse.llm.ngram_join import op3_ngram_join
from railpulse.llm.packing import op12_packing
from railpulse.llm.quality_rules import op5_quality_rules
from railpulse.llm.secret_scan import op1_secret_scan
from railpulse.llm.sharding import op6_sharding
from railpulse.llm.toxicity import op8_toxicity
from railpulse.llm.warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_license_scan, op3_ngram_join, op4_hmm_scoring, op5_quality_rules, op6_sharding, op7_byte_bpe, op8_toxicity, op9_warc,
        op10_decontamination, op11_fill_middle, op12_packing, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": warc.ORACLE_SQL, "op11_fill_middle": fill_middle.ORACLE_SQL, "op13_conversation_repair": conversation_repair.ORACLE_SQL}
