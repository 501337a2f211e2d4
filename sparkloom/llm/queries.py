"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.ann import op5_neighbours
from sparkloom.llm.bpe import op3_bpe
from sparkloom.llm.decontaminate import op2_decontamination
from sparkloom.llm.licenses import op10_licenses
from sparkloom.llm.lm import op9_lm_scores
from sparkloom.llm.ranked import RANKED_SQL, op11_ranked
from sparkloom.llm.rolling import ROLLING_SQL, op12_rolling
from sparkloom.llm.sharding import op1_sharding
from sparkloom.llm.simhash import op8_simhash
from sparkloom.llm.suffixes import op6_suffixes
from sparkloom.llm.tokens import op4_token_output
from sparkloom.llm.toxicity import op7_toxicity
from sparkloom.llm.urls import URLS_SQL, op13_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_bpe": op3_bpe,
    "op4_token_output": op4_token_output,
    "op5_neighbours": op5_neighbours,
    "op6_suffixes": op6_suffixes,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_lm_scores": op9_lm_scores,
    "op10_licenses": op10_licenses,
    "op11_ranked": op11_ranked,
    "op12_rolling": op12_rolling,
    "op13_urls": op13_urls,
}

ORACLE_SQL: dict[str, str] = {"op11_ranked": RANKED_SQL.strip(), "op12_rolling": ROLLING_SQL.strip(), "op13_urls": URLS_SQL.strip()}
