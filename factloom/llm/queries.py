"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hard_negatives, language_id, license_scan, line_dedup, ngram_jaccard, odd_sketch, packing, secret_scan, substring_dedup, topk_search, toxicity, turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_bestfit_packing": packing.op6_bestfit_packing,
    "op7_language_id": language_id.op7_language_id,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op8_line_dedup_every_run": line_dedup.op8_line_dedup_every_run,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_minhash_dedup": odd_sketch.op12_minhash_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_ngram_jaccard": ngram_jaccard.ORACLE,
    "op5_topk_search": topk_search.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op8_line_dedup_every_run": line_dedup.ORACLE_EVERY_RUN,
    "op10_decontamination": decontaminate.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op12_minhash_dedup": odd_sketch.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
