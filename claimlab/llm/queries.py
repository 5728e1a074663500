"""Registered queries of the training-data operators and, where SQL can express them, the SQL they agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlab.llm import (
    best_fit,
    bpe_transducer,
    cost_packing,
    ftrl_toxicity,
    graph_ann,
    language_crf,
    ngram_join,
    quality_rules,
    quotation_links,
    reversed_search,
    token_files,
    turn_repair,
    warc_revisit,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.quality_verdicts,
    "op2_language_crf": language_crf.document_languages,
    "op3_graph_ann": graph_ann.neighbours_of_every_twentieth,
    "op4_cost_packing": cost_packing.packing_digest,
    "op5_ftrl_toxicity": ftrl_toxicity.toxicity_scores,
    "op6_bpe_transducer": bpe_transducer.round_trip_digest,
    "op7_ngram_jaccard": ngram_join.ngram_components,
    "op8_warc_revisit": warc_revisit.revisit_digest,
    "op9_quotation_links": quotation_links.reply_threads,
    "op10_token_files": token_files.token_file_digest,
    "op11_turn_repair": turn_repair.repair_digest,
    "op12_best_fit": best_fit.packing_digest,
    "op13_reversed_search": reversed_search.benchmark_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op7_ngram_jaccard": ngram_join.SQL,
    "op8_warc_revisit": warc_revisit.SQL,
    "op9_quotation_links": quotation_links.SQL,
    "op13_reversed_search": reversed_search.SQL,
}
