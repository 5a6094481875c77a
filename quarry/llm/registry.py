"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, ctw, flac, jaccard, lines, negatives, pieces, templates, toxicity, unigram, urlrules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac": flac.op1_flac,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_url_rules": urlrules.op3_url_rules,
    "op4_warc": warc.op4_warc,
    "op5_substring_dedup": lines.op5_substring_dedup,
    "op6_token_counts": unigram.op6_token_counts,
    "op7_context_tree": ctw.op7_context_tree,
    "op8_template_decontamination": templates.op8_template_decontamination,
    "op9_bpe_encoding": bpe.op9_bpe_encoding,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
