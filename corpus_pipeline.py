"""The corpus pipeline: what is toxic or a near copy goes, then repeated passages, then benchmark leaks; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, jaccard, lines, templates, toxicity
from quarry.llm.common import stash, table
from quarry.session import ship

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("substring_dedup", lines.stage),
    ("benchmark_decontamination", templates.stage),
    ("bpe_encoding", bpe.stage),
]

#: Models, components and tokenizers are beyond SQL: tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents.

    Rows with a null or empty text, null ids and repeated rows go through as each stage has it: nothing is not toxic, copies of
    one text count as a group of which one stays (and all rows without id), and null texts stay null. An empty table gives none.
    """
    docs = table(ship(spark), sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stash(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
