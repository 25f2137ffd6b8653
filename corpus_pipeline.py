"""Corpus cleaning in five stages: toxic documents go, repeated lines go, near duplicates go, leaked
documents go, and what is left is encoded.

Each stage is (name, function) in STAGES; a function takes (spark, docs, sf_dir) and returns a table,
which run() writes as Parquet in the shared folder and rereads as the next stage's docs. All stages
but the last return the columns of documents. ORACLE_SQL is None: SQL can't express the toxicity
model, the alignments or the tokenizer, so the tests hold every stage against brute force instead.

Null texts stay null and count as empty; rows that repeat both doc_id and text, and texts that are equal or
empty, are near duplicates of each other, of which the least doc_id stays; a null doc_id is an id like others,
the last one. Empty tables give none; without labels no document is toxic, without benchmark items none is
leaked. Other columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import bpe, common, decontaminate, lines, neardup, toxicity

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("line_dedup", lines.keep_lines),
    ("minhash_neardup", neardup.keep_one),
    ("decontamination", decontaminate.keep_unleaked),
    ("bpe", bpe.add_tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has stored is dropped as soon as its result has been written."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in STAGES:
        docs, path = common.stored(stage(spark, docs, sf_dir))
        common.sweep(spark, path)
    return docs
