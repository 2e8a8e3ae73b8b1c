"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return the columns of documents.

Cases: null and empty texts fail the quality rules; an empty table passes through every stage as an
empty one; repeated rows are judged alike, and near-duplicate groups keep the rows of their smallest id; other
columns stay as they are, except that redaction brings ``n_chars`` up to date where there is one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeprobe.llm import decontaminate, jaccard, packing, pii, quality
from edgeprobe.llm.common import discard, read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the rules' posterior reject go."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id, and every row with a null id."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    own = docs.columns
    clash = {c: f"own_{c}" for c in own if c in ("pii", "pii_redacted")}
    found = pii.with_spans(docs.withColumnsRenamed(clash))
    new = {"text": F.col("pii_redacted"), "n_chars": F.when(F.size("pii") > 0, F.char_length("pii_redacted"))}
    kept = lambda c: F.col(clash.get(c, c))
    return found.select(*[(F.coalesce(new[c].cast(docs.schema[c].dataType), kept(c)) if c in new else kept(c)).alias(c) for c in own])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Stages learn by expectation-maximisation, follow links and run a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; what has been read is removed."""
    docs, paths = read_table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, paths = paths, []
            docs = written(docs, name, paths)
            discard(spark, before)
    return docs
