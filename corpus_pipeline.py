"""Corpus pipeline: quality, near duplicates, benchmark contamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its decisions take
effect. All but the last return the columns of ``documents``:

1. quality: rows that the classifier rejects go (labels are learned from as in the quality query);
2. near_duplicates: of every group one document stays (five-word shingles, similarity 0.8);
3. decontamination: documents with a window within the edit bound of a benchmark item go;
4. secrets: spans of secrets are masked in the text;
5. packing: the texts become token pieces placed in sequences of at most 1,024 tokens.

Null, empty, very long and repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelsplit.llm.common import store, table
from panelsplit.llm.decontam import without_contaminated
from panelsplit.llm.neardup import without_near_duplicates
from panelsplit.llm.packing import pack_documents
from panelsplit.llm.quality import fit_quality, keep_good, learnable
from panelsplit.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit_quality(docs, learnable(table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packing)]

#: Trained scores, sketches, edit distances and token ids have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
