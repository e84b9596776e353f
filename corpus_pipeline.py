"""The corpus pipeline: documents of quality, by rules too, one of each group of near duplicates,
free of benchmark text, as ids. Each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import decontamination, near_duplicates, piece_codec, quality_classifier, quality_rules
from meterlake.llm.shared import materialize, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality_classifier.keep_good),
    ("quality_rules", quality_rules.keep_good),
    ("near_duplicates", near_duplicates.keep_one),
    ("decontamination", decontamination.clean_stage),
    ("sentencepiece", piece_codec.encode_stage),
]

#: SQL has neither the alignment nor the piece search; a test holds run() against a plain Python version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again.

    Null and empty texts have no words, so the rules let them go; rows that repeat a doc_id and text stay or go
    together, those of a null doc_id go by their text; columns beyond those of documents are carried to the last
    stage, whatever their names; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
