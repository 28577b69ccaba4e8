"""The training-data pipeline: stages over `documents`, each written as a table and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm.common import materialize, table
from siteloom.llm.decontaminate import uncontaminated
from siteloom.llm.jaccard import one_of_each
from siteloom.llm.language import known_language
from siteloom.llm.packing import packed
from siteloom.llm.toxicity import clean_documents

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", clean_documents),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: A trained model decides in the first stages, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
