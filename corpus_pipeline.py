"""A training corpus from raw documents: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before kept, and returns a DataFrame. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import langid, packing, quality, simhash
from tickforge.llm.common import discard, materialize, remainder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected where less than this share of its letters is in its main language, or it has none.
LEAST_SHARE = 0.35


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, learned from the labels of documents outside the held-out fifth, accepts. Null and empty texts
    are scored like any other; rows that repeat share their fate; without labels every document stays."""
    ranking = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return quality.score(docs, ranking, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in one of the learned languages. Texts that are null, empty or without a letter go; rows that repeat share
    their fate; where no document has a language, none stays."""
    model = langid.learn(docs, remainder(F.col("doc_id"), 4) != 2)
    found = langid.identify(docs, model, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, the one of the smallest doc_id: texts whose sets of five-word shingles have a
    similarity of 0.8 or more. Texts without words (null ones too) are copies of each other."""
    return simhash.one_of_each(docs, COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, packed. A null or empty text is a piece of the end alone; each of repeated rows is packed."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Learned scores and similarities aren't within SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order over documents, each result written to the shared folder and read by the next."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, at = materialize(docs, name)
            if before:
                discard(spark, before)
            before = at
    return docs
