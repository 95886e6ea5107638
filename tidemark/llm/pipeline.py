"""The corpus pipeline: from documents to the pieces of a mixed, deduplicated training set.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame that is written as Parquet and read again. All stages but the last
return the columns of `documents`.

1. quality: documents that the co-trained classifier rejects go.
2. near_duplicates: one document of each component of the Jaccard join stays, the one
   with the least id.
3. personal_data: confirmed spans of personal data become marks; n_chars follows the text.
4. mixing: sources are mixed to their target weights; a document comes as often as the mix
   takes it, its last copy cut to the words that are left of the source's quota.
5. pieces: the SentencePiece pieces of every document.

Defined results
---------------
* quality: without labels of both classes all rows stay; null texts, sources, languages and
  lengths count as in `quality`; repeated rows share their fate.
* near_duplicates: rows without id or words all stay; rows that repeat an id are one document.
* personal_data: null texts stay null, and so does their n_chars.
* mixing: rows without words go, since the mix takes no words of them; a null source is a
  source of its own; repeated rows are mixed as documents each.
* pieces: a row each for all mixed rows; null texts, of which mixing leaves none, have null pieces.
* extra columns stay to the last stage but one, whatever their names; an empty table gives
  no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, mixing, pieces, pii
from . import quality as quality_classifier
from .common import Scratch, table

def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars as the length of the text, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The result reads tables of scratch. Whoever gives it clears it once the result is written;
    where none is given the tables are the result's own and stay until the program ends.
    """
    return jaccard_join.deduplicate(docs, scratch=scratch)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pii.mask(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(mixing.materialise(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).select("doc_id", "n_pieces", "pieces", "round_trip")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage is written to the shared folder and read again.

    A stage's tables go as soon as its successor's are written; the last but one stays for the result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        own = {"scratch": Scratch(spark, name)} if stage is near_duplicates else {}
        docs = scratch.save(stage(spark, docs, sf_dir, **own), name)
        for tables in own.values():
            tables.clear()
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
