"""From raw documents to packed training sequences: toxicity, language, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; `run` writes every result as
Parquet to the folder that executors share and reads it again as the next stage's documents.

The stages have this in common: rows that agree in all columns are rows of their own up to the near duplicates, where one
of them stays; columns besides doc_id, text, lang and source go along unread, whatever their names are; an empty table
gives an empty table with the same columns; long texts are read whole, in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarrow.llm import jaccard, langid, mixing, packing, toxicity
from sonarrow.llm.arrow import column, give_back
from sonarrow.llm.staging import Stage
from sonarrow.session import ship

#: Share of all words that the mix takes, and the most a source may give, in times its size.
SHARE, MOST = 1.0, 2.0


def _row(docs: DataFrame) -> DataFrame:
    """(row, text): what else a row has is one column, so that no name of it is replaced by a computed one."""
    return docs.select(F.struct(*[column(c) for c in docs.columns if c != "text"]).alias("row"), "text")


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from (row, text)."""
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of confirmed toxic and unlabelled ones scores 0.5 or more go.

    Null and empty texts get the prior's score and stay unless half of the labelled documents are toxic. Equal texts stay
    or go together. A null doc_id has no label.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    give_back()
    return _back(toxicity.score(_row(docs), model).where("score < 0.5"), docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told with the calibrated confidence go.

    Null and empty texts and those without a letter go, and all do if no document has text and language. Equal texts stay
    or go together. Null languages teach nothing.
    """
    model = langid.fit(docs)
    give_back()
    return _back(langid.predict(_row(docs), model).where("not rejected"), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more, over links, the one of least doc_id stays.

    Texts that are null or without words are like nothing and stay. A null doc_id comes after all others; of equal ids the
    least text hash stays, and one of fully repeated rows.
    """
    return jaccard.one_of_each(docs, shingle=5, similarity=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources have weights 3, 1, 2 by turns.

    The null source is a source, the last one. Texts without words have size 0 and are taken as often as their places in
    their source say; a source without words is not taken. Rows that agree in doc_id, text and source are one document
    with the copies of all.
    """
    return mixing.emit(docs, share=SHARE, most=MOST)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids that fill windows of 2048; null and empty texts are a piece of the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("near_duplicates", one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Models and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(ship(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage.put(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
