"""A training-data pipeline over ``documents``.

Four stages, each over all that its predecessor kept:

1. language identification: documents go that have no letter, or whose trigrams
   would be likelier if all were equally likely than in the learned languages they
   are nearest to (a test that means the same for any number of languages);
2. near-duplicate removal: one document of each class stays, the one with the
   smallest ``doc_id``;
3. benchmark decontamination: documents that hold a benchmark window go;
4. byte-level BPE: the ids of each document's whole text.

Every stage but the last returns the columns of ``documents``.  Nulls: a null text
has no language and goes in stage 1; a null ``doc_id`` is kept apart by its text
(equal and near texts of null ids only: one stays).  Repeated rows: one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.llm import bpe, dartminhash, decontam, langid
from wideframe.llm._text import fresh_path

#: SQL cannot state the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and the rest of the row as one column, so that no other name can clash."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(packed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of documents again."""
    return packed.select(*[F.col(text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    found = langid.predict(_packed(docs), langid.train(docs), ["text", "row"])
    return _unpacked(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("margin") > 0)), docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dartminhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.search(_packed(docs), benchmark, ["row"], cut=True)  # nothing is cut from a text without hits
    return _unpacked(found.where("n_hit = 0"), docs.columns, "cleaned")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, ["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
