"""A corpus pipeline over ``documents``: rules, languages, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import langid
from tidemark.llm.common import remove, stored
from tidemark.llm.mixing import by_place, mixed
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.quality import passed
from tidemark.llm.sentencepiece_scan import encode
from tidemark.llm.unigram import Vocabulary

#: The least share, of all languages', of a document's own ones together, for it to stay.
LANGUAGE_SHARE = 0.4
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie outside the compression bands."""
    return passed(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language, or whose languages, one or more, have less than LANGUAGE_SHARE together."""
    return langid.recognised(docs, langid.fit(docs), LANGUAGE_SHARE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: 0.8 of the five-word shingles; of rows with the same id and text, one."""
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("__id"))
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not twice.isEmpty():
        docs = docs.where("doc_id is null").union(docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the documents out so that sources follow their target weights from the first block on."""
    return mixed(docs, "doc_id", "source")


def in_file_order(docs: DataFrame) -> DataFrame:
    """Add ``position``, from 0: the place in the numbered files that a stage has written, which keep the order that a scan does not.

    A frame that is not read from files has the places that the mixture would give it.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "position"]
    try:
        read = docs.select(*columns, F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).cast("long").alias("__file"), F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return mixed(docs, "doc_id", "source", position="position")
    files = read.groupBy("__file", "__name").agg(F.count(F.lit(1)).alias("n"))
    before = files.select(F.col("__name").alias("name"), (F.sum("n").over(Window.orderBy("__file", "__name")) - F.col("n")).alias("__before"))  # one row a file
    placed = read.join(F.broadcast(before), F.col("__name") == F.col("name"))
    return placed.select(*columns, (F.col("__before") + F.col("__row")).alias("position"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, in the order of the mixture, with the place in it as ``position``."""
    found = encode(in_file_order(docs), Vocabulary.read(PIECES), keep=["doc_id", "lang", "source", "position"], verify=True)
    found = found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "position")
    return by_place(found, "position", docs.count())


STAGES = [
    ("quality rules", quality_rules),
    ("language id", languages),
    ("near duplicates", deduplicate),
    ("mixture", mixture),
    ("sentencepiece", tokens),
]

#: zstandard, expectation-maximisation and tokens have no SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; a stage's table goes as soon as the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), "stage")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
