"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Counts as part of the subpackage ``tidemark.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language_id, line_dedup, mixing, near_dedup
from tidemark.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document goes if no language of the learned ones reaches this probability.
LEAST_SCORE = 0.4
#: Tokens to keep, in percent of what the stage is given; no document is repeated.
MIX_PERCENT, MIX_SEED = 80, "11"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: null text, no letter, or no language of probability ``LEAST_SCORE``.

    The others keep their text, however long, and the language that they are
    labelled with; those without a label get the one that was found, so that later
    stages have one for each document. Rows of one id stay as many as they are, and
    an empty table gives an empty one. Further columns of ``docs`` go.
    """
    docs = docs.select(*COLUMNS)
    network = language_id.learn(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    out = language_id.identify(docs, network)
    out = out.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out lines that a document of smaller id has; a document all of whose lines go, goes.

    Null text is one empty line, which stays. Rows of one id are one document,
    rows without an id one that comes last; an empty table gives an empty one.
    Further columns of ``docs`` go.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = out.where((F.col("n_dropped") == 0) | (F.length("kept_text") > 0))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each class of near copies.

    Of rows with the same id and text one stays, the smallest by the other
    columns. Rows that share an id and have different texts all stay. Documents
    without an id or without a word (null, empty, blank) stay as they are. An empty
    table gives an empty one. Further columns of ``docs`` go.
    """
    kept = near_dedup.near_dedup(docs.select(*COLUMNS)).where("kept")
    named, nameless = kept.where("doc_id IS NOT NULL"), kept.where("doc_id IS NULL")
    rest = COLUMNS[2:]
    once = named.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", *(F.col("rest")[c].alias(c) for c in rest))
    return once.unionByName(nameless.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose documents so that the tokens of domains, languages and sources come as near to the target weights as the corpus allows.

    Null, empty and blank texts have no tokens and go. A missing language or source
    counts as one of its own. Rows of one id in one source stay or go together. A
    document is one unit, however long. An empty table gives an empty one. Further
    columns of ``docs`` go.
    """
    docs = docs.select(*COLUMNS).where(F.col("text").rlike(mixing.TOKEN))
    plan = mixing.plan(docs, mixing.source_levels(), F.floor(F.col("total") * F.lit(MIX_PERCENT) / 100), MIX_SEED)
    return plan.take(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to.

    Null text is empty; every row gives a row, those of one id too, and an empty
    table none. Texts are encoded whole. Further columns of ``docs`` go.
    """
    return bpe.digest_table(docs, *bpe.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is kept below the shared folder."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
