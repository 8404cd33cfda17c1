"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path

from kinseg.llm import exact, fertility, packing, simhash, toxicity
from kinseg.llm.shared import clean, folder, table, written

WORK = "pipeline-work"


def stage(function):
    """A stage that first deletes the working tables of the stage before, whose result is written by then."""

    @wraps(function)
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clean(spark, WORK)
        with folder(WORK):
            return function(spark, docs, sf_dir)

    return apply


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the base rules or the fertility bands reject go.

    Null and empty texts fail the base rules and go. Repeated rows are judged alike. Empty in, empty out.
    """
    return fertility.keep_sound(docs, path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken"))


@stage
def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go. The labelled texts come from the raw documents.

    Without labels of both kinds nothing goes. Repeated rows are judged alike. Empty in, empty out.
    """
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of texts equal after lowering A-Z the row with the largest doc_id stays; of identical rows, one.

    Null and empty texts are equal. Empty in, empty out.
    """
    return exact.drop_exact(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near copies the row with the smallest doc_id stays, a null id only where there is no other.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Multi-index
    hashing of SimHash fingerprints and sampled shingles find them; the whole texts decide. Null and
    empty texts are one group; of repeated rows one stays. Empty in, empty out.
    """
    return simhash.drop_near(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every remaining document in windows of at most 2048 tokens, one row per piece.

    A null or empty text is its end alone; repeated rows are packed as they come. Empty in, empty out.
    """
    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("toxicity", civil), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("packing", packed)]

#: Tokenisers and a trained model decide, which SQL cannot express; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
