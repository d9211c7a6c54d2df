"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Null texts count as empty ones and null sources as a source of their own; rows with a null doc_id are
documents like others; empty tables give empty results; further columns pass through all stages but the
last. Texts are taken whole, whatever their length; ties go by doc_id, then by the rows' other columns, so
that reruns keep the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bin_slack, line_dedup, mixing, odd_sketch, toxicity
from tidewright.llm.common import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar does not take for toxic; repeated rows fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(spark, docs, labels).where("predicted = 0").select(*docs.columns)


def drop_line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of lines; those of which nothing but white space is left go.

    Of copies the first stays, by doc_id (null last) and place; documents that lose no line stay as they are.
    """
    out = line_dedup.drop_copies(spark, docs)
    left = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") != ""
    return out.where((F.col("n_dropped") == 0) | left).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by 5-word shingles at a similarity of 0.8.

    The one with the smallest doc_id stays, with all its texts if it has several; of rows that are equal in
    doc_id and text one stays, the first by its other columns. Rows with a null doc_id are told apart by their text.
    """
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("text"), "text")).alias("doc_id"), "text", row)
    kept = odd_sketch.near_duplicates(spark, rows.select("doc_id", "text"), n_words=5, percent=80).where("kept")
    rest = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]))
    first = rows.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by("row", rest).alias("row"))
    return first.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of their sources, once for each pass that takes words of them; those without words go."""
    return mixing.mix_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers  # here: the other stages don't need it

    return bin_slack.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_line_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
