"""Queries over the driver's tables, one for each operator, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import anagram, bin_slack, byte_bpe, collocations, lattice, license_scan, line_dedup, mixing, odd_sketch, prefix_forest, reply_trees, suffix_tree, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label at a cosine of 0.98."""
    return lattice.near_duplicates(spark, _table(spark, sf_dir, "embeddings"), least=0.98)


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every row whose vec_id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(spark, vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by 2-word shingles at a similarity of 0.8."""
    return odd_sketch.near_duplicates(spark, _table(spark, sf_dir, "documents"), n_words=2, percent=80)


def op4_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers  # here: the other queries don't need it

    return bin_slack.pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted text."""
    said = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", reply_trees.SAMPLE), (-1, 1, "assistant", reply_trees.SAMPLE)], said.schema)
    return reply_trees.digest(reply_trees.format_trees(spark, reply_trees.chains(said.union(more))))


def op6_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return license_scan.scan(spark, _table(spark, sf_dir, "documents"))[1]


def op7_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(spark, docs.select("doc_id", "text"), labels).drop("text")


def op8_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without copies of lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_copies(spark, docs)


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return suffix_tree.score(spark, _table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    return mixing.mix_counts(spark, _table(spark, sf_dir, "documents"))


def op11_anagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, and the more frequent words that they are variants of."""
    return anagram.variants(spark, _table(spark, sf_dir, "documents"))


def op12_bitmap_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's strongest phrases of two to four words."""
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    import public_tokenizers  # here: most queries don't need it

    return byte_bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_lattice": op1_lattice,
    "op2_prefix_forest": op2_prefix_forest,
    "op3_odd_sketch": op3_odd_sketch,
    "op4_bin_slack": op4_bin_slack,
    "op5_reply_trees": op5_reply_trees,
    "op6_diagonal_voting": op6_diagonal_voting,
    "op7_pattern_grammar": op7_pattern_grammar,
    "op8_segment_join": op8_segment_join,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_mixing": op10_mixing,
    "op11_anagram": op11_anagram,
    "op12_bitmap_phrases": op12_bitmap_phrases,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE_SQL = {
    "op5_reply_trees": reply_trees.digest_sql(),
    "op6_diagonal_voting": license_scan.scan_sql(),
    "op10_mixing": mixing.counts_sql(),
    "op11_anagram": anagram.variants_sql(),
    "op12_bitmap_phrases": collocations.collocations_sql(),
}
