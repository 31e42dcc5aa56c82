"""A corpus pipeline: quality rules, line dedup, near duplicates, decontamination, segmentation.

run() applies the STAGES to the documents, one after another; each works on all that its predecessor
kept.  A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, lattice_sampling, line_dedup, ngram_join, quality
from eventloom.llm.queries import PIECES, table, tokenizer_path
from eventloom.llm.shared import joinable, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the outlier rule reject go."""
    return quality.quality_rules(docs).filter("kept").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many of a source's documents are cut; n_chars follows the text."""
    cut = line_dedup.drop_frequent_lines(docs, "source", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest id stays.

    Rows of one id and one set are a single document and stay together; of two sets under that id one
    stays.  A null id stays only where its group has no other id, and then as one row."""
    docs = docs.select(*COLUMNS)
    linked = stage(ngram_join.link_documents(docs.select("doc_id", "text")).filter("n_shingles > 0"), "linked")
    copies = linked.filter("NOT first OR NOT (id <=> component_id)").select("id", "tie")
    unnamed = linked.filter("first AND id IS NULL AND component_id IS NULL")
    kept = unnamed.groupBy("c").agg(F.min("tie").alias("kept"))
    others = unnamed.join(kept, "c").filter("tie != kept").select("id", "tie")
    gone = copies.unionByName(others).select(F.col("id").alias("__id"), F.col("tie").alias("__tie")).distinct()
    gone = joinable(stage(gone, "near-copies"), "24")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tie"))
    alone = F.col("doc_id").isNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.filter(~alone).join(gone, same, "left_anti").select(*COLUMNS)
    return named.unionByName(docs.filter(alone).join(gone, same, "left_anti").select(*COLUMNS).dropDuplicates(["text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    marked = decontaminate.mark_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("leaks") == 0).select(*COLUMNS)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text, as piece ids."""
    return lattice_sampling.sample_segmentations(docs, tokenizer_path(PIECES), F.col("doc_id"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", segment),
]

#: The outlier rule and the sampler are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
