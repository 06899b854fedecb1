"""A training corpus from raw documents: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import contamination, lines, overlap, packing, simhash, toxicity
from cliploom.llm.common import read, shared_table, text_key

TOXIC = 0.5


LEAKS = 1_000_000  # leaking documents, of two numbers each, that may be broadcast; more are joined by a shuffle


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but ``doc_id`` and ``text`` renamed, so that an operator's columns replace none of them."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "text")})


def _back(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select([c if c in ("doc_id", "text") else F.col(f"__own_{c}").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay, with their columns whatever their names; the model learns from
    the labelled ones among ``docs``."""
    model = toxicity.fit_documents(docs, read(spark, sf_dir, "labels"))
    return _back(model.score(_aside(docs)).where(F.col("score") < TOXIC), docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns, without lines that many share; ``n_chars`` follows the text."""
    kept = lines.apply_bitmaps(_aside(docs), lines.keep_bitmaps(docs.select("doc_id", "text")))
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("__own_n_chars"))
        kept = kept.withColumn("__own_n_chars", size)
    return _back(kept, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the document of smallest id stays."""
    return simhash.smallest_of_each(docs, overlap.near_copies(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay."""
    found = contamination.contaminated_words(docs, read(spark, sf_dir, "benchmark"))
    leaks = shared_table(found.where(F.size("hits") > 0).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "leaks")
    if leaks.count() <= LEAKS:
        leaks = F.broadcast(leaks)
    on = docs["doc_id"].eqNullSafe(F.col("__id")) & (text_key(docs["text"]) == F.col("__key"))
    return docs.join(leaks, on, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 4096 tokens."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near-duplicate removal", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL: boosted trees, XXH64 fingerprints with a seed and a tokenizer have no form there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
