"""A training corpus from documents: toxic ones go, one of each group of near copies stays, personal data is masked,
sources are mixed to their target weights, and what the mix takes is packed into sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns pieces. run() writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import discard, materialize, table
from gaugeworks.llm.jaccard_join import similar_groups
from gaugeworks.llm.mixing import mix, word_count
from gaugeworks.llm.packing import pack, tokenize
from gaugeworks.llm.pii import mask_pii
from gaugeworks.llm.toxicity import THRESHOLD, learn_toxicity, text_key, text_scores
from gaugeworks.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score THRESHOLD or more. Null and empty texts are clean."""
    learned = learn_toxicity(docs.select("doc_id", "text"), table(ship(spark), sf_dir, "labels").select("doc_id", "toxic"))
    key = "key"
    while key in docs.columns:
        key = f"_{key}"
    toxic = text_scores(docs, learned).where(F.col("score") >= THRESHOLD).select(F.col("key").alias(key))
    return docs.join(toxic, text_key() == F.col(key), "left_anti").select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows with a null id stay. Documents
    without words are in no group. Of repeated rows with one id, all stay or go together."""
    ship(spark)
    groups = similar_groups(docs)
    gone = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span in its place, as in [EMAIL], and counts the characters anew."""
    ship(spark)
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without words are taken by whole parts only."""
    ship(spark)
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size")), "sized")
    copies = materialize(mix(sized).where("copies > 0").select("doc_id", "source", "size", "copies").distinct(), "copies")
    copies = copies.select(*(F.col(c).alias(f"_{c}") for c in copies.columns))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (word_count() == F.col("_size"))
    return docs.join(copies, same).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece."""
    ship(spark)
    return pack(tokenize(docs.select("doc_id", "text"), keep_ids=False).drop("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the toxicity model or the near-duplicate join; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
