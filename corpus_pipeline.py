"""Corpus preparation: language, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, langid, packing, simhash, substring
from tracewright.llm.common import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language has less than this share of the positions are rejected, as are those without a letter.
LEAST_LANGUAGE = 0.3
#: Keys of texts to drop are broadcast up to this count; beyond it texts are dealt by key instead.
MOST_BROADCAST_KEYS = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter and those whose language stays unclear."""
    found = langid.identify(docs, keep=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each near-duplicate group, that of least id; a row without an id only where none has one.

    Of a group's rows of the least id (or without any) the one of least row hash stays. Texts are dealt by id and row hash,
    so rows that share an id spread.
    """
    # nulls leave no trace in a hash, so where they are is hashed too
    row = F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))
    alike = simhash.near_duplicates(docs, row).groupBy("group_id", "doc_id", "row").agg(F.count("*").alias("n_rows"))
    least = alike.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n_rows")).alias("r"))
    stays = least.select(F.col("r.doc_id").alias("kept_id"), F.col("r.row").alias("kept_row"), "r.n_rows")
    stays = Tables(spark).keep(stays, "kept-rows")
    held = docs.select(*COLUMNS, row.alias("row"))
    held = held.join(stays, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row")))
    out = held.where("n_rows = 1").select(*COLUMNS)
    if not stays.where("n_rows > 1").isEmpty():
        out = out.unionByName(held.where("n_rows > 1").dropDuplicates(["doc_id", "row"]).select(*COLUMNS))
    return out


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier; rows that lose nothing keep their text as it is, emptied ones go.

    Every row has its own verdict, by its own text, whatever other rows share its doc_id.
    """
    found = substring.remove_repeats(docs, with_text=True, keep=("text", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    return found.where("n_removed = 0 or n_removed < n_words").select(
        "doc_id",
        F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of which a twentieth or more of the words are benchmark passages.

    Rows go by their text, which alone decides; a contaminated text takes no other text of its doc_id with it.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark).where("contaminated").select(F.col("key").alias("gone_key")).distinct()
    keys = Tables(spark).keep(found, "contaminated-texts")
    keys = F.broadcast(keys) if keys.count() <= MOST_BROADCAST_KEYS else keys
    return docs.join(keys, decontaminate.text_key(F.col("text")) == F.col("gone_key"), "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of every remaining document and their places."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contaminated", contaminated),
    ("packed", packed),
]

#: The trained network and the tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = tables.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
