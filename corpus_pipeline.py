"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantus.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from cantus.llm.common import text_of, written
from cantus.llm.queries import table, tokenizer_file

#: No SQL: the fitted classifier, the signatures, the byte spans and the packing are beyond it.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict toxic."""
    weights, logistic = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_of(spark, weights, logistic) < toxicity.THRESHOLD)


def whole(docs: DataFrame, *keys: Column) -> DataFrame:
    """Rows in one column, so that no name of theirs meets a key's."""
    return docs.select(F.struct("*").alias("row"), *keys)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha"))
    rows = whole(docs, F.col("doc_id").cast("bigint").alias("id"), F.unhex(F.sha2(text_of("text").cast("binary"), 256)).alias("sha"))
    stay = rows.join(kept.hint("merge"), (F.col("sha") == F.col("kept_sha")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return stay.dropDuplicates(["sha", "id"]).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; of rows that agree in id and text as many as stay of them."""
    keys = near_dedup.near_rows(docs).groupBy("doc_id", "salt").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay"))
    judged = written(keys.filter("stay < rows").select(F.col("doc_id").alias("judged_id"), F.col("salt").alias("judged_salt"), "stay"), "judged")
    rows = whole(docs, F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text_of("text").cast("binary")).alias("salt"))
    joined = rows.join(judged.hint("merge"), (F.col("id") == F.col("judged_id")) & (F.col("salt") == F.col("judged_salt")), "left")
    clear = joined.filter("stay IS NULL").select("row.*")
    if judged.filter("stay > 0").isEmpty():
        return clear
    return clear.unionByName(joined.filter("stay > 0").dropDuplicates(["id", "salt"]).select("row.*"))  # one of a class stays


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings; a character that a cut would split goes with the string."""
    cut = suffix_dedup.suffix_dedup(docs, widen=True).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("salt").alias("cut_salt"), F.col("kept").cast("string").alias("rest")).dropDuplicates(["cut_id", "cut_salt"])
    rows = whole(docs, F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text_of("text").cast("binary")).alias("salt"))
    joined = rows.join(cut.hint("merge"), (F.col("salt") == F.col("cut_salt")) & F.col("id").eqNullSafe(F.col("cut_id")), "left")
    changed = {"text": F.coalesce("rest", "row.text"), "n_chars": F.when(F.col("rest").isNotNull(), F.char_length("rest").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return joined.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 ids."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("suffix dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
