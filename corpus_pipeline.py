"""The corpus pipeline: each stage gets the documents that the one before it kept, and returns documents.

All stages but the last return the columns of documents; columns beyond these are dropped. Stages judge
their own input only: texts shortened by one are what the next one reads. run() keeps what each stage
returns before the next one reads it, several times over, so no stage is computed again for a later one; of
these tables one is there at a time, and two while a stage is written.

Cases. Documents of a null id pass language_id by their text alone, are never held to be copies of others
by near_dedup, lose no passage in substring_dedup, and are judged by decontamination and source_mixing like
any others; rows that repeat an id are documents of their own. Null and empty texts go with language_id. An
empty table gives an empty result of the same columns; an empty benchmark rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import langid
from lexquarry.llm.decontam import decontaminate
from lexquarry.llm.mixing import mix_sources
from lexquarry.llm.neardup import near_duplicates
from lexquarry.llm.spark import cut, dropped, kept, small, table
from lexquarry.llm.substring import repeated_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: without text, without a letter, or with no language to learn from."""
    found = langid.identify(docs, langid.train(docs), carry=COLUMNS)
    return found.where(F.col("_lang") != "und").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of documents with five-word shingles alike by 0.8 or more; rows that repeat an id are documents of their own."""
    found = near_duplicates(docs, k=5, at_least=(80, 100))
    ids = cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    if not ids.where("n > 1").isEmpty():
        return _drop_near_duplicate_rows(docs)
    return docs.select(*COLUMNS).join(small(ids.where("not kept").select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)


def _drop_near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: rows are known by a hash of id and text, and the least of (id, hash) of each group stays."""
    docs = docs.select(*COLUMNS)
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(linked).withColumn("_row", F.xxhash64("doc_id", "text"))
    again = small(rows.groupBy("_row").count().where("count > 1").select("_row"))
    # of equal rows one stays; only their texts are shuffled
    rest = F.struct("lang", "source", "n_chars")
    one = rows.join(again, "_row", "left_semi").groupBy("_row", "doc_id", "text").agg(F.min(rest).alias("rest")).select("_row", "doc_id", "text", "rest.*")
    rows = rows.join(again, "_row", "left_anti").select("_row", *COLUMNS).unionByName(one)
    found = near_duplicates(rows, id_col="_row", k=5, at_least=(80, 100)).select(F.col("doc_id").alias("_row"), "component_id")
    placed = cut(found.join(rows.select("_row", "doc_id"), "_row"))
    kept = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("least")).select("component_id", F.col("least._row").alias("_kept"))
    gone = small(placed.join(kept, "component_id").where("_row <> _kept").select("_row"))
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS).unionByName(docs.where(~linked))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document of a smaller id holds too; a document that consists of such stays, empty."""
    found = repeated_substrings(docs, window=50, carry=COLUMNS, texts=True)
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    chars = F.when(F.col("_n_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lie in benchmark passages."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS, sizes=False)
    return found.where(~F.col("_contaminated")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mixture takes each document; 0 is a decision too, so all are listed."""
    found = mix_sources(docs, carry=COLUMNS)
    return found.select(*COLUMNS, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), F.col("_taken").alias("taken"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        if before is not None:  # nothing reads it any more
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
