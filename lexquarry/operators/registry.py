"""The document registry: identity, overrides, duplicates and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import norm_title, slashes

#: Formats in order of preference among duplicates.
PRIORITY = {"docx": 0, "doc_converted": 1, "txt": 2, "xlsx": 3}
#: Override maps are joined by broadcast up to so many rows; larger ones by a shuffle.
BROADCAST_ROWS = 200_000


def doc_id(path: Column) -> Column:
    return F.substring(F.sha1(F.encode(path, "UTF-8")), 1, 16)


def changed_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files that the registry doesn't hold with the same size and time."""
    seen = registry.select(F.col("file_path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    return files.join(seen, (F.col("file_path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")), "left_anti")


def _side(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def apply_overrides(registry: DataFrame, dates: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Manual dates and titles (key, value) by path win; date_source and title_source become manual where they changed something."""
    out = registry.withColumn("_path", slashes(F.col("file_path")))
    if dates is not None:
        out = out.join(_side(dates.select(F.col("key").alias("_path"), F.col("value").alias("_date"))), "_path", "left")
        new = F.col("_date").isNotNull() & ~F.col("_date").eqNullSafe(F.col("effective_date"))
        out = out.withColumn("date_source", F.when(new, "manual").otherwise(F.col("date_source") if "date_source" in out.columns else F.lit(None))).withColumn("effective_date", F.coalesce("_date", "effective_date")).drop("_date")
    if titles is not None:
        out = out.join(_side(titles.select(F.col("key").alias("_path"), F.col("value").alias("_title"))), "_path", "left")
        out = out.withColumn("title_source", F.when(F.col("_title").isNotNull(), "manual").otherwise(F.col("title_source"))).withColumn("doc_title", F.coalesce("_title", "doc_title")).drop("_title")
    return out.drop("_path")


def mark_duplicates(registry: DataFrame, *, ordinal: str = "line") -> DataFrame:
    """Sets duplicate_of: of equal fingerprints the best format stays, then the largest file, then the first record.

    Records without a fingerprint are never duplicates; they leave before the shuffle, since they would meet in one task.
    """
    priority = F.coalesce(*(F.when(F.col("format") == f, p) for f, p in PRIORITY.items()), F.lit(9))
    order = F.struct(priority.alias("p"), (-F.col("size")).alias("s"), F.col(ordinal).alias("o"), F.col("doc_id").alias("doc_id"))
    known = registry.where("fingerprint is not null")
    best = known.groupBy("fingerprint").agg(F.min(order).alias("_best"), F.count("*").alias("_n")).where("_n > 1").select("fingerprint", "_best.doc_id")
    best = best.withColumnRenamed("doc_id", "_canonical")
    out = registry.drop("duplicate_of").join(best, "fingerprint", "left")
    return out.withColumn("duplicate_of", F.when(F.col("_canonical") != F.col("doc_id"), F.col("_canonical"))).drop("_canonical")


def mark_versions(registry: DataFrame, ungrouped: DataFrame | None = None, *, ordinal: str = "line") -> DataFrame:
    """Sets version_group, is_latest and ambiguous among non-duplicates of the same normalised title.

    The latest date is the latest version (dates are text, none sorts first), of equal ones the first record; a
    group is ambiguous if its latest date is missing or shared. Duplicates keep a null is_latest.
    """
    out = registry.drop("version_group", "is_latest", "ambiguous")
    if ungrouped is not None:
        out = out.join(_side(ungrouped.select(F.col("file_path").alias("_u"), F.lit(True).alias("_apart"))), F.col("file_path") == F.col("_u"), "left").drop("_u")
    else:
        out = out.withColumn("_apart", F.lit(None).cast("boolean"))
    original = F.coalesce("duplicate_of", F.lit("")) == ""
    fit = original & ~F.coalesce(F.col("status").startswith("ERROR"), F.lit(False)) & F.col("_apart").isNull() & ~F.col("title_source").eqNullSafe("FAIL")
    out = out.withColumn("_t", F.when(fit, norm_title(F.col("doc_title"))))
    # by title and date first, so that a title of many versions is counted before it is shuffled
    date = F.coalesce("effective_date", F.lit("0000"))
    by_date = out.where("_t is not null").groupBy("_t", date.alias("date")).agg(F.count("*").alias("n"), F.min(F.struct(F.col(ordinal).alias("o"), F.col("doc_id").alias("id"))).alias("first"), F.max("effective_date").alias("known"))
    best = by_date.groupBy("_t").agg(F.sum("n").alias("_n"), F.max(F.struct("date", "n", "first", "known")).alias("_best")).withColumnRenamed("_t", "_title")
    out = out.join(best, F.col("_t") == F.col("_title"), "left")
    many, titled = F.col("_n") > 1, F.col("_t").isNotNull()
    latest = ~many | ((F.col("_best.first.id") == F.col("doc_id")) & F.col("_best.first.o").eqNullSafe(F.col(ordinal)))
    return out.select(
        *registry.drop("version_group", "is_latest", "ambiguous").columns,
        F.when(titled & many, F.col("_t")).alias("version_group"),
        F.when(titled, F.when(latest, 1).otherwise(0)).when(original, 1).alias("is_latest"),
        F.when(titled & many, F.col("_best.known").isNull() | (F.col("_best.n") > 1)).alias("ambiguous"),
    )


def default_versions(registry: DataFrame) -> DataFrame:
    """Fills what an unfinished registry lacks: nothing duplicate, everything latest."""
    have = lambda c, kind: F.col(c) if c in registry.columns else F.lit(None).cast(kind)
    return registry.withColumns({"duplicate_of": have("duplicate_of", "string"), "is_latest": F.coalesce(have("is_latest", "int"), F.lit(1))})


def indexable(registry: DataFrame) -> DataFrame:
    """Records to be indexed: originals of a known format that could be read."""
    return registry.where("coalesce(duplicate_of, '') = '' and not coalesce(status, '') like 'ERROR%' and format in ('docx', 'doc_converted', 'txt', 'xlsx', 'md', 'doc')")


def summary(registry: DataFrame) -> DataFrame:
    """Counts by title source, with dated, indexable and latest records."""
    original = F.col("duplicate_of").isNull()
    return registry.groupBy("title_source").agg(F.count("*").alias("n"), F.count("effective_date").alias("dated"), F.count_if(original).alias("indexable"), F.count_if(original & (F.col("is_latest") == 1)).alias("latest"))


def parse_counts(registry: DataFrame) -> DataFrame:
    """Documents read and failed, by format."""
    failed = F.coalesce(F.col("status").startswith("ERROR"), F.lit(False))
    return registry.groupBy("format").agg(F.count_if(~failed).alias("parsed"), F.count_if(failed).alias("failed"))


def version_counts(registry: DataFrame) -> DataFrame:
    """Records, duplicates, version groups, ambiguous groups and failed titles."""
    return registry.agg(
        F.count("*").alias("n"), F.count("duplicate_of").alias("duplicates"), F.countDistinct("version_group").alias("version_groups"),
        F.countDistinct(F.when(F.col("ambiguous"), F.col("version_group"))).alias("ambiguous_groups"), F.count_if(F.col("title_source") == "FAIL").alias("title_fails"),
    )


def write_reviews(registry: DataFrame, folder: str) -> None:
    """The registry as parquet, and as CSV what people should look at: duplicates, versions, failed titles."""
    registry.write.mode("overwrite").parquet(f"{folder}/registry")
    kept = registry.select(F.col("doc_id").alias("duplicate_of"), F.col("file_path").alias("kept_path"), F.col("format").alias("kept_format"))
    doubles = registry.where("duplicate_of is not null").select("file_path", "format", "duplicate_of", F.substring("doc_title", 1, 50).alias("title")).join(kept, "duplicate_of").drop("duplicate_of")
    versions = registry.where("version_group is not null").select(F.substring("version_group", 1, 44).alias("version_group"), "file_path", F.coalesce("effective_date", F.lit("?")).alias("date"), F.when(F.col("is_latest") == 1, "latest").otherwise("old").alias("state"), F.when(F.col("ambiguous"), "AMBIGUOUS").otherwise("").alias("decide"))
    fails = registry.where("title_source = 'FAIL'").select("file_path", "format", F.substring("doc_title", 1, 60).alias("title"))
    for name, df in (("review_duplicates", doubles), ("review_versions", versions.orderBy("version_group", "file_path")), ("review_title_fail", fails)):
        # the mark by which spreadsheet programs know the encoding stands before the first column's name
        df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def append_log(records: DataFrame, path: str, number: int) -> None:
    """Adds records to the log under a number, so that of one document the record of the greatest number counts."""
    records.withColumn("line", F.lit(number).cast("long")).write.mode("append").json(path)
