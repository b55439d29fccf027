"""The registry as a stream: new files as they come, and the state that their records and removals leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexquarry.functions.text import norm_title
from lexquarry.operators import registry
from lexquarry.plans import corpus
from lexquarry.sources.files import exists, located, scan_tree
from lexquarry.types import RECORD

_FILES = "path string, modificationTime timestamp, length long, content binary"
#: Status of a record that says a file is gone.
GONE = "DELETED"


def watch(spark: SparkSession, root: str, target: str, checkpoint: str):
    """Takes in all files not seen before, then stops; run again, it goes on where it ended. Rerun batches replace their own output.

    Records are those of plans.corpus.build_registry, so those of a stream and of a batch run can be joined.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).load(root)

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # each reader takes its own files of it
        corpus.records(located(batch, root)).write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.unpersist()

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def removed(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """Records that say so of the files that `known` holds and the tree doesn't."""
    there = scan_tree(spark, root).select("file_path")
    gone = known.where(F.coalesce("status", F.lit("")) != GONE).join(there, "file_path", "left_anti")
    return gone.withColumn("status", F.lit(GONE))


_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_CHANGE = f"{RECORD}, change string, old_title string, old_fingerprint string"


def _last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a document's last record; what it became, and what it was, if that is something else."""
    old = dict(zip(_NAMES, state.get, strict=True)) if state.exists else None
    new = old
    for rows in batches:
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            if new is None or row["line"] >= new["line"]:
                new = row
    state.update(tuple(new[n] for n in _NAMES))
    same = lambda r: None if r is None else [r[n] for n in _NAMES if n not in ("line", "mtime")]
    there = lambda r: r is not None and r["status"] != GONE
    if there(new) or there(old):
        change = "deleted" if not there(new) else "added" if not there(old) else "changed" if same(new) != same(old) else "seen"
        row = {**new, "change": change, "old_title": old and old["doc_title"], "old_fingerprint": old and old["fingerprint"]}
        yield pd.DataFrame([row], columns=[*_NAMES, "change", "old_title", "old_fingerprint"])


def follow(spark: SparkSession, log: str, target: str, checkpoint: str, *, files_at_once: int | None = None):
    """Takes in what an append-only log of records (JSON lines) has got since, then stops.

    State is one record a document, the one of the greatest line. Each batch writes under the target, replacing its own
    output when it is rerun: `changes`, the documents that were added, changed, seen again or deleted, and `versions`,
    the documents whose version group, rank among its versions or original has become another. Only documents that
    share a fingerprint or a title with a changed one are looked at for that.
    """
    lines = spark.readStream.schema(RECORD).options(**({"maxFilesPerTrigger": files_at_once} if files_at_once else {})).json(log)
    changes = lines.where("doc_id is not null").groupBy("doc_id").applyInPandasWithState(_last, _CHANGE, RECORD, "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/changes/batch={number}")
        before, now = (current(spark, target, until=n) for n in (number - 1, number))
        new = spark.read.schema(_CHANGE).parquet(f"{target}/changes/batch={number}")
        marks = lambda titles, prints: (titles.where("_t is not null").distinct(), prints.where("fingerprint is not null").distinct())
        changed = new.where("change <> 'seen'")
        titles, prints = marks(changed.select(F.explode(F.array(norm_title(F.col("doc_title")), norm_title(F.col("old_title")))).alias("_t")), changed.select(F.explode(F.array("fingerprint", "old_fingerprint")).alias("fingerprint")))
        titled = lambda df: df.withColumn("_t", norm_title(F.col("doc_title")))
        # documents of a changed fingerprint may become versions of their titles, or no more
        of_prints = titled(before).unionByName(titled(now)).join(prints, "fingerprint", "left_semi").select("_t")
        titles = titles.unionByName(of_prints).where("_t is not null").distinct()
        state = {name: _versions(titled(df), titles, prints, changed) for name, df in (("old", before), ("new", now))}
        fields = ("duplicate_of", "version_group", "is_latest")
        both = state["old"].select("doc_id", *(F.col(f).alias(f"old_{f}") for f in fields)).join(state["new"].select("doc_id", *fields), "doc_id", "full")
        differs = F.lit(False)
        for f in fields:
            differs = differs | ~F.col(f).eqNullSafe(F.col(f"old_{f}"))
        both.where(differs).write.mode("overwrite").parquet(f"{target}/versions/batch={number}")

    return changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(records: DataFrame, titles: DataFrame, prints: DataFrame, changed: DataFrame) -> DataFrame:
    """Duplicates and versions of the documents of some titles and fingerprints, and of the changed ones, among all that share a fingerprint with them."""
    asked = records.join(titles, "_t", "left_semi").unionByName(records.join(prints, "fingerprint", "left_semi").select(*records.columns)).unionByName(records.join(changed.select("doc_id"), "doc_id", "left_semi")).dropDuplicates(["doc_id"])
    around = records.join(asked.where("fingerprint is not null").select("fingerprint").distinct(), "fingerprint", "left_semi").select(*records.columns)
    group = asked.unionByName(around).dropDuplicates(["doc_id"]).drop("_t")
    marked = registry.mark_versions(registry.mark_duplicates(group, ordinal="file_path"), ordinal="file_path")
    return marked.join(asked.select("doc_id"), "doc_id", "left_semi")


def current(spark: SparkSession, target: str, *, until: int | None = None) -> DataFrame:
    """The documents that are there, after all batches that follow() wrote, or after one of them."""
    if not exists(spark, f"{target}/changes"):
        return spark.createDataFrame([], RECORD)
    rows = spark.read.schema(f"{_CHANGE}, batch int").parquet(f"{target}/changes")
    if until is not None:
        rows = rows.where(F.col("batch") <= until)
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*_NAMES[1:]), F.struct("batch", "line")).alias("r")).select("doc_id", "r.*")
    return last.where(F.coalesce("status", F.lit("")) != GONE)
