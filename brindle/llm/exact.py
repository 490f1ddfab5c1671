"""Operator 3. Exact deduplication with keyed streaming state.

A digest of each document's normalised text is staged with its identifier and its locator (Parquet file and row number);
the texts stay where they are. A Structured Streaming query reads what is staged and keeps one state entry per digest in
RocksDB, on disk and without expiry: the digest, the stable identifier of the row that stays, its content locator and how
many rows came. Rows of one digest are combined within each task before they meet the state, so a group that holds a
third of all rows is no hot key. Where a digest is hit more than once, the full bytes of its texts are read by their
locators and compared; should they differ, its rows are grouped by the texts themselves.

Defined results: a null text counts as empty, and all texts of white space are equal; of equal texts the row with the most
code points stays, then the smallest doc_id (a null id comes last), then, between rows that repeat it wholly, one by its
place; an empty table gives no rows; extra columns, whatever their names, pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, documents, located, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class StreamingDedup:
    """State under folder/state; each call of update() takes in the staged files it hasn't seen, after a restart too."""

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.folder, self.digest = spark, folder, digest

    def stage(self, docs: DataFrame, file: str, pos: str) -> None:
        """Adds the rows of docs by digest, length, identifier and locator, the columns file and pos."""
        text = F.coalesce(F.col("text"), F.lit(""))
        light = docs.select(F.col(file).alias("file"), F.col(pos).alias("pos"), F.col("doc_id").alias("id"), F.length(text).cast("long").alias("n_points"), self.digest(normalised(text)).alias("digest"))
        light.write.mode("append").parquet(f"{self.folder}/staged")

    def staged(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/staged")

    def update(self, files_per_trigger: int | None = None) -> None:
        reader = self.spark.readStream.schema(self.staged().schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        state = reader.parquet(f"{self.folder}/staged").groupBy("digest").agg(F.max(rank()).alias("best"), F.count("*").alias("group_size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/seen/batch={number}")

        before = {k: self.spark.conf.get(k, None) for k in STREAM_CONF}
        for k, v in STREAM_CONF.items():
            self.spark.conf.set(k, v)
        try:
            query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def groups(self) -> DataFrame:
        """(digest, best, group_size) as the state has them now: of each digest the last update."""
        seen = self.spark.read.parquet(f"{self.folder}/seen")
        last = seen.groupBy("digest").agg(F.max(F.struct("batch", "best", "group_size")).alias("last"))
        return last.select("digest", "last.best", "last.group_size")

    def result(self, docs: DataFrame) -> DataFrame:
        """(file, pos, id, keep_id, group_size, kept, digest) of each staged row; groups are checked by their full bytes in docs (file, pos, text)."""
        light, groups = self.staged(), self.groups()
        hits = light.join(groups.where("group_size > 1").select("digest"), "digest", "left_semi")
        texts = docs.select("file", "pos", normalised(F.col("text")).alias("bytes"))
        met = texts.join(hits.select("file", "pos", "digest"), ["file", "pos"])
        differ = met.groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a <> b").select("digest").checkpoint()
        found = light.join(groups, "digest")
        if not differ.isEmpty():
            mixed = texts.join(light.join(differ, "digest", "left_semi"), ["file", "pos"])
            by_text = mixed.groupBy("digest", "bytes").agg(F.max(rank()).alias("best"), F.count("*").alias("group_size"))
            apart = mixed.join(by_text, ["digest", "bytes"]).select(found.columns)
            found = found.join(differ, "digest", "left_anti").unionByName(apart)
        kept = (F.col("file") == -F.col("best.minus_file")) & (F.col("pos") == -F.col("best.minus_pos"))
        return found.select("file", "pos", "id", (-F.col("best.minus_id")).alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def rank() -> Column:
    """The greatest stays: most code points, smallest id, nulls last, then by place."""
    return F.struct("n_points", F.col("id").isNotNull().alias("named"), (-F.col("id")).alias("minus_id"), (-F.col("file")).alias("minus_file"), (-F.col("pos")).alias("minus_pos"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> tuple[DataFrame, str, str, DataFrame]:
    """docs with the names of two columns that locate its rows, and the groups by file and pos."""
    rows, file, pos = located(docs)
    dedup = StreamingDedup(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/dedup-{uuid.uuid4().hex}", digest)
    dedup.stage(rows, file, pos)
    dedup.update(files_per_trigger)
    return rows, file, pos, dedup.result(rows.select(F.col(file).alias("file"), F.col(pos).alias("pos"), "text"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(documents(spark, sf_dir).select("doc_id", "text"))[3]
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with its columns."""
    rows, file, pos, found = exact_groups(docs)
    kept = found.where("kept").select(F.col("file").alias(file), F.col("pos").alias(pos))
    return rows.join(kept, [file, pos], "left_semi").select(*(rows[c] for c in docs.columns))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
