"""Shared helpers: the folder all executors see, Arrow word splitting and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(base)
    return base or sc.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and later reads can prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the place of each row as two more longs, and their names: a hash of the Parquet file's path, and the row's number there.

    A table that is not just read from Parquet files is written to the shared folder first, so that places are stable.
    """
    names = []
    for name in ("file", "pos"):
        while name in docs.columns:
            name = f"_{name}"
        names.append(name)
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() == "Project":
        node = node.child()
    if node.nodeName() != "LogicalRelation" or "Parquet" not in node.relation().getClass().getSimpleName() + str(getattr(node.relation(), "fileFormat", str)()):
        docs = staged(docs, "rows")
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(at["file_path"]).alias(names[0]), at["row_index"].alias(names[1])), *names


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts in one flat array, and how many each text has. Null: none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else lists.values
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not keep.all():
        at = np.concatenate([[0], np.cumsum(keep)])
        return flat.filter(pa.array(keep)), at[offsets[1:]] - at[offsets[:-1]]
    return flat, np.diff(offsets).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that the texts of each piece hold about max_bytes; one longer text is a piece of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(size):
            continue
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges starts[i] .. starts[i] + counts[i]."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    edges: (a, b) long. Alternates the large-star and small-star steps of Kiveris et al. (2014). Neighbourhoods are
    never gathered: only minima, by an aggregation with map-side combine, joined back to the edges, so that a hub's
    rows spread under AQE. Each round ends in a reliable checkpoint.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        sign = cur.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if sign[0] == 0 or sign == before:
            break
        before = sign
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = small.union(low).distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return cur.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select("v", "v").distinct()
    )
