"""Batches of upload, merge, mergeOrUpload and delete over a table with one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..plans.schema import Field, Index

ACTIONS = ("upload", "merge", "mergeOrUpload", "delete")
_CORRUPT = "_corrupt_item"


def _json_type(f: Field) -> T.DataType:
    """The type of a field in JSON: as stored, but points come as GeoJSON."""
    if f.complex:
        kind: T.DataType = T.StructType([T.StructField(s.name, _json_type(s)) for s in f.fields])
    elif f.item == "Edm.GeographyPoint":
        kind = geo.GEOJSON
    else:
        return f.spark()
    return T.ArrayType(kind) if f.collection else kind


def _stored(f: Field, at: Column) -> Column:
    if f.complex:
        def inner(x: Column) -> Column:
            return F.when(x.isNotNull(), F.struct(*(_stored(s, x.getField(s.name)).alias(s.name) for s in f.fields)))
    elif f.item == "Edm.GeographyPoint":
        inner = geo.from_geojson
    else:
        return at
    return F.transform(at, inner) if f.collection else inner(at)


def problem(f: Field, at: Column) -> Column | None:
    """What is wrong with a field's value as it came, or null; None if nothing of it is checked."""
    if f.vector:
        sound = F.forall(at, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        if f.dimensions:
            sound = sound & (F.size(at) == f.dimensions)
        return F.when(at.isNotNull() & ~F.coalesce(sound, F.lit(False)), F.lit(f"{f.name} is no vector of {f.dimensions or 'any'} numbers"))
    if f.complex:
        def inner(x: Column) -> Column | None:
            found = [p for s in f.fields if (p := problem(s, x.getField(s.name))) is not None]
            return F.coalesce(*found) if found else None
    elif f.item == "Edm.GeographyPoint":
        inner = lambda x: F.when(x.isNotNull() & ~geo.is_point(x), F.lit(f"{f.name} is no GeoJSON point"))
    else:
        return None
    if inner(at) is None:
        return None
    return F.get(F.array_compact(F.transform(at, inner)), 0) if f.collection else inner(at)


def parse_batch(index: Index, lines: DataFrame) -> DataFrame:
    """(seq, action, key, doc, present, problem): items from a JSON text column `item` in the order of `seq`.

    present names the fields an item has, null or not; problem says why it can't be applied: a value of the wrong type
    anywhere, a point that is no GeoJSON, a vector of the wrong length or with holes.
    """
    raw = T.StructType([T.StructField(f.name, _json_type(f)) for f in index.fields]).add(_CORRUPT, "string")
    held = lines.select("seq", "item", F.from_json("item", raw, {"columnNameOfCorruptRecord": _CORRUPT}).alias("raw"))
    checks = [p for f in index.fields if (p := problem(f, F.col("raw").getField(f.name))) is not None]
    wrong = F.coalesce(F.when(F.col("raw").getField(_CORRUPT).isNotNull(), F.lit("not JSON, or a value of the wrong type")), *checks, F.lit(None).cast("string"))
    doc = F.struct(*(_stored(f, F.col("raw").getField(f.name)).alias(f.name) for f in index.fields)).cast(index.spark().simpleString())
    action = F.get_json_object("item", "$['@search.action']")
    return held.select("seq", action.alias("action"), F.get_json_object("item", f"$.{index.key}").alias("key"), doc.alias("doc"), F.json_object_keys("item").alias("present"), F.when(action != "delete", wrong).alias("problem"))


def _problem(items: DataFrame) -> Column:
    return F.col("problem") if "problem" in items.columns else F.lit(None).cast("string")


def _refused(items: DataFrame) -> Column:
    known = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    return F.when(F.col("key").isNull(), "the item has no key").when(~known, "unknown action").otherwise(_problem(items))


def statuses(index: Index, table: DataFrame, items: DataFrame) -> DataFrame:
    """(seq, key, status_code, message): 400 for an item that can't be applied, 404 for a merge of what isn't there at that point, else 200."""
    folded = _folded(index, table, items)
    good = folded.select(F.explode("log").alias("x")).select("x.seq", "x.key", "x.status_code")
    good = good.withColumn("message", F.when(F.col("status_code") == 404, "nothing to merge with"))
    bad = items.where(_refused(items).isNotNull())
    return good.union(bad.select("seq", "key", F.lit(400).alias("status_code"), _refused(items).alias("message")))


def batch_status(results: DataFrame) -> DataFrame:
    """(status_code): 207 if an item failed, else 200."""
    return results.agg(F.when(F.max(F.col("status_code")) > 200, 207).otherwise(200).alias("status_code"))


def _folded(index: Index, table: DataFrame, items: DataFrame) -> DataFrame:
    """Each key's items applied in their order, from the stored row: (key, doc, log, old, first); old is the row's _seq, if it has one."""
    fields = index.spark()
    kind = fields.simpleString()
    old = F.col("_seq") if "_seq" in table.columns else F.lit(None).cast("long")
    held = table.select(F.col(index.key).cast("string").alias("key"), F.struct(*(F.col(f"`{f}`") for f in fields.names)).cast(kind).alias("doc"), old.alias("old"))
    sound = items.where(_refused(items).isNull())
    steps = sound.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "doc", "present"))).alias("steps"))
    joined = steps.join(held, "key", "left")
    log_type = "array<struct<seq:bigint,key:string,status_code:int>>"
    start = F.struct(F.col("doc").alias("doc"), F.array().cast(log_type).alias("log"))

    def step(state: Column, s: Column) -> Column:
        old, action = state.getField("doc"), s.getField("action")
        missing = (action == "merge") & old.isNull()
        merges = action.isin("merge", "mergeOrUpload") & old.isNotNull()
        merged = F.struct(*(F.when(F.array_contains(s.getField("present"), n), s.getField("doc").getField(n)).otherwise(old.getField(n)).alias(n) for n in fields.names)).cast(kind)
        new = F.when(missing | (action == "delete"), F.lit(None).cast(kind)).when(merges, merged).otherwise(s.getField("doc"))
        entry = F.struct(s.getField("seq").cast("long").alias("seq"), F.col("key").alias("key"), F.when(missing, 404).otherwise(200).alias("status_code"))
        return F.struct(new.alias("doc"), F.concat(state.getField("log"), F.array(entry)).cast(log_type).alias("log"))

    return joined.select("key", F.aggregate("steps", start, step).alias("s"), "old", F.get("steps.seq", 0).alias("first")).select("key", "s.doc", "s.log", "old", "first")


def apply_batch(index: Index, table: DataFrame, items: DataFrame, above: int | None = None) -> DataFrame:
    """The table after the batch. Rows that no item names pass an anti join; the fold sees a key's own items only.

    If above is given, rows keep their _seq, and new ones get numbers above it in the order of their first items.
    """
    folded = _folded(index, table, items)
    names = [f"`{n}`" for n in index.spark().names] + ([] if above is None else ["_seq"])
    rest = table.join(folded.select(F.col("key").alias("_k")), F.col(f"`{index.key}`").cast("string") == F.col("_k"), "left_anti").select(*names)
    changed = folded.where("doc is not null")
    if above is None:
        return rest.unionByName(changed.select("doc.*"))
    new = changed.where("old is null").orderBy("first").select("doc.*", (F.monotonically_increasing_id() + F.lit(above + 1)).alias("_seq"))
    return rest.unionByName(changed.where("old is not null").select("doc.*", F.col("old").alias("_seq"))).unionByName(new)


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return changes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
