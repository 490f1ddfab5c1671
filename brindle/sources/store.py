"""Indexes and synonym maps on disk: definitions, and numbered versions of a Parquet table in buckets of keys.

A version is a list of bucket folders. A batch rewrites the buckets of its keys only, and commits by creating the next
number, which one writer can do; whoever comes too late reads the new version and applies its batch to that.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import synonym_rules
from ..operators.writes import ACTIONS, apply_batch, parse_batch, statuses
from ..plans.schema import Field, Index, RequestError
from ..plans.validate import check_index, check_synonyms

#: Buckets of an index's table; how often a writer starts anew.
BUCKETS, TRIES = 32, 200


def _field(d: dict) -> Field:
    return Field(**{**d, "fields": tuple(map(_field, d.get("fields", ()))), "synonyms": tuple(d.get("synonyms", ()))})


def _checked(name: str) -> str:
    if any(c in name for c in "./\\") or not name:
        raise RequestError(f"bad name {name}")
    return name.lower()


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str, *rest: str) -> str:
        return os.path.join(self.root, _checked(name), *rest)

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.root) if "." not in n and os.path.exists(self._path(n, "index.json"))) if os.path.isdir(self.root) else []

    def get(self, name: str) -> Index | None:
        path = self._path(name, "index.json")
        if not os.path.exists(path):
            return None
        with open(path) as f:
            d = json.load(f)
        d["suggesters"] = {k: tuple(v) for k, v in d["suggesters"].items()}
        return Index(**{**d, "fields": tuple(map(_field, d["fields"]))})

    def need(self, name: str) -> Index:
        index = self.get(name)
        if index is None:
            raise RequestError(f"no index {name}")
        return index

    def put(self, index: Index) -> bool:
        """Creates or extends an index; true if it is new. Fields may be added only."""
        check_index(index, set(self.synonym_names()))
        old = self.get(index.name)
        if old is not None and not old.allows_change(index):
            raise RequestError("fields may be added, not changed or removed")
        os.makedirs(self._path(index.name, "versions"), exist_ok=True)
        self._swap(self._path(index.name, "index.json"), json.dumps(asdict(index)))
        return old is None

    def drop(self, name: str) -> bool:
        """Removes an index with its data; false if there is none."""
        if self.get(name) is None:
            return False
        shutil.rmtree(self._path(name))
        return True

    @staticmethod
    def _swap(path: str, text: str) -> None:
        new = f"{path}.{uuid.uuid4().hex}"
        with open(new, "w") as f:
            f.write(text)
        os.replace(new, path)

    # synonym maps

    def _map(self, name: str) -> str:
        return os.path.join(self.root, f"{_checked(name)}.synonymmap.json")

    def synonym_names(self) -> list[str]:
        end = ".synonymmap.json"
        return sorted(n.removesuffix(end) for n in os.listdir(self.root) if n.endswith(end)) if os.path.isdir(self.root) else []

    def put_synonyms(self, name: str, rules: str, kind: str = "solr") -> bool:
        check_synonyms(rules, kind)
        new = name.lower() not in self.synonym_names()
        os.makedirs(self.root, exist_ok=True)
        self._swap(self._map(name), json.dumps({"name": name, "format": kind, "synonyms": rules}))
        return new

    def get_synonyms(self, name: str) -> dict | None:
        if not os.path.exists(self._map(name)):
            return None
        with open(self._map(name)) as f:
            return json.load(f)

    def drop_synonyms(self, name: str) -> bool:
        if self.get_synonyms(name) is None:
            return False
        os.remove(self._map(name))
        return True

    def synonyms(self) -> dict[str, tuple[dict, dict]]:
        """The rules of all maps, as a search takes them."""
        return {n: synonym_rules(self.get_synonyms(n)["synonyms"]) for n in self.synonym_names()}

    # data

    def _version(self, name: str) -> tuple[int, dict]:
        """The last version's number and content: buckets (number to folder) and top, above which no _seq lies."""
        folder = self._path(name, "versions")
        last = max((int(n[:-5]) for n in os.listdir(folder) if n.endswith(".json")), default=0) if os.path.isdir(folder) else 0
        if not last:
            return 0, {"buckets": {}, "top": -1}
        with open(os.path.join(folder, f"{last:012d}.json")) as f:
            return last, json.load(f)

    def _commit(self, name: str, number: int, content: dict) -> bool:
        """Creates version number; false if another writer has."""
        new = self._path(name, "versions", f".{uuid.uuid4().hex}")
        with open(new, "w") as f:
            json.dump(content, f)
        try:
            os.link(new, self._path(name, "versions", f"{number:012d}.json"))
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(new)

    def _table(self, name: str, index: Index, folders: list[str]) -> DataFrame:
        schema = index.spark().add("_seq", "long")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self._path(name, f) for f in folders))

    def read(self, name: str) -> DataFrame:
        index = self.need(name)
        return self._table(name, index, sorted(self._version(name)[1]["buckets"].values()))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def statistics(self, name: str) -> dict[str, int]:
        """Documents, and bytes that their files take."""
        buckets = self._version(name)[1]["buckets"].values()
        size = sum(os.path.getsize(os.path.join(at, f)) for b in buckets for at, _, files in os.walk(self._path(name, b)) for f in files)
        return {"document_count": self.count(name), "storage_size": size}

    @staticmethod
    def _bucket(key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS)).cast("int")

    def get_doc(self, name: str, key: str) -> DataFrame:
        """The row of one key; only its bucket is read."""
        index, version = self.need(name), self._version(name)[1]
        kind = index.need(index.key).leaf.spark().simpleString()
        at = self.spark.range(1).select(self._bucket(F.lit(key).cast(kind))).first()[0]
        folder = version["buckets"].get(str(at))
        return self._table(name, index, [folder] if folder else []).where(F.col(f"`{index.key}`") == F.lit(key).cast(kind)).drop("_seq").limit(1)

    def index_items(self, name: str, items: list[dict]) -> list[dict]:
        """Applies a batch; readers see it once its version exists. Gives each item's key, status and message."""
        lines = self.spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "seq long, item string")
        return [r.asDict() for r in self.index_lines(name, lines).orderBy("seq").collect()]

    def index_lines(self, name: str, lines: DataFrame) -> DataFrame:
        """(seq, key, status_code, message). An item without a known action refuses the whole batch."""
        index = self.need(name)
        batch = parse_batch(index, lines).persist()
        try:
            if not batch.where(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))).isEmpty():
                raise RequestError("an item has no known @search.action")
            kind = index.need(index.key).leaf.spark().simpleString()
            touched = sorted(r[0] for r in batch.where("key is not null").select(self._bucket(F.col("key").try_cast(kind))).distinct().collect() if r[0] is not None)
            for _ in range(TRIES):
                number, version = self._version(name)
                held = self._table(name, index, [version["buckets"][str(b)] for b in touched if str(b) in version["buckets"]])
                data = f"data-{uuid.uuid4().hex}"
                new = apply_batch(index, held, batch, version["top"]).withColumn("_bucket", self._bucket(F.col(f"`{index.key}`")))
                new.repartition("_bucket").write.partitionBy("_bucket").parquet(self._path(name, data))
                written = self.spark.read.schema(index.spark().add("_seq", "long")).parquet(self._path(name, data))
                top = max(version["top"], written.agg(F.max("_seq")).first()[0] or 0)
                out = statuses(index, held, batch).persist()
                out.count()
                buckets = {b: f for b, f in version["buckets"].items() if int(b) not in touched}
                buckets |= {str(b): f"{data}/_bucket={b}" for b in touched if os.path.isdir(self._path(name, data, f"_bucket={b}"))}
                if self._commit(name, number + 1, {"buckets": buckets, "top": top}):
                    return out
                out.unpersist()
                shutil.rmtree(self._path(name, data))
            raise RequestError("other writers never let this batch in")
        finally:
            batch.unpersist()

    def vacuum(self, name: str) -> None:
        """Removes versions before the last one, and data that it has no part of. Not while others read or write."""
        number, version = self._version(name)
        used = {f.split("/")[0] for f in version["buckets"].values()}
        for n in os.listdir(self._path(name)):
            if n.startswith("data-") and n not in used:
                shutil.rmtree(self._path(name, n))
        for n in os.listdir(self._path(name, "versions")):
            if n.endswith(".json") and int(n[:-5]) < number:
                os.remove(self._path(name, "versions", n))
