"""Index definitions: typed fields with capability flags, and paths resolved without regard to case."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RequestError(ValueError):
    """A request that the engine refuses (status 400)."""


SCALARS = {
    "Edm.String": T.StringType(), "Edm.Int32": T.IntegerType(), "Edm.Int64": T.LongType(), "Edm.Double": T.DoubleType(),
    "Edm.Boolean": T.BooleanType(), "Edm.DateTimeOffset": T.TimestampType(),
    "Edm.GeographyPoint": T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]),
}


@dataclass
class Field:
    name: str
    type: str
    key: bool = False
    searchable: bool = False
    filterable: bool = True
    sortable: bool | None = None
    facetable: bool = False
    retrievable: bool = True
    #: Names, or definitions; an index puts its own definitions in the place of their names.
    analyzer: str | dict | None = None
    index_analyzer: str | dict | None = None
    search_analyzer: str | dict | None = None
    normalizer: str | dict | None = None
    dimensions: int | None = None
    metric: str = "cosine"
    synonyms: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()

    @property
    def collection(self) -> bool:
        return self.type.startswith("Collection(")

    @property
    def item(self) -> str:
        return self.type[11:-1] if self.collection else self.type

    @property
    def complex(self) -> bool:
        return self.item == "Edm.ComplexType"

    @property
    def vector(self) -> bool:
        return self.type == "Collection(Edm.Single)"

    def can_sort(self) -> bool:
        if self.collection or self.complex:
            return False
        return self.sortable is True if self.item == "Edm.GeographyPoint" else self.sortable is not False

    def spark(self) -> T.DataType:
        if self.vector:
            return T.ArrayType(T.FloatType(), False)
        if self.complex:
            kind: T.DataType = T.StructType([T.StructField(f.name, f.spark()) for f in self.fields])
        elif self.item in SCALARS:
            kind = SCALARS[self.item]
        else:
            raise RequestError(f"unsupported field type {self.type}")
        return T.ArrayType(kind) if self.collection else kind


def _member(name: str):
    return lambda x: x.getField(name)


@dataclass
class Path:
    """A resolved path: its fields from the top, so that collections on the way are known."""

    fields: tuple[Field, ...]

    @property
    def leaf(self) -> Field:
        return self.fields[-1]

    @property
    def name(self) -> str:
        return "/".join(f.name for f in self.fields)

    @property
    def many(self) -> bool:
        return any(f.collection for f in self.fields)

    def column(self, root: Column | None = None) -> Column:
        """The value, or the array of all values where a collection lies on the way."""
        at, many = root, False
        for f in self.fields:
            if at is None:
                at = F.col(f"`{f.name}`")
            elif many:
                at = F.transform(at, _member(f.name))
                if f.collection:
                    at = F.flatten(F.filter(at, lambda x: x.isNotNull()))
            else:
                at = at.getField(f.name)
            many = many or f.collection
        return at


@dataclass
class Index:
    name: str
    fields: tuple[Field, ...]
    suggesters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    profiles: dict[str, dict] = field(default_factory=dict)
    default_profile: str | None = None
    similarity: str = "tfidf"
    #: Custom chains by name: charFilters, tokenizer and tokenFilters, each a name or a dict with options.
    analyzers: dict[str, dict] = field(default_factory=dict)
    normalizers: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        if sum(f.key for f in self.fields) != 1:
            raise RequestError("an index has exactly one key field")
        self.fields = tuple(map(self._resolved, self.fields))

    def _resolved(self, f: Field) -> Field:
        named = {k: v for k in ("analyzer", "index_analyzer", "search_analyzer") if isinstance(v := getattr(f, k), str)}
        own = {k: self.analyzers[v] for k, v in named.items() if v in self.analyzers}
        if isinstance(f.normalizer, str) and f.normalizer in self.normalizers:
            own["normalizer"] = self.normalizers[f.normalizer]
        return replace(f, **own, fields=tuple(map(self._resolved, f.fields)))

    @property
    def key(self) -> str:
        return next(f.name for f in self.fields if f.key)

    def find(self, path: str) -> Path | None:
        found, fields = [], self.fields
        for part in path.split("/"):
            f = next((f for f in fields if f.name.lower() == part.lower()), None)
            if f is None:
                return None
            found.append(f)
            fields = f.fields
        return Path(tuple(found))

    def need(self, path: str) -> Path:
        found = self.find(path)
        if found is None:
            raise RequestError(f"unknown field {path}")
        return found

    def leaves(self, fields: tuple[Field, ...] | None = None, before: tuple[Field, ...] = ()) -> list[Path]:
        out = []
        for f in self.fields if fields is None else fields:
            out += self.leaves(f.fields, (*before, f)) if f.complex else [Path((*before, f))]
        return out

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark()) for f in self.fields])

    def allows_change(self, new: Index) -> bool:
        """Fields may be added; those that exist stay as they are."""
        held = {f.name: f for f in new.fields}
        return all(held.get(f.name) == f for f in self.fields)
