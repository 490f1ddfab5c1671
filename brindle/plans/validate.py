"""Checks of index definitions and synonym maps before they are stored."""

from __future__ import annotations

from ..functions.analysis import LANGUAGES, NORMALIZERS, PREDEFINED, chain, normalizer
from .schema import Field, Index, RequestError

_FUNCTION_TYPES = {
    "magnitude": ("Edm.Int32", "Edm.Int64", "Edm.Double"), "freshness": ("Edm.DateTimeOffset",), "distance": ("Edm.GeographyPoint",), "tag": ("Edm.String",),
}
INTERPOLATIONS = ("constant", "linear", "quadratic", "logarithmic")
AGGREGATIONS = ("sum", "average", "minimum", "maximum", "firstMatching", "product")


def _need(sound: bool, message: str) -> None:
    if not sound:
        raise RequestError(message)


def _field(index: Index, f: Field, maps: set[str], depth: int = 0, in_many: bool = False) -> None:
    f.spark()
    if f.complex:
        _need(bool(f.fields), f"{f.name}: a complex field has sub-fields")
        _need(not f.key and f.analyzer is None, f"{f.name}: a complex field is no key and has no analyzer")
        names = [s.name.lower() for s in f.fields]
        _need(len(set(names)) == len(names), f"{f.name}: sub-fields of one name")
        for s in f.fields:
            _need(not s.key, f"{s.name}: a sub-field is no key")
            _field(index, s, maps, depth + 1, in_many or f.collection)
        return
    _need(not f.fields, f"{f.name}: only complex fields have sub-fields")
    if f.vector:
        _need(f.dimensions is not None and 2 <= f.dimensions <= 4096, f"{f.name}: 2 to 4096 dimensions")
        _need(f.metric in ("cosine", "dotProduct", "euclidean"), f"{f.name}: unknown metric {f.metric}")
        _need(not f.sortable and not f.facetable and not f.key and not in_many, f"{f.name}: a vector field is not sortable, facetable or a key, nor in a complex collection")
    else:
        _need(f.dimensions is None, f"{f.name}: only vector fields have dimensions")
    text = f.item == "Edm.String"
    named = [a for a in (f.analyzer, f.index_analyzer, f.search_analyzer) if a is not None]
    _need(not named or (text and f.searchable), f"{f.name}: analyzers belong to searchable strings")
    _need(f.analyzer is None or (f.index_analyzer is None and f.search_analyzer is None), f"{f.name}: analyzer stands alone")
    _need((f.index_analyzer is None) == (f.search_analyzer is None), f"{f.name}: index and search analyzers come together")
    for a in named:
        _need(isinstance(a, dict) or a.lower() in PREDEFINED or a.lower() in LANGUAGES or a.lower().endswith(".microsoft"), f"{f.name}: unknown analyzer {a}")
    _need(f.normalizer is None or (text and (isinstance(f.normalizer, dict) or f.normalizer in NORMALIZERS)), f"{f.name}: unknown normalizer {f.normalizer}")
    _need(not f.synonyms or (text and f.searchable), f"{f.name}: synonym maps belong to searchable strings")
    _need(len(f.synonyms) <= 1, f"{f.name}: one synonym map at most")
    for m in f.synonyms:
        _need(m.lower() in maps, f"{f.name}: unknown synonym map {m}")


def _profile(index: Index, name: str, profile: dict) -> None:
    for path, weight in (profile.get("weights") or {}).items():
        found = index.find(path)
        _need(found is not None and found.leaf.searchable, f"{name}: {path} is not searchable")
        _need(weight > 0, f"{name}: a weight is above 0")
    _need(profile.get("functionAggregation", "sum") in AGGREGATIONS, f"{name}: unknown aggregation")
    for f in profile.get("functions", ()):
        kind, how, found = f.get("type"), f.get("interpolation", "linear"), index.find(f.get("fieldName", ""))
        _need(kind in _FUNCTION_TYPES and kind in f, f"{name}: unknown scoring function {kind}")
        _need(1 < float(f.get("boost", 0)) <= 1_000_000, f"{name}: a boost is above 1, to 1,000,000")
        _need(found is not None and found.leaf.filterable, f"{name}: {f.get('fieldName')} is not filterable")
        _need(found.leaf.item in _FUNCTION_TYPES[kind], f"{name}: {kind} does not fit {found.leaf.type}")
        _need(how in INTERPOLATIONS and not (kind == "tag" and how in ("quadratic", "logarithmic")), f"{name}: {kind} has no {how} interpolation")


def check_index(index: Index, maps: set[str] = frozenset()) -> None:
    """Raises a RequestError for a definition that can't be used. maps: the synonym maps there are, in lower case."""
    names = [f.name.lower() for f in index.fields]
    _need(len(set(names)) == len(names), "fields of one name")
    key = index.need(index.key).leaf
    _need(key.type == "Edm.String" or key.type in ("Edm.Int32", "Edm.Int64"), "a key is a string or a whole number")
    for definition in index.analyzers.values():
        chain(definition)
    for definition in index.normalizers.values():
        normalizer(definition)
    for f in index.fields:
        _field(index, f, maps)
    for name, profile in index.profiles.items():
        _profile(index, name, profile)
    _need(index.default_profile is None or index.default_profile in index.profiles, "unknown default scoring profile")
    for name, sources in index.suggesters.items():
        _need(bool(sources), f"{name}: a suggester has source fields")
        for s in sources:
            found = index.find(s)
            _need(found is not None and found.leaf.item == "Edm.String" and found.leaf.searchable, f"{name}: {s} is no searchable string")
    _need(index.similarity in ("tfidf", "bm25"), "unknown similarity")


def check_synonyms(rules: str, kind: str = "solr") -> None:
    _need(kind == "solr", "synonym maps have the solr format")
    for line in rules.splitlines():
        line = line.split("#")[0].strip()
        sides = line.split("=>")
        _need(not line or (len(sides) <= 2 and all(s.replace(",", "").strip() for s in sides)), f"bad synonym rule {line}")
