"""Results as JSON documents: hits, facet buckets, responses and errors, in columns where they are many."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .schema import Field, Index, RequestError

DATE = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def rendered(f: Field, at: Column) -> Column:
    """A value as JSON shows it: points as GeoJSON, times in UTC with milliseconds, the rest as it is."""
    if f.complex:
        def inner(x: Column) -> Column:
            return F.when(x.isNotNull(), F.struct(*(rendered(s, x.getField(s.name)).alias(s.name) for s in f.fields if s.retrievable)))
    elif f.item == "Edm.GeographyPoint":
        inner = geo.to_geojson
    elif f.item == "Edm.DateTimeOffset":
        inner = lambda x: F.date_format(F.to_utc_timestamp(x.cast("timestamp"), F.current_timezone()), DATE)
    else:
        return at
    return F.transform(at, inner) if f.collection else inner(at)


def hits(index: Index, page: DataFrame) -> DataFrame:
    """(hit): each row of a page as JSON text; what is null has no key."""
    known = {f.name: f for f in index.fields}
    columns = [rendered(known[c], F.col(f"`{c}`")).alias(c) if c in known else F.col(c).alias({"score": "@search.score"}.get(c, "@search." + c)) for c in page.columns]
    return page.select(F.to_json(F.struct(*columns)).alias("hit"))


def buckets(index: Index, name: str, found: DataFrame) -> tuple[str, DataFrame]:
    """The facet's field name as the index writes it, and (bucket): each bucket as JSON text."""
    path = index.need(name)
    leaf = path.leaf

    def show(c: str) -> Column:
        at = F.col(c)
        return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), DATE) if leaf.item == "Edm.DateTimeOffset" else at

    columns = [show(c).alias({"start": "value"}.get(c, c)) for c in ("value", "start", "from", "to") if c in found.columns]
    return path.name, found.select(F.to_json(F.struct(*columns, F.col("count"))).alias("bucket"))


def error(code: str, message: str) -> dict:
    return {"error": {"code": code, "message": message}}


def failure(e: Exception) -> tuple[int, dict]:
    """(status, envelope) of what a request raised; what is no fault of the request shows no details."""
    return (400, error("InvalidRequest", str(e))) if isinstance(e, RequestError) else (500, error("InternalError", "an error occurred"))


def coverage(minimum: float | None) -> dict:
    """All data is always read; the figure shows if it was asked for."""
    return {} if minimum is None else {"@search.coverage": 100.0}


def parameters(query: dict[str, object]) -> Iterator[tuple[str, object]]:
    """A request's parameters under the names that both forms share: `$filter` as filter, `facet` as facets; sessionId and scoringStatistics are accepted and mean nothing."""
    names = {"facet": "facets", "scoringparameter": "parameters", "scoringparameters": "parameters", "scoringprofile": "profile", "searchmode": "mode", "querytype": "syntax", "searchfields": "search_fields"}
    for k, v in query.items():
        name = names.get(k.lstrip("$").lower(), k.lstrip("$").lower())
        if name in ("sessionid", "scoringstatistics", "minimumcoverage", "count", "api-version"):
            continue
        if name in ("facets", "parameters", "search_fields", "highlight"):
            v = tuple(v) if isinstance(v, (list, tuple)) else tuple(x.strip() for x in str(v).split(",")) if name in ("search_fields", "highlight") else (v,)
        elif name in ("skip", "top"):
            try:
                v = int(str(v))
            except ValueError:
                raise RequestError(f"{name} is a whole number") from None
        yield name, v
