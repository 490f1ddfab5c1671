"""Facet counts over the whole match set: documents by distinct value, by given bounds, or by interval."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import normalizer
from ..plans.schema import Index, RequestError

SORTS = {"count": ("count", True), "-count": ("count", False), "value": ("value", False), "-value": ("value", True)}
UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year")
NUMBERS = ("Edm.Int32", "Edm.Int64", "Edm.Double")


#: Bounds of an interval facet.
MAX_BOUNDS = 10_000


@dataclass
class Facet:
    path: object
    count: int = 10
    sort: str = "count"
    values: list | None = None
    interval: object = None
    offset: int = 0  # minutes


def parse_facet(index: Index, text: str) -> Facet:
    name, *options = text.split(",")
    path = index.need(name.strip())
    if path.leaf.complex or path.leaf.item == "Edm.GeographyPoint" or not path.leaf.facetable:
        raise RequestError(f"{name} is not facetable")
    facet, given = Facet(path), set()
    for option in options:
        key, _, value = option.partition(":")
        key, value = key.strip(), value.strip()
        given.add(key)
        if key == "count":
            if not re.fullmatch(r"\d+", value):
                raise RequestError("count takes a whole number")
            facet.count = int(value)
        elif key == "sort":
            if value not in SORTS:
                raise RequestError(f"unknown sort {value}")
            facet.sort = value
        elif key == "values":
            facet.values = [float(v) if path.leaf.item in NUMBERS else v for v in value.split("|")]
            if any(a >= b for a, b in zip(facet.values, facet.values[1:])):
                raise RequestError("values must ascend")
        elif key == "interval":
            dates = path.leaf.item == "Edm.DateTimeOffset"
            if dates and value not in UNITS or not dates and path.leaf.item not in NUMBERS:
                raise RequestError(f"bad interval {value}")
            if not dates and not (re.fullmatch(r"\d+(\.\d+)?", value) and float(value) > 0):
                raise RequestError("an interval is a number above 0")
            facet.interval = value if dates else float(value)
        elif key == "timeoffset":
            m = re.fullmatch(r"([+-])(\d\d):?(\d\d)?", value)
            if not m or int(m[2]) > 14:
                raise RequestError(f"bad timeoffset {value}")
            facet.offset = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0))
        else:
            raise RequestError(f"unknown facet option {key}")
    if {"values", "interval"} <= given or given & {"values", "interval"} and given & {"count", "sort"} or "timeoffset" in given and not isinstance(facet.interval, str):
        raise RequestError("these facet options exclude each other")
    return facet


def _each(match: DataFrame, facet: Facet) -> tuple[Column, bool]:
    column = facet.path.column()
    fold = normalizer(facet.path.leaf.normalizer) if facet.path.leaf.normalizer else None
    if facet.path.many or facet.path.leaf.collection:
        column = F.filter(column, lambda x: x.isNotNull())
        return F.array_distinct(F.transform(column, fold) if fold else column), True
    return fold(column) if fold else column, False


def value_facet(match: DataFrame, facet: Facet) -> DataFrame:
    """(value, count), the best facet.count by facet.sort (0: all). The aggregation combines map-side before its shuffle."""
    column, many = _each(match, facet)
    values = match.select((F.explode(column) if many else column).alias("value")).where("value is not null")
    counts = values.groupBy("value").agg(F.count("*").alias("count"))
    by, down = SORTS[facet.sort]
    order = [F.desc(by) if down else F.asc(by), *([F.asc("value")] if by == "count" else [])]
    counts = counts.orderBy(*order)
    return counts.limit(facet.count) if facet.count else counts


def bounds_of(match: DataFrame, facet: Facet) -> list[float] | None:
    """The bounds of an interval facet: multiples of its width above the least value, the last one above the greatest."""
    column, many = _each(match, facet)
    low, high = (F.array_min(column), F.array_max(column)) if many else (column, column)
    row = match.agg(F.min(low).alias("a"), F.max(high).alias("b")).first()
    if row["a"] is None:
        return None
    w, out = facet.interval, []
    k = math.floor(row["a"] / w) + 1
    while not out or out[-1] <= row["b"]:
        out.append(k * w)
        k += 1
        if len(out) > 10_000:
            raise RequestError("an interval facet has 10,000 bounds at most")
    return out


def range_facet(match: DataFrame, facet: Facet) -> DataFrame:
    """(slot, from, to, count): a document counts once for each bucket it has a value in; empty buckets are kept."""
    spark = match.sparkSession
    bounds = facet.values if facet.values is not None else bounds_of(match, facet)
    if bounds is None:
        return spark.createDataFrame([], "slot long, `from` double, `to` double, count long")
    number = facet.path.leaf.item in NUMBERS
    slot_of = lambda x: sum((F.when(x >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)).cast("long")
    column, many = _each(match, facet)
    slot = F.explode(F.array_distinct(F.transform(column, slot_of))) if many else F.when(column.isNotNull(), slot_of(column))
    counts = match.select(slot.alias("slot")).where("slot is not null").groupBy("slot").agg(F.count("*").alias("count"))
    kind = "double" if number else "string"
    scale = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([None, *bounds], [*bounds, None]))], f"slot long, `from` {kind}, `to` {kind}")
    return scale.join(counts, "slot", "left").select("slot", "from", "to", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def truncated(at: Column, unit: str, offset: int = 0) -> Column:
    """The start of the unit that holds a time; weeks begin on Sunday. offset: minutes east of UTC."""
    local = at + F.expr(f"interval {offset} minutes") if offset else at
    if unit == "week":
        local = F.date_trunc("day", local)
        start = F.date_sub(local.cast("date"), F.dayofweek(local) - 1).cast("timestamp")
    else:
        start = F.date_trunc(unit, local).cast("timestamp")
    return start - F.expr(f"interval {offset} minutes") if offset else start


def date_facet(match: DataFrame, facet: Facet) -> DataFrame:
    """(start, count) of the units that hold dates, empty ones between them included, and one empty unit after the last."""
    column, many = _each(match, facet)
    start = lambda x: truncated(x.cast("timestamp"), facet.interval, facet.offset)
    starts = match.select((F.explode(F.array_distinct(F.transform(column, start))) if many else start(column)).alias("start")).where("start is not null")
    counts = starts.groupBy("start").agg(F.count("*").alias("count"))
    step = "interval 3 months" if facet.interval == "quarter" else f"interval 1 {facet.interval}"
    scale = counts.agg(F.min("start").alias("a"), F.max("start").alias("b")).where("a is not null")
    seconds = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 28 * 86400, "quarter": 89 * 86400, "year": 365 * 86400}[facet.interval]
    span = scale.select(F.unix_timestamp("b") - F.unix_timestamp("a")).first()
    if span is not None and span[0] / seconds > MAX_BOUNDS:
        raise RequestError("a date facet has 10,000 bounds at most")
    scale = scale.select(F.explode(F.expr(f"sequence(a, b + {step}, {step})")).alias("start"))
    return scale.join(counts, "start", "left").select("start", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def facet_counts(match: DataFrame, facet: Facet) -> DataFrame:
    if isinstance(facet.interval, str):
        return date_facet(match, facet)
    return range_facet(match, facet) if facet.values is not None or facet.interval is not None else value_facet(match, facet)


def _named(facet: str):
    return lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value"))


def multi_facet(match: DataFrame, facets: list[Facet]) -> DataFrame:
    """(facet, value, count) of several value facets in one pass: one row for each value of each facet, values as strings."""
    parts = []
    for f in facets:
        column, many = _each(match, f)
        values = F.transform(column, lambda x: x.cast("string")) if many else F.array(column.cast("string"))
        parts.append(F.transform(values, _named(f.path.name)))
    rows = match.select(F.explode(F.flatten(F.array(*parts))).alias("x")).select("x.*").where("value is not null")
    counts = rows.groupBy("facet", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), F.asc("value")))
    most = F.create_map(*(F.lit(x) for f in facets for x in (f.path.name, f.count or 2**31 - 1)))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most[F.col("facet")])
